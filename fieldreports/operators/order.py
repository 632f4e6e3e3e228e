"""The order in which a frame returns its rows.

Some reports depend on it: the first row of a card, the first ten of a group, the
last value of a repeated cell.  A frame has an order of its own if it ends in a
global sort.  Its arrival index numbers the rows along that sort: by partition and
row, once the sort is done.  It increases but has gaps, and needs no second sort,
no window and no job.  Rows that the sort itself leaves tied arrive in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARRIVAL = "_arrival"


def has_order(df: DataFrame) -> bool:
    """Does the frame itself end in a global sort (so that it has a first row)?"""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias", "GlobalLimit", "LocalLimit", "Offset", "View", "WithCTE"):
        node = node.children().last()  # the only one, or the statement after its common table expressions
    return node.nodeName() == "Sort" and getattr(node, "global")()


def with_arrival(df: DataFrame) -> tuple[DataFrame, bool]:
    """The frame with its arrival index (NULL for a frame without an order), and
    whether it has one."""
    ordered = has_order(df)
    return df.withColumn(ARRIVAL, F.monotonically_increasing_id() if ordered else F.lit(None).cast("long")), ordered


def first_row(df: DataFrame, *order) -> DataFrame:
    """The first row as returned; of a frame without an order, by ``order``."""
    return (df if has_order(df) else df.orderBy(*order)).limit(1)
