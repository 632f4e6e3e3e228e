"""Pivot reports in long form: cells, totals, cross-tabs, shares.

Cells are ``groupBy(row, col).count()`` — partial aggregation on the map side,
so a hot key (one region or day holding a third of the rows) only adds map-side
work; the shuffle carries at most one row per key per task.  Everything after
that (totals, percentages, ordinals) runs on the small cell frame.

Cells keep the type of their measure: whole numbers are longs, sums of money or
hours stay decimals or doubles, and so do totals.  A row and column key that
occurs again replaces the cell's value, as the dashboards' maps do
(:func:`last_cells`).

A missing cell is 0 in totals and blank on display, so the long form stays
sparse; ``dense_grid`` fills it over the keys that occur, ``to_wide`` makes one
column for each listed key (no cross join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldreports.functions.numeric import measure, pct_int, total_type
from fieldreports.operators.order import ARRIVAL, with_arrival

SEEN = "_seen"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def last_cells(frame: DataFrame, row: str, col: str, value: str = "cnt") -> DataFrame:
    """``(row, col, value, _seen)``: one row per cell, with the value of the last
    of its rows as returned; of a frame without an order, the largest value.
    NULL counts 0.  ``_seen`` is the arrival of the cell's first row, NULL in a
    frame without an order.

    Cells that are already aggregated by these keys are not shuffled again."""
    kind = frame.schema[value].dataType
    cells, ordered = with_arrival(frame)
    v = measure(F.col(value), kind)
    return cells.groupBy(row, col).agg((F.max_by(v, ARRIVAL) if ordered else F.max(v)).alias(value), F.min(ARRIVAL).alias(SEEN))


def _sum(cells: DataFrame, value: str) -> Column:
    kind = cells.schema[value].dataType
    return F.sum(value).cast(total_type(kind))


def with_col_totals(cells: DataFrame, col_name: str, value: str = "cnt", out: str = "col_total") -> DataFrame:
    """Adds each column key's total (the pivot's Total row) to its cells."""
    kind = cells.schema[value].dataType
    return cells.withColumn(out, F.sum(value).over(Window.partitionBy(col_name)).cast(total_type(kind)))


def percent_of_partition(cells: DataFrame, part: str, value: str = "cnt", total: str = "col_total", out: str = "pct") -> DataFrame:
    """Whole-percent share of a cell in its partition ``part`` (rounded half-up;
    a zero total counts as 1).  Uses the ``total`` column when the cells carry
    it already, else sums ``value`` over a window on ``part``."""
    if total not in cells.columns:
        cells = with_col_totals(cells, part, value, total)
    return cells.withColumn(out, pct_int(value, total, cells.schema[value].dataType))


def to_wide(
    cells: DataFrame, row: str, col: str, values: Sequence, value: str = "cnt", fill: int | None = 0
) -> DataFrame:
    """Wide pivot over an explicit list of column keys (say, the days of the
    filter's range); missing cells -> ``fill``.  A key that is not listed is an
    error when the report runs, never a lost cell."""
    cells = last_cells(cells, row, col, value)
    kind = total_type(cells.schema[value].dataType)
    listed = F.when(F.col(col).isin(list(values)), F.col(col)).otherwise(
        F.raise_error(F.concat(F.lit("column key not listed: "), F.coalesce(F.col(col).cast("string"), F.lit("NULL"))))
    )
    wide = cells.withColumn(col, listed).groupBy(row).pivot(col, list(values)).agg(F.sum(value))
    if fill is None:
        return wide
    names = [c for c in wide.columns if c != row]
    return wide.select(row, *[F.coalesce(F.col(f"`{n}`"), F.lit(fill)).cast(kind).alias(n) for n in names])


def dense_grid(cells: DataFrame, row: str, col: str, value: str = "cnt") -> DataFrame:
    """Every row key with every column key that occurs, 0 where a cell is absent.

    Lazy: the column keys are one array from a scalar subquery over the cell
    frame, each row key explodes it, and the cells join back.  All of it runs
    on the small cell frame, whose exchange is reused, so the fact is scanned
    once; no job runs before the action and there is no cross join.
    """
    cells = last_cells(cells, row, col, value).drop(SEEN)
    kind = cells.schema[value].dataType
    # A condition on the value that always holds: without it the optimizer would
    # compute the key lists by aggregates of their own, with scans of their own.
    cells = cells.where(F.col(value).cast("double") >= F.lit(float("-inf")))
    keys = cells.agg(F.array_sort(F.collect_set(col))).scalar()
    grid = cells.select(row).distinct().withColumn(col, F.explode(keys))
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (row, col)]
    joined = grid.alias("g").join(cells.alias("c"), same[0] & same[1], "left")
    return joined.select(F.col(f"g.{row}").alias(row), F.col(f"g.{col}").alias(col), F.coalesce(F.col(f"c.{value}"), F.lit(0).cast(kind)).alias(value))


def dedupe_last(df: DataFrame, row: str, col: str, seq: str, value: str = "cnt") -> DataFrame:
    """One value per (row, col) cell: the one with the highest ``seq`` wins.

    ``seq`` should be a fixed-width ordering column (a number, a timestamp or
    :func:`time_id_key`) so the aggregate stays hash based with map-side
    combine; a struct key would force a sort-based aggregate.
    """
    return df.groupBy(row, col).agg(F.max_by(value, seq).alias(value))


_EPOCH = "1970-01-01 00:00:00"


def time_id_key(ts: Column | str, ident: Column | str) -> Column:
    """Exact ordering key for (timestamp, id) pairs as one ``decimal(38,0)``:
    microseconds since the epoch times 10^20 plus the id shifted to be
    non-negative.  Orders exactly like the pair and, unlike a struct, can be
    the ordering of a hash aggregate."""
    micros = F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), _c(ts).cast("timestamp_ntz"))
    shifted = _c(ident).cast("decimal(38,0)") + F.lit(str(2**63)).cast("decimal(38,0)")
    return (micros.cast("decimal(38,0)") * F.lit(str(10**20)).cast("decimal(38,0)") + shifted).cast("decimal(38,0)")


def totals_cube(frame: DataFrame, row: str, col: str, value: str = "cnt", seen: bool = False) -> DataFrame:
    """Cube over the cells: cells, row totals, column totals and the grand
    total, with ``g_<row>``/``g_<col>`` grouping flags.  With ``seen`` the
    arrival of a row key is kept for :func:`display_order`."""
    cells = last_cells(frame, row, col, value)
    return cells.cube(row, col).agg(
        _sum(cells, value).alias(value),
        F.grouping(row).cast("long").alias(f"g_{row}"),
        F.grouping(col).cast("long").alias(f"g_{col}"),
        *([F.min(SEEN).alias(SEEN)] if seen else []),
    )


def pivot_long(
    frame: DataFrame,
    row: str,
    col: str,
    order: Sequence[str] | None = None,
    header: Column | None = None,
    row_out: str | None = None,
    value: str = "cnt",
    seen: bool = False,
) -> DataFrame:
    """Long-form pivot: ``(row[, ordinal], col[, header], cnt, col_total)``.

    ``order`` is the preset row order (ordinal NULL for unlisted categories,
    which sort last); ``header`` is a display expression of the column key.
    With ``seen`` the cells' arrival is kept for :func:`display_order`.
    """
    from fieldreports.functions.bands import ordinal_of

    out = with_col_totals(last_cells(frame, row, col, value), col, value)
    cols = [F.col(row).alias(row_out or row)]
    if order is not None:
        cols.append(ordinal_of(row, order).alias("ordinal"))
    cols.append(F.col(col))
    if header is not None:
        cols.append(header.alias("header"))
    return out.select(*cols, value, "col_total", *([SEEN] if seen else []))


def display_order(df: DataFrame, row: str, col: str | None = None, ordinal: str = "ordinal", preset: Sequence[str] | None = None) -> DataFrame:
    """Presentation order of a long pivot: preset categories by their rank
    (``ordinal``, or computed from ``preset``), unlisted ones after them in the
    order they arrived (``_seen``), else alphabetically, then the column key as
    text; total rows come last."""
    from fieldreports.functions.bands import ordinal_of
    from fieldreports.functions.constants import UNKNOWN_RANK

    keys = [F.col(f"g_{row}")] if f"g_{row}" in df.columns else []
    rank = F.col(ordinal) if ordinal in df.columns else ordinal_of(row, preset) if preset is not None else None
    if rank is not None:
        keys.append(F.coalesce(rank, F.lit(UNKNOWN_RANK)))
    if SEEN in df.columns:
        # only categories without a rank go by arrival; the window is over the cells
        first = F.min(SEEN).over(Window.partitionBy(row))
        df = df.withColumn(SEEN, F.when(rank.isNull(), first) if rank is not None else F.lit(None))
        keys.append(F.col(SEEN))
    keys.append(F.col(row))
    if col is not None:
        keys += [F.col(f"g_{col}")] if f"g_{col}" in df.columns else []
        keys.append(F.col(col))
    return df.orderBy(*keys).drop(SEEN)
