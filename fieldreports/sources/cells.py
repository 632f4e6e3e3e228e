"""Cells: rows of a fact counted by day and dimensions.

A cell frame is a fact of weighted rows: it has some of the fact's columns and
``_n``, the number of rows that share them, besides sums of the measures that
reports use.  Filters and widget frames work on it as on the fact itself, as long
as it has the columns they read.  Its size is bounded by the days and the members
of its dimensions, however many rows the fact has.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldreports.functions.bands import impact_band, timing_band

#: The number of rows of a cell.
ROWS = "_n"

#: Columns that cells have and facts only imply, by fact.
DERIVED = {
    "attendance": {"timing": lambda: timing_band("check_in"), "impact": lambda: impact_band("check_in", "check_out")},
    "visits": {},
}
#: Sums that every cell has besides its number of rows, by fact.
SUMS = {
    "attendance": {"_n_check_in": lambda: F.count("check_in")},
    "visits": {"qty": lambda: F.sum("qty").cast("long")},
}
#: The fact's columns that these sums read.
SUM_INPUTS = {"attendance": ("check_in",), "visits": ("qty",)}
_TEAM = ("region", "zse_key", "ase_key", "channel_key")
#: Stored cell tables by fact: name and dimensions.  Every one has the day and the year.
TABLES = {
    "attendance": {
        "days": ("date_d", "year", "region", "attendance_type", "atype_key", "timing", "impact"),
        "teams": ("date_d", "year", *_TEAM, "type_key", "type_ci", "attendance_type", "atype_key", "timing", "impact"),
    },
    "visits": {
        "places": ("date_d", "year", "date_key", "region", "location_in", "location_out", "workhour"),
        "mix": ("date_d", "year", "date_key", "region", "channel_key", "tier_key"),
        "teams": ("date_d", "year", "date_key", *_TEAM, "tier_key"),
    },
}


def with_derived(base: DataFrame, fact: str) -> DataFrame:
    return base.select("*", *[e().alias(c) for c, e in DERIVED[fact].items() if c not in base.columns])


def sums(fact: str) -> list[Column]:
    return [F.count(F.lit(1)).alias(ROWS), *[e().alias(c) for c, e in SUMS[fact].items()]]


def cells_of(base: DataFrame, fact: str, dimensions: Iterable[str]) -> DataFrame:
    """The cells of a fact (or of its filtered rows) over some of its columns."""
    return with_derived(base, fact).groupBy(*dimensions).agg(*sums(fact))


def records(frame: DataFrame) -> Column:
    """The number of fact rows in an aggregation of a fact or of its cells."""
    return (F.coalesce(F.sum(ROWS), F.lit(0)) if ROWS in frame.columns else F.count(F.lit(1))).cast("long")


def records_where(frame: DataFrame, condition: Column) -> Column:
    """The number of fact rows that meet a condition (NULL without any row)."""
    return F.sum(F.when(condition, F.col(ROWS) if ROWS in frame.columns else F.lit(1)).otherwise(0)).cast("long")


def column_of(frame: DataFrame, name: str, derived: Column) -> Column:
    """A cell's column, or the expression that derives it from the fact."""
    return F.col(name) if name in frame.columns else derived


@dataclass(frozen=True)
class CellTable:
    """A stored cell table as reports read it."""

    name: str
    frame: DataFrame
    n_cells: int

    def covers(self, columns: Iterable[str]) -> bool:
        return set(columns) <= set(self.frame.columns)


def smallest(tables: Iterable[CellTable], columns: Iterable[str]) -> CellTable | None:
    """The smallest table that has all these columns."""
    needed = set(columns)
    return min((t for t in tables if t.covers(needed)), key=lambda t: t.n_cells, default=None)
