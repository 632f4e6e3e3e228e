"""Dimension lists and filter-option facets.

The canonical facet output is long: one ``(facet, value)`` row per distinct
option, computed in a single scan with one shuffle (partial distinct on the
map side, final distinct after a hash exchange).  It never funnels the values
of a facet into one task, so it scales to unbounded domains such as user ids.
The wide ``facets_wide`` form (one array per facet) is for the dimension facets;
id lists grow with the data and are read from the long form.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldreports.operators.filters import AttendanceFilter, VisitFilter, _and
from fieldreports.sources.cells import CellTable, smallest


@dataclass(frozen=True)
class Facet:
    name: str  # output name, e.g. "regions"
    column: str  # normalised column holding the option text
    keep_blank: bool  # region keeps '' as an option; the others drop it
    slot: str | None  # filter slot that selects on this facet (for exclude_self)


# Facets of the attendance dashboard, in its order.  The id search slot does
# not apply to them.
ATTENDANCE_FACETS = (
    Facet("regions", "region", True, "region"),
    Facet("types", "type_key", False, "type"),
    Facet("channels", "channel_key", False, "channel"),
    Facet("ases", "ase_key", False, "ase"),
    Facet("zses", "zse_key", False, "zse"),
    Facet("atypes", "atype_key", False, "atype"),
    Facet("user_ids", "user_txt", True, None),
)
ATTENDANCE_FACET_SLOTS = ("region", "type", "channel", "ase", "date", "zse", "atype")

# Facets of the field-activity dashboard; all its slots apply, id search included.
VISIT_FACETS = (
    Facet("regions", "region", True, "region"),
    Facet("zses", "zse_key", False, "zse"),
    Facet("ases", "ase_key", False, "ase"),
    Facet("channels", "channel_key", False, "channel"),
    Facet("tiers", "tier_key", False, "tier"),
    Facet("dates", "date_key", False, "date"),
    Facet("ase_ho_ids", "ase_ho_key", False, "user"),
)
VISIT_FACET_SLOTS = ("region", "zse", "ase", "channel", "tier", "date", "user")

DIMENSIONS = {
    "region": ("region", True),
    "type": ("type_key", False),
    "channel": ("channel_key", False),
    "ase": ("ase_key", False),
    "zse": ("zse_key", False),
    "atype": ("atype_key", False),
}


def _option(col: str, keep_blank: bool) -> Column:
    c = F.col(col)
    return c if keep_blank else F.when(c != "", c)


def _rows(fact: DataFrame, cells: Iterable[CellTable], columns: Iterable[str]) -> DataFrame:
    """The smallest cell table that has the columns, or the fact."""
    table = smallest(cells, columns)
    return fact if table is None else table.frame


def dimension_list(fact: DataFrame, dim: str, alias: str | None = None, cells: Iterable[CellTable] = ()) -> DataFrame:
    """Distinct non-null options of one dimension, sorted (one column)."""
    col, keep_blank = DIMENSIONS[dim]
    fact = _rows(fact, cells, [col])
    out = alias or dim
    c = F.col(col)
    rows = fact.where(c.isNotNull() if keep_blank else c != "")  # plain predicates reach the scan
    return rows.select(c.alias(out)).distinct().orderBy(out)


def zse_ase_pairs(fact: DataFrame, cells: Iterable[CellTable] = ()) -> DataFrame:
    """Distinct (zse, ase) pairs with both present, sorted by both."""
    return (
        _rows(fact, cells, ["zse_key", "ase_key"]).select(F.col("zse_key").alias("zse"), F.col("ase_key").alias("ase"))
        .where((F.col("zse") != "") & (F.col("ase") != ""))
        .distinct()
        .orderBy("zse", "ase")
    )


def _facet_frame(fact: DataFrame) -> DataFrame:
    if "ase_ho_id" in fact.columns and "ase_ho_key" not in fact.columns:
        return fact.withColumn("ase_ho_key", F.trim("ase_ho_id"))
    return fact


def facets_long(
    fact: DataFrame,
    spec: AttendanceFilter | VisitFilter | None = None,
    facets: Sequence[Facet] | None = None,
    exclude_self: bool = False,
    cells: Iterable[CellTable] = (),
) -> DataFrame:
    """``(facet, value)`` rows: the options left under the filter.

    Facets whose columns a stored cell table has, with those that the filter
    compares, are read from the smallest such table; the others (ids, or all
    under an id search) from the fact.

    By default every facet is computed under all active filters, including its
    own (a chosen region leaves just that region).  With ``exclude_self`` each
    facet ignores its own slot; still one scan: the shared slots filter the
    rows and each facet carries its own remaining condition.
    """
    if facets is None:
        facets = VISIT_FACETS if isinstance(spec, VisitFilter) else ATTENDANCE_FACETS
    if spec is None:
        spec = AttendanceFilter() if set(facets) <= set(ATTENDANCE_FACETS) else VisitFilter()
    slot_names = ATTENDANCE_FACET_SLOTS if isinstance(spec, AttendanceFilter) else VISIT_FACET_SLOTS
    compared = spec.columns(slot_names)
    stored = [f for f in facets if smallest(cells, {f.column, *compared})]
    if stored:
        table = smallest(cells, {*(f.column for f in stored), *compared})
        if table is not None:
            rest = [f for f in facets if f not in stored]
            own = facets_long(table.frame, spec, stored, exclude_self)
            return own.unionByName(facets_long(fact, spec, rest, exclude_self)) if rest else own
    fact = _facet_frame(fact)
    slots = {k: v for k, v in spec.slots(set(fact.columns)).items() if k in slot_names}

    if exclude_self:
        own = {f.slot for f in facets if f.slot is not None}
        shared = _and(p for k, p in slots.items() if k not in own)
        base = fact.filter(shared)
        pairs = []
        for f in facets:
            cond = _and(p for k, p in slots.items() if k in own and k != f.slot)
            pairs.append(F.struct(F.lit(f.name).alias("facet"), F.when(cond, _option(f.column, f.keep_blank)).alias("value")))
    else:
        base = fact.filter(_and(slots.values()))
        pairs = [
            F.struct(F.lit(f.name).alias("facet"), _option(f.column, f.keep_blank).alias("value")) for f in facets
        ]
    return base.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull()).distinct()


def facet_sizes(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: number of options per facet (``n_<facet>``), 0 for empty facets.

    The long frame is already distinct, so this is one global aggregate of
    conditional counts (partial counts per task, then one row per task)."""
    facet = F.col("facet")
    return long.agg(*[F.count(F.when(facet == n, 1)).cast("long").alias(f"n_{n}") for n in names])


def facets_wide(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row of sorted option arrays (empty array for an empty facet), for
    facets whose values are dimension members.

    An array is one value of one row, so it suits dimensions (regions, types,
    channels, teams) and not ids: facets that are not named here are filtered
    out before anything is gathered.
    """
    wide = long.where(F.col("facet").isin(list(names))).groupBy().pivot("facet", list(names)).agg(F.sort_array(F.collect_list("value")))
    return wide.select(
        *[F.coalesce(F.col(n), F.array().cast("array<string>")).alias(n) for n in names]
    )


def option_lists(long: DataFrame) -> DataFrame:
    """The long facets in display order: facet by facet, values sorted."""
    return long.orderBy("facet", "value")
