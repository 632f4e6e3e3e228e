"""Second-stage reports over a widget's result frame.

Column roles are resolved from the schema on the driver (no data scan).
Shares use a scalar subquery for the grand total instead of a single-partition
window or a cross join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldreports.functions.constants import PROFILE_ATTRIBUTES
from fieldreports.functions.dates import axis_date, cell_date, iso_day
from fieldreports.functions.numeric import measure, number_text, pct_tenths
from fieldreports.functions.text import first_letter, usable_picture
from fieldreports.operators.order import ARRIVAL, first_row, with_arrival


# ---------------------------------------------------------------- roles

def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


@dataclass(frozen=True)
class Roles:
    label: str
    value: str
    date: str


def resolve_roles(schema: T.StructType) -> Roles:
    """Label: first name matching /label/i, else first non-numeric, else first.
    Value: first other name matching /^count/i, else first other numeric, else
    first other.  Date: first name matching /date/i, else first."""
    fields = list(schema.fields)
    names = [f.name for f in fields]
    if not names:
        raise ValueError("empty schema")
    label = next((n for n in names if re.search("label", n, re.I)), None)
    if label is None:
        label = next((f.name for f in fields if not is_numeric(f)), names[0])
    others = [f for f in fields if f.name != label]
    value = next((f.name for f in others if re.match("count", f.name, re.I)), None)
    if value is None:
        value = next((f.name for f in others if is_numeric(f)), None)
    if value is None:
        value = others[0].name if others else names[0]
    date = next((n for n in names if re.search("date", n, re.I)), names[0])
    return Roles(label, value, date)


@dataclass(frozen=True)
class TopRoles:
    group: str
    item: str
    value: str


def resolve_top_roles(schema: T.StructType) -> TopRoles:
    """Group: first name with /region/i, else the first.  Item: first with
    /ase/i, else the second.  Value: the first other one, else the third."""
    names = [f.name for f in schema.fields]
    if len(names) < 3:
        raise ValueError("a top-N report needs a group, an item and a measure")
    group = next((n for n in names if re.search("region", n, re.I)), names[0])
    item = next((n for n in names if re.search("ase", n, re.I)), names[1])
    return TopRoles(group, item, next((n for n in names if n not in (group, item)), names[2]))


# ---------------------------------------------------------------- charts

def pie_share(df: DataFrame, label: str | None = None, value: str | None = None) -> DataFrame:
    """``(label, value, pct_tenths, show_label)``: share of the grand total in
    tenths of a percent (half-up); a label is shown when the rounded share is
    at least 5%.  NULL values count as 0."""
    roles = resolve_roles(df.schema)
    label = label or roles.label
    value = value or roles.value
    kind = df.schema[value].dataType
    v = measure(F.col(f"`{value}`"), kind)
    total = df.agg(F.sum(v)).scalar()
    tenths = pct_tenths(v, F.coalesce(total, F.lit(0)), kind)
    return df.select(
        F.col(f"`{label}`").cast("string").alias("label"),
        v.alias("value"),
        tenths.alias("pct_tenths"),
        (tenths >= 50).cast("long").alias("show_label"),
    )


def bar_series(df: DataFrame, label: str | None = None, value: str | None = None) -> DataFrame:
    roles = resolve_roles(df.schema)
    return df.select(F.col(f"`{label or roles.label}`").alias("label"), F.col(f"`{value or roles.value}`").alias("value"))


_DAYS = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _axis_label(field: T.StructField) -> Column:
    """Axis label of the x value: dates and ISO date-time text as ``d-Mon-yy``,
    anything else as its text."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, _DAYS):
        return axis_date(c)
    s = c.cast("string")
    return F.coalesce(F.when(s.rlike(_ISO_TIME), axis_date(F.try_to_timestamp(s))), s)


def line_series(df: DataFrame, x: str | None = None) -> DataFrame:
    """``(x, axis, series, value)``: every numeric column other than x is a
    series with its own values; ``axis`` is the display label of x, a day as x
    is its ISO text."""
    x = x or resolve_roles(df.schema).date
    fields = {f.name: f for f in df.schema.fields}
    series = [n for n, f in fields.items() if n != x and is_numeric(f)]
    if not series:
        raise ValueError("no numeric series column")
    key = F.col(f"`{x}`")
    own = lambda n: F.col(f"`{n}`").cast("long") if isinstance(fields[n].dataType, T.IntegralType) else F.col(f"`{n}`")
    cast = df.select(
        (iso_day(key) if isinstance(fields[x].dataType, T.DateType) else key).alias("x"),
        _axis_label(fields[x]).alias("axis"),
        *[own(n).alias(n) for n in series],
    )
    return cast.unpivot(["x", "axis"], [F.col(f"`{n}`") for n in series], "series", "value")


def display_number(field: T.StructField) -> Column:
    """Number as locale text: thousands separators, at most three decimals,
    no trailing zeros (``45000`` -> ``45,000``, ``1.5`` -> ``1.5``)."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.IntegralType):
        return F.format_number(c, 0)
    three = F.format_number(c.cast("double"), 3)
    return F.regexp_replace(F.regexp_replace(three, "0+$", ""), r"\.$", "")


def kpi_cards(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """``(label, value)`` for every column of the first row; numbers as locale
    text with thousands separators, NULL shows as '—'.

    The first row is the first one returned; a frame without an order of its
    own is put in one first (all columns unless given).
    """
    cols = df.columns
    first = first_row(df, *(order_by or [F.col(f"`{c}`") for c in cols]))
    as_text = first.select(
        *[(display_number(f) if is_numeric(f) else F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in df.schema.fields]
    )
    return as_text.unpivot([], [F.col(f"`{c}`") for c in cols], "label", "value").select(
        "label", F.coalesce(F.col("value"), F.lit("—")).alias("value")
    )


# ---------------------------------------------------------------- tables

_ISO_DAY = r"^\d{4}-\d{2}-\d{2}"
_ISO_TIME = _ISO_DAY + "T"


def _cell_text_a(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    dtp = field.dataType
    if isinstance(dtp, _DAYS):
        return F.coalesce(cell_date(c), F.lit(""))
    if isinstance(dtp, T.BooleanType):
        return F.when(c, F.lit("true")).otherwise(F.lit(""))
    if isinstance(dtp, T.NumericType):
        bad = c.isNull() | F.isnan(c.cast("double"))
        return F.when(bad, F.lit("")).otherwise(number_text(c, dtp))
    s = c.cast("string")
    dated = F.when(s.rlike(_ISO_DAY), cell_date(F.try_to_timestamp(s)))
    return F.when(s.isNull() | (s == ""), F.lit("")).otherwise(F.coalesce(dated, s))


def table_cells(df: DataFrame, style: str = "attendance") -> DataFrame:
    """Display text of every cell.

    attendance style: empty/NULL/false/NaN -> '' (0 is kept), dates and ISO
    date text -> ``d-Mon-yyyy``; field style: NULL -> '' only.
    """
    return df.select(*cell_texts(df.schema, style))


def cell_texts(schema: T.StructType, style: str = "attendance") -> list[Column]:
    """The columns of :func:`table_cells`."""
    if style == "attendance":
        return [_cell_text_a(f).alias(f.name) for f in schema.fields]
    if style == "field":
        text = lambda f: number_text(F.col(f"`{f.name}`"), f.dataType) if is_numeric(f) else F.col(f"`{f.name}`").cast("string")
        return [F.coalesce(text(f), F.lit("")).alias(f.name) for f in schema.fields]
    raise ValueError(f"unknown table style {style!r}")


# ---------------------------------------------------------------- employee

def profile_card(rows: DataFrame, order_by: list[Column] | None = None) -> DataFrame:
    """One profile: the first row returned (of a frame without an order: by
    ``order_by``, else the newest day where there is one, then the user id);
    the picture is usable when it is present, not 'NA' and starts with http;
    otherwise the initial is shown.  A blank name shows as '-'.  Attributes are
    listed as ``(attribute, value)`` with blanks omitted."""
    newest = [F.col("Date").desc()] if "Date" in rows.columns else []
    first = first_row(rows, *(order_by or [*newest, F.col("`User ID`").asc()]))
    pic = F.col("`Profile Picture`")
    has_pic = usable_picture(pic)
    name = F.col("`Employee Name`")
    attrs = F.array(
        *[F.struct(F.lit(a).alias("attribute"), F.col(f"`{a}`").cast("string").alias("value")) for a in PROFILE_ATTRIBUTES]
    )
    return (
        first.select(
            F.when(name != "", name).otherwise(F.lit("-")).alias("name"),
            F.when(has_pic, pic).alias("picture"),
            F.when(has_pic, F.lit(None).cast("string")).otherwise(first_letter(name)).alias("initial"),
            F.inline(attrs),
        )
        .where(F.col("value").isNotNull() & (F.col("value") != ""))
    )


def attendance_summary(df: DataFrame, type_col: str = "Attendance Type", days_col: str = "Days") -> DataFrame:
    """``(attendance_type, days, unit)``: blank types and NULL day counts are
    dropped, 0 is kept; unit is 'day' for exactly one, else 'days'."""
    t, d = F.col(f"`{type_col}`"), F.col(f"`{days_col}`")
    whole = isinstance(df.schema[days_col].dataType, T.IntegralType)
    return df.where(t.isNotNull() & (t != "") & d.isNotNull()).select(
        t.alias("attendance_type"),
        (d.cast("long") if whole else d).alias("days"),
        F.when(d == 1, F.lit("day")).otherwise(F.lit("days")).alias("unit"),
    )


# ---------------------------------------------------------------- top-N

def top_n_per_group(df: DataFrame, group: str | None = None, item: str | None = None, value: str | None = None, n: int = 10) -> DataFrame:
    """``(group, rank, item, value)``: the first n rows of each group as returned;
    of a frame without an order, the n largest measures (ties broken by item).
    Measures keep their own type, NULL counts 0.  Columns that are not named come
    from :func:`resolve_top_roles`.  Spark plans this as a partial
    WindowGroupLimit before the shuffle, so each map task forwards at most n
    rows per group."""
    if None in (group, item, value):
        roles = resolve_top_roles(df.schema)
        group, item, value = group or roles.group, item or roles.item, value or roles.value
    v = measure(F.col(f"`{value}`"), df.schema[value].dataType)
    arrived, ordered = with_arrival(df)
    by = [F.col(ARRIVAL)] if ordered else [F.col("value").desc(), F.col(f"`{item}`").asc()]
    w = Window.partitionBy(f"`{group}`").orderBy(*by)
    return (
        arrived.select(f"`{group}`", f"`{item}`", v.alias("value"), ARRIVAL)
        .withColumn("rank", F.row_number().over(w).cast("long"))
        .where(F.col("rank") <= n)
        .select(f"`{group}`", "rank", f"`{item}`", "value")
    )
