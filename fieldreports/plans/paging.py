"""Keyset pages: any page of a result is read alone.

A page is asked for by the token of the page before, which holds the values of
its last row.  The rows after that row are found by a predicate on the order's
columns, which reaches the scan, so a later page reads less than an earlier one
and no page reads what lies before it.  Only a page and one more row leave the
executors; the sort keeps no more than that in a task.

The order is made total: the named columns first, then all others.  Rows that it
cannot tell apart are copies of one row, and the token counts how many of them
were handed out, so joined pages are the whole result, each row once.

A token is a place between values, not a row number: rows that are added later
do not shift the pages that follow.  NULL sorts first ascending and last
descending, as Spark does; NaN is the largest number and -0.0 counts as 0.0.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldreports.plans.sinks import json_of, payload_columns


@dataclass(frozen=True)
class Key:
    """A column of an order.  ``fact_column``: the fact's column that it shows."""

    name: str
    descending: bool = False
    fact_column: str | None = None


@dataclass(frozen=True)
class Page:
    """Rows in order, and the token that the next page is asked for with (``None``: the last page)."""

    columns: list[str]
    rows: list[dict]
    next: str | None


@dataclass(frozen=True)
class _Place:
    """Values of the order's columns as text, and how many copies of that row were read."""

    values: tuple[str | None, ...]
    read: int


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def total_order(df: DataFrame, order: Sequence[Key]) -> list[Key]:
    """The order's columns, then all other columns of the frame by place."""
    named = {k.name for k in order}
    missing = named - set(df.columns)
    if missing or len(named) < len(order) or len(set(df.columns)) < len(df.columns):
        raise ValueError(f"an order needs distinct columns of the result, got {[k.name for k in order]} of {df.columns}")
    keys = [*order, *[Key(c) for c in df.columns if c not in named]]
    for k in keys:
        if isinstance(df.schema[k.name].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            raise ValueError(f"column {k.name!r} cannot be part of an order of pages")
    return keys


def _unsigned_zero(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema.fields if _is_float(f.dataType)}
    if not floats:
        return df
    plain = lambda c: F.when(_column(c) == 0, F.lit(0.0).cast(df.schema[c].dataType)).otherwise(_column(c)).alias(c)
    return df.select(*[plain(c) if c in floats else _column(c) for c in df.columns])


def _text(df: DataFrame, key: Key) -> Column:
    """A value as text that :func:`_literal` reads back unchanged."""
    kind, c = df.schema[key.name].dataType, _column(key.name)
    if isinstance(kind, T.TimestampType):  # local time is not unique
        return F.unix_micros(c).cast("string")
    return F.base64(c) if isinstance(kind, T.BinaryType) else c.cast("string")


def _literal(df: DataFrame, key: Key, text: str) -> Column:
    kind = df.schema[key.name].dataType
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.lit(text).cast("long"))
    return F.unbase64(F.lit(text)) if isinstance(kind, T.BinaryType) else F.lit(text).cast(kind)


def _same(df: DataFrame, key: Key, text: str | None) -> Column:
    c = _column(key.name)
    if text is None:
        return c.isNull()
    if _is_float(df.schema[key.name].dataType) and text == "NaN":
        return F.coalesce(F.isnan(c), F.lit(False))
    return c.eqNullSafe(_literal(df, key, text))


def _later(df: DataFrame, key: Key, text: str | None) -> Column:
    """Rows whose value comes after the given one."""
    c = _column(key.name)
    if text is None:
        return F.lit(False) if key.descending else c.isNotNull()
    value, floats = _literal(df, key, text), _is_float(df.schema[key.name].dataType)
    if floats and text == "NaN":
        return ~F.isnan(c) | c.isNull() if key.descending else F.lit(False)
    if key.descending:
        return (c < value) | c.isNull()
    # file statistics leave NaN out, so a bare comparison could skip it
    return (c > value) | F.isnan(c) if floats else c > value


def _after(df: DataFrame, keys: Sequence[Key], place: _Place) -> DataFrame:
    """Rows after all copies of the place's row."""
    pairs = list(zip(keys, place.values))
    first, text = pairs[0]
    ways, equal = [], F.lit(True)
    for key, value in pairs:
        ways.append(equal & _later(df, key, value))
        equal = equal & _same(df, key, value)
    # the first column's bound alone is implied, but is what a scan can use
    return df.where(_later(df, first, text) | _same(df, first, text)).where(reduce(lambda a, b: a | b, ways))


def _is_row(df: DataFrame, keys: Sequence[Key], place: _Place) -> Column:
    return reduce(lambda a, b: a & b, [_same(df, k, v) for k, v in zip(keys, place.values)])


def _token(keys: Sequence[Key], place: _Place) -> str:
    held = [[[k.name, k.descending] for k in keys], list(place.values), place.read]
    return base64.urlsafe_b64encode(json.dumps(held, separators=(",", ":")).encode()).decode()


def _held(token: str) -> list:
    try:
        named, values, read = json.loads(base64.urlsafe_b64decode(token.encode()))
    except (ValueError, TypeError) as e:
        raise ValueError("not a page token") from e
    return [named, values, read]


def _place(keys: Sequence[Key], token: str | None) -> _Place | None:
    if token is None:
        return None
    named, values, read = _held(token)
    if named != [[k.name, k.descending] for k in keys] or len(values) != len(keys):
        raise ValueError("the token belongs to a result with other columns or another order")
    return _Place(tuple(values), int(read))


def _sorted(df: DataFrame, keys: Sequence[Key]) -> DataFrame:
    return df.orderBy(*[_column(k.name).desc() if k.descending else _column(k.name).asc() for k in keys])


def _page_frame(df: DataFrame, keys: Sequence[Key], size: int, place: _Place | None) -> DataFrame:
    if place is None:
        return _sorted(df, keys).limit(size)
    rest = _after(df, keys, place)
    if not place.read:
        return _sorted(rest, keys).limit(size)
    copies = df.where(_is_row(df, keys, place))
    left = min(max(copies.count() - place.read, 0), size)
    if left == size:
        return copies.limit(size)
    rest = _sorted(rest, keys).limit(size - left)
    return copies.limit(left).unionAll(rest) if left else rest


def page_frame(df: DataFrame, order: Sequence[Key], size: int, token: str | None = None) -> DataFrame:
    """The page after ``token`` (the first without one) as a frame of at most ``size`` rows."""
    if size < 1:
        raise ValueError("a page holds one row at least")
    df = _unsigned_zero(df)
    keys = total_order(df, order)
    return _page_frame(df, keys, size, _place(keys, token))


def pruned(fact: DataFrame, order: Sequence[Key], token: str | None) -> DataFrame:
    """The fact without the years before the token's row, for a result with the
    fact's day as its first column (a row of it shows rows of one day)."""
    if token is None or not order or order[0].fact_column != "date_d" or "year" not in fact.columns:
        return fact
    _, values, _ = _held(token)
    year = F.col("year")
    if values[0] is None:
        return fact.where(year.isNull()) if order[0].descending else fact
    try:
        first = dt.date.fromisoformat(values[0]).year
    except ValueError:  # a year of five digits
        return fact
    return fact.where((year <= first) | year.isNull() if order[0].descending else year >= first)


def page(df: DataFrame, order: Sequence[Key], size: int, token: str | None = None, shown: Sequence[Column] | None = None) -> Page:
    """The page after ``token`` (the first without one) as row objects.

    ``shown`` are the columns that are displayed (all as they are without it),
    computed for the rows of the page only."""
    if size < 1:
        raise ValueError("a page holds one row at least")
    df = _unsigned_zero(df)
    keys = total_order(df, order)
    start = _place(keys, token)
    raw = _page_frame(df, keys, size + 1, start)  # one more row: is there a next page?
    display = raw.select(*(shown if shown is not None else [_column(c) for c in df.columns]))
    columns = payload_columns(display)
    name = "place"
    while name in columns:
        name += "_"
    placed = raw.select(*(shown if shown is not None else [_column(c) for c in df.columns]), F.array(*[_text(df, k) for k in keys]).alias(name))
    got = placed.select(json_of(display.schema).alias("json"), _column(name).alias("place")).collect()
    rows, places = got[:size], [tuple(r["place"]) for r in got]
    following = None
    if len(got) > size:
        last, read = places[size - 1], 0
        if places[size] == last:
            read = size - places.index(last)
            read += start.read if start is not None and start.values == last else 0
        following = _token(keys, _Place(last, read))
    return Page(columns, [json.loads(r["json"]) for r in rows], following)
