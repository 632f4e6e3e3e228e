"""Percentages, exact for whole and decimal measures, and number texts.

Whole numbers and decimals are scaled to ``decimal(38,0)`` and divided with
``div``, so no digit is lost up to 38 of them.  Doubles have no exact quotient;
they are divided as doubles, as the dashboards do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _whole(c: Column, kind: T.DataType) -> Column:
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    return (c * F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast("decimal(38,0)") if scale else c.cast("decimal(38,0)")


def _share(value: Column, total: Column, per: int, kind: T.DataType) -> Column:
    """``value / total`` in ``1/per``, rounded half away from zero; total is not 0."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = value.cast("double") / total.cast("double") * per
        return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")
    v, t = _whole(value, kind), _whole(total, kind)
    sign = F.signum(v) * F.signum(t)
    double = F.lit(2).cast("decimal(1,0)")
    above = (F.abs(v) * F.lit(2 * per).cast("decimal(5,0)") + F.abs(t)).cast("decimal(38,0)")
    return (sign * F.call_function("div", above, (F.abs(t) * double).cast("decimal(38,0)"))).cast("long")


def pct_tenths(value: Column | str, total: Column | str, kind: T.DataType = T.LongType()) -> Column:
    """Share of ``total`` in tenths of a percent, rounded half-up; 0 when total is 0."""
    v, t = _c(value), _c(total)
    return F.when(t == 0, F.lit(0).cast("long")).otherwise(_share(v, t, 1000, kind))


def pct_int(value: Column | str, total: Column | str, kind: T.DataType = T.LongType()) -> Column:
    """Whole-percent share rounded half-up; a zero total counts as 1."""
    v, t = _c(value), _c(total)
    return _share(v, F.when(t == 0, F.lit(1).cast(total_type(kind))).otherwise(t), 100, kind)


def total_type(kind: T.DataType) -> T.DataType:
    """The type that sums of a measure have here."""
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(38, kind.scale)
    return T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()


def measure(c: Column, kind: T.DataType) -> Column:
    """A measure in its own type: whole numbers as long; NULL, and NaN, which
    payloads write as null, count 0."""
    zero = F.lit(0).cast(kind)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.nanvl(c, zero), zero).cast("double")
    out = F.coalesce(c, zero)
    return out.cast("long") if isinstance(kind, T.IntegralType) else out


def number_text(c: Column, kind: T.DataType) -> Column:
    """A number as the dashboards print it: ``45``, ``1.5``, ``12345678``; no
    trailing zeros, exponents only below 1e-6 and from 1e21 on."""
    if isinstance(kind, T.IntegralType):
        return c.cast("string")
    trimmed = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if isinstance(kind, T.DecimalType):
        return trimmed(c.cast("string")) if kind.scale else c.cast("string")
    text, size = c.cast("string"), F.abs(c)
    plain = trimmed(F.when(size < 1, text.cast("decimal(38,30)").cast("string")).otherwise(text.cast("decimal(38,17)").cast("string")))
    exponent = F.regexp_replace(F.regexp_replace(F.lower(text), r"\.0e", "e"), r"e(\d)", "e+$1")
    return F.when(c == 0, F.lit("0")).when((size < 1e-6) | (size >= 1e21), exponent).otherwise(plain)
