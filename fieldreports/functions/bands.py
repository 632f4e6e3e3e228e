"""Business categories derived from the attendance and visit facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldreports.functions.constants import (
    BELOW_HALF_DAY,
    IMPACT_ORDER,
    NO_CHECK_OUT,
    NOT_CHECKED_IN,
    NOT_MARKED,
    TIMING_ORDER,
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordinal_of(c: Column | str, order: Sequence[str]) -> Column:
    """1-based rank of a category in a preset order; NULL when it is not listed.

    A plain expression (no join): the preset list is a literal array.
    """
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), _c(c))
    return F.when(pos > 0, pos).cast("long")


def normalise_attendance_type(c: Column | str) -> Column:
    """Trimmed attendance type; NULL or blank becomes ``Not Marked``."""
    t = F.trim(_c(c))
    return F.when(t.isNull() | (t == ""), F.lit(NOT_MARKED)).otherwise(t)


def timing_band(check_in: Column | str) -> Column:
    """Check-in band by hour of day; no check-in is its own band."""
    ci = _c(check_in)
    h = F.hour(ci)
    before10, ten_to_noon, noon_to_two, after2, none = TIMING_ORDER
    return (
        F.when(ci.isNull(), F.lit(none))
        .when(h < 10, F.lit(before10))
        .when(h < 12, F.lit(ten_to_noon))
        .when(h < 14, F.lit(noon_to_two))
        .otherwise(F.lit(after2))
    )


_HOUR_US = 3600 * 1_000_000


def impact_band(check_in: Column | str, check_out: Column | str) -> Column:
    """Salary-impact band from the worked span (exact, in microseconds)."""
    ci, co = _c(check_in), _c(check_out)
    half_day, full_day = IMPACT_ORDER[0], IMPACT_ORDER[1]
    span = F.timestamp_diff("MICROSECOND", ci, co)
    return (
        F.when(ci.isNull(), F.lit(NOT_CHECKED_IN))
        .when(co.isNull(), F.lit(NO_CHECK_OUT))
        .when(span >= 9 * _HOUR_US, F.lit(full_day))
        .when(span * 2 >= 9 * _HOUR_US, F.lit(half_day))
        .otherwise(F.lit(BELOW_HALF_DAY))
    )


def _fmt(x: float) -> str:
    return f"{x:g}"


def workhour_labels(edges: Sequence[float]) -> list[str]:
    """Band labels generated from ascending edges, e.g. (4, 6, 8) ->
    ``Below 4 Hrs``, ``4-6 Hrs``, ``6-8 Hrs``, ``8 Hrs & Above``."""
    e = list(edges)
    if not e or sorted(e) != e:
        raise ValueError("edges must be a non-empty ascending sequence")
    labels = [f"Below {_fmt(e[0])} Hrs"]
    labels += [f"{_fmt(a)}-{_fmt(b)} Hrs" for a, b in zip(e, e[1:])]
    labels.append(f"{_fmt(e[-1])} Hrs & Above")
    return labels


def workhour_band(hours: Column | str, edges: Sequence[float] = (4, 6, 8)) -> Column:
    """Working-hour band of a numeric hours column (NULL stays NULL)."""
    h = _c(hours)
    labels = workhour_labels(edges)
    expr = F.when(h.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        expr = expr.when(h < edge, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))
