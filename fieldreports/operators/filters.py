"""Filter specifications bound to Catalyst predicates.

A specification holds what a dashboard user selected.  Normalisation follows
the dashboards' request handling exactly:

* single selects (region, ase, zse) are disabled by ``None``, ``""`` or ``"All"``;
  region is compared raw (no trimming, case-sensitive), ase/zse stripped;
* multi selects drop empty tokens first and strip the rest, so a
  whitespace-only token survives as ``""`` and matches blank rows;
* ``type`` is matched case-insensitively (``lower(trim(type))``);
* dates are inclusive day bounds; the id search is a substring ILIKE where
  ``%`` and ``_`` typed by the user stay wildcards;
* a NULL dimension never satisfies a filter (three-valued logic).

Values are bound as literals, never spliced into SQL text.  Predicates use the
normalised key columns written at ingest (see ``sources.ingest``) so they push
down to Parquet; date bounds also add a predicate on the ``year`` partition
column so a written table is pruned by directory.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldreports.functions.constants import ALL
from fieldreports.functions.text import contains_pattern


def _single(v: str | None, strip: bool) -> str | None:
    if not v or v == ALL:
        return None
    return v.strip() if strip else v


def _multi(vs: Iterable[str] | str | None, lower: bool = False) -> tuple[str, ...]:
    if vs is None:
        return ()
    if isinstance(vs, str):
        vs = [vs]
    out = [v.strip() for v in vs if v]
    return tuple(v.lower() for v in out) if lower else tuple(out)


def _day(v: str | dt.date | None) -> dt.date | None:
    if v is None or v == "":
        return None
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, dt.date):
        return v
    return dt.date.fromisoformat(v.strip())


def _search(v: str | None) -> str | None:
    if v is None or not v.strip():
        return None
    return contains_pattern(v)




def _and(preds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def _date_slot(date_from: dt.date | None, date_to: dt.date | None, columns: set[str] | None) -> Column | None:
    parts = []
    prune = columns is None or "year" in columns
    if date_from is not None:
        parts.append(F.col("date_d") >= F.lit(date_from))
        if prune:
            parts.append(F.col("year") >= F.lit(date_from.year))
    if date_to is not None:
        parts.append(F.col("date_d") <= F.lit(date_to))
        if prune:
            parts.append(F.col("year") <= F.lit(date_to.year))
    return _and(parts) if parts else None


def _getlist(params: Mapping, key: str) -> list[str]:
    v = params.get(key)
    if v is None:
        return []
    if isinstance(v, str):
        return [v]
    return list(v)


def _getone(params: Mapping, key: str) -> str | None:
    v = params.get(key)
    if isinstance(v, (list, tuple)):
        return v[0] if v else None
    return v


class _Spec:
    SLOTS: tuple[str, ...] = ()
    SLOT_COLUMNS: Mapping[str, tuple[str, ...]] = {}

    def slots(self, columns: set[str] | None = None) -> dict[str, Column]:
        raise NotImplementedError

    def predicate(self, honours: Iterable[str] | None = None, columns: set[str] | None = None) -> Column:
        """Conjunction of the active slots (all, or only those a report honours)."""
        s = self.slots(columns)
        keep = set(self.SLOTS if honours is None else honours)
        unknown = keep - set(self.SLOTS)
        if unknown:
            raise KeyError(f"unknown filter slots {sorted(unknown)}")
        return _and(p for k, p in s.items() if k in keep)

    def apply(self, df: DataFrame, honours: Iterable[str] | None = None) -> DataFrame:
        return df.filter(self.predicate(honours, set(df.columns)))

    def columns(self, honours: Iterable[str] | None = None) -> set[str]:
        """The columns that the active slots (or those a report honours) read."""
        return {c for slot in self.slots() if honours is None or slot in honours for c in self.SLOT_COLUMNS[slot]}

    def values(self) -> dict:
        """The selected values by name, normalised, None where a filter is off
        (what named markers in stored SQL are bound to)."""
        raise NotImplementedError

    def is_empty(self) -> bool:
        return not self.slots()


def days_between(first: str | dt.date, last: str | dt.date) -> list[dt.date]:
    """The days of a date range, both ends included."""
    a, b = _day(first), _day(last)
    return [a + dt.timedelta(days=i) for i in range((b - a).days + 1)]


@dataclass(frozen=True)
class AttendanceFilter(_Spec):
    """Filter of the attendance dashboard (eight slots)."""

    region: str | None = None
    types: tuple[str, ...] | list[str] | str | None = None
    channels: tuple[str, ...] | list[str] | str | None = None
    ase: str | None = None
    zse: str | None = None
    atypes: tuple[str, ...] | list[str] | str | None = None
    date_from: str | dt.date | None = None
    date_to: str | dt.date | None = None
    user_id: str | None = None

    SLOTS = ("region", "type", "channel", "ase", "date", "zse", "atype", "user")
    SLOT_COLUMNS = MappingProxyType(
        {
            "region": ("region",),
            "type": ("type_ci",),
            "channel": ("channel_key",),
            "ase": ("ase_key",),
            "date": ("date_d",),
            "zse": ("zse_key",),
            "atype": ("atype_key",),
            "user": ("user_txt",),
        }
    )

    @classmethod
    def from_params(cls, params: Mapping) -> "AttendanceFilter":
        """From a multi-valued request map (``type``/``channel``/``atype`` repeat)."""
        return cls(
            region=_getone(params, "region"),
            types=tuple(_getlist(params, "type")),
            channels=tuple(_getlist(params, "channel")),
            ase=_getone(params, "ase"),
            zse=_getone(params, "zse"),
            atypes=tuple(_getlist(params, "atype")),
            date_from=_getone(params, "date_from"),
            date_to=_getone(params, "date_to"),
            user_id=_getone(params, "user_id"),
        )

    def user_term(self) -> str | None:
        return _search(self.user_id)

    def values(self) -> dict:
        return {
            "region": _single(self.region, strip=False),
            "type": list(_multi(self.types, lower=True)) or None,
            "channel": list(_multi(self.channels)) or None,
            "ase": _single(self.ase, strip=True),
            "zse": _single(self.zse, strip=True),
            "atype": list(_multi(self.atypes)) or None,
            "date_from": _day(self.date_from),
            "date_to": _day(self.date_to),
            "user": self.user_term(),
        }

    def slots(self, columns: set[str] | None = None) -> dict[str, Column]:
        out: dict[str, Column] = {}
        region = _single(self.region, strip=False)
        if region is not None:
            out["region"] = F.col("region") == F.lit(region)
        types = _multi(self.types, lower=True)
        if types:
            out["type"] = F.col("type_ci").isin(list(types))
        channels = _multi(self.channels)
        if channels:
            out["channel"] = F.col("channel_key").isin(list(channels))
        ase = _single(self.ase, strip=True)
        if ase is not None:
            out["ase"] = F.col("ase_key") == F.lit(ase)
        date = _date_slot(_day(self.date_from), _day(self.date_to), columns)
        if date is not None:
            out["date"] = date
        zse = _single(self.zse, strip=True)
        if zse is not None:
            out["zse"] = F.col("zse_key") == F.lit(zse)
        atypes = _multi(self.atypes)
        if atypes:
            out["atype"] = F.col("atype_key").isin(list(atypes))
        pattern = self.user_term()
        if pattern is not None:
            out["user"] = F.col("user_txt").ilike(pattern)
        return out


@dataclass(frozen=True)
class VisitFilter(_Spec):
    """Filter of the field-activity dashboard (seven slots)."""

    region: str | None = None
    zse: str | None = None
    ase: str | None = None
    channels: tuple[str, ...] | list[str] | str | None = None
    tiers: tuple[str, ...] | list[str] | str | None = None
    date: str | None = None
    date_from: str | dt.date | None = None
    date_to: str | dt.date | None = None
    user_id: str | None = None

    SLOTS = ("region", "zse", "ase", "channel", "tier", "date", "user")
    SLOT_COLUMNS = MappingProxyType(
        {
            "region": ("region",),
            "zse": ("zse_key",),
            "ase": ("ase_key",),
            "channel": ("channel_key",),
            "tier": ("tier_key",),
            "date": ("date_d", "date_key"),
            "user": ("ase_ho_id",),
        }
    )

    @classmethod
    def from_params(cls, params: Mapping) -> "VisitFilter":
        return cls(
            region=_getone(params, "region"),
            zse=_getone(params, "zse"),
            ase=_getone(params, "ase"),
            channels=tuple(_getlist(params, "channel")),
            tiers=tuple(_getlist(params, "tier")),
            date=_getone(params, "date"),
            date_from=_getone(params, "date_from"),
            date_to=_getone(params, "date_to"),
            user_id=_getone(params, "user_id"),
        )

    def values(self) -> dict:
        return {
            "region": _single(self.region, strip=False),
            "zse": _single(self.zse, strip=True),
            "ase": _single(self.ase, strip=True),
            "channel": list(_multi(self.channels)) or None,
            "tier": list(_multi(self.tiers)) or None,
            "date": self.date.strip() if self.date else None,
            "date_from": _day(self.date_from),
            "date_to": _day(self.date_to),
            "user": _search(self.user_id),
        }

    def slots(self, columns: set[str] | None = None) -> dict[str, Column]:
        out: dict[str, Column] = {}
        region = _single(self.region, strip=False)
        if region is not None:
            out["region"] = F.col("region") == F.lit(region)
        zse = _single(self.zse, strip=True)
        if zse is not None:
            out["zse"] = F.col("zse_key") == F.lit(zse)
        ase = _single(self.ase, strip=True)
        if ase is not None:
            out["ase"] = F.col("ase_key") == F.lit(ase)
        channels = _multi(self.channels)
        if channels:
            out["channel"] = F.col("channel_key").isin(list(channels))
        tiers = _multi(self.tiers)
        if tiers:
            out["tier"] = F.col("tier_key").isin(list(tiers))
        date_parts = []
        if self.date:
            date_parts.append(F.col("date_key") == F.lit(self.date.strip()))
        rng = _date_slot(_day(self.date_from), _day(self.date_to), columns)
        if rng is not None:
            date_parts.append(rng)
        if date_parts:
            out["date"] = _and(date_parts)
        if self.user_id is not None and self.user_id.strip():
            out["user"] = F.col("ase_ho_id").ilike(contains_pattern(self.user_id))
        return out


def employee_gate(spec: AttendanceFilter) -> Column:
    """Employee reports show rows only once a user id is entered."""
    return F.lit(spec.user_term() is not None)
