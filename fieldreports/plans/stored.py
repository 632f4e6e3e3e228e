"""Stored widget SQL: filter slots bound where they stand, by analysis.

A slot token stands for a predicate over the raw columns of the fact.  Such a
predicate (``lower(trim(type))``, a parsed text date) cannot reach a Parquet
scan.  The ingested fact keeps the same values in normalised columns, so each
slot is bound to those wherever they mean the same: at the slot's place, both the
raw and the normalised columns must resolve to the fact's own columns.  The
analyzer tells: the statement is analysed once with a probe of these columns in
the slots' places, and the attributes that it resolved them to are compared with
those of the fact.  Where the normalised columns are not visible (a subquery that
projects raw columns only), or a raw name means something else (``upper(type) AS
type`` below the slot), the slot keeps its raw predicate.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldreports.functions.dates import CENTURY_PIVOT
from fieldreports.operators.filters import AttendanceFilter, VisitFilter


@dataclass(frozen=True)
class Part:
    """A predicate of a slot, for the value ``value``: over raw columns, and the
    same over normalised columns.  In ``keyed``, ``{}`` stands for the markers of
    a list's values."""

    value: str
    raw_column: str
    raw: str
    keyed_columns: tuple[str, ...]
    keyed: str


def _same(value: str, column: str) -> Part:
    return Part(value, column, f"{column} = :{value}", (column,), f"{column} = :{value}")


def _trimmed(value: str, column: str, key: str) -> Part:
    return Part(value, column, f"trim({column}) = :{value}", (key,), f"{key} = :{value}")


def _listed(value: str, column: str, key: str, form: str = "trim({})") -> Part:
    return Part(value, column, f"array_contains(:{value}, {form.format(column)})", (key,), f"{key} IN ({{}})")


def _bound(value: str, column: str, day: str, sign: str) -> Part:
    keyed = f"date_d {sign} :{value} AND year {sign} year(:{value})"
    return Part(value, column, f"{day} {sign} :{value}", ("date_d", "year"), keyed)


def _text_day(c: str) -> str:
    day = f"try_to_date({c}, 'd-MMM-yy')"
    return f"CASE WHEN year({day}) >= {CENTURY_PIVOT} THEN add_months({day}, -1200) ELSE {day} END"


# The filter slot tokens stored widget SQL may contain.  Values are
# named markers; a date slot has one part for each bound that is set.
SLOTS = {
    "region_filter": (_same("region", "region"),),
    "type_filter": (_listed("type", "type", "type_ci", "lower(trim({}))"),),
    "channel_filter": (_listed("channel", "channel", "channel_key"),),
    "ase_filter": (_trimmed("ase", "ase", "ase_key"),),
    "zse_filter": (_trimmed("zse", "zse", "zse_key"),),
    "atype_filter": (_listed("atype", "attendance_type", "atype_key"),),
    "tier_filter": (_listed("tier", "tier", "tier_key"),),
}
_ATT_DAY, _VISIT_DAY = "CAST(attendance_date AS DATE)", _text_day("trim(date)")
ATTENDANCE_SLOTS = SLOTS | {
    "date_filter": (_bound("date_from", "attendance_date", _ATT_DAY, ">="), _bound("date_to", "attendance_date", _ATT_DAY, "<=")),
    "user_filter": (Part("user", "user_id", "CAST(user_id AS STRING) ILIKE :user", ("user_txt",), "user_txt ILIKE :user"),),
}
VISIT_SLOTS = SLOTS | {
    "date_filter": (
        # equal texts have equal days, so the text is looked for on its day only
        Part("date", "date", "trim(date) = :date", ("date_key", "date_d", "year"), f"date_key = :date AND date_d <=> {_text_day(':date')} AND year <=> year({_text_day(':date')})"),
        _bound("date_from", "date", _VISIT_DAY, ">="),
        _bound("date_to", "date", _VISIT_DAY, "<="),
    ),
    "user_filter": (Part("user", "ase_ho_id", "ase_ho_id ILIKE :user", ("ase_ho_id",), "ase_ho_id ILIKE :user"),),
}


def slots_of(spec: AttendanceFilter | VisitFilter) -> dict[str, tuple[Part, ...]]:
    return ATTENDANCE_SLOTS if isinstance(spec, AttendanceFilter) else VISIT_SLOTS


def _rewritten(sql: str, slots: dict, fact_table: str, view: str, put) -> str:
    """The text with ``put(place, token)`` for every slot token (places from 0) and
    ``view`` for the fact table's name (quoted or schema-qualified or neither).
    Quoted texts and comments are passed over."""
    name = re.escape(fact_table)
    lexemes = re.compile(
        r"'(?:[^'\\]|\\.|'')*'"  # a text
        r"|--[^\n]*|/\*.*?\*/"  # a comment
        r"|\{(?P<slot>\w+)\}"
        rf"""|(?<![\w."`])(?P<fact>(?:\w+\.|"\w+"\.|`\w+`\.)?(?:"{name}"|`{name}`|{name}))(?![\w"`])""",
        re.S,
    )
    places = iter(range(len(sql)))

    def one(m: re.Match) -> str:
        if m["slot"] in slots:
            return put(next(places), m["slot"])
        return view if m["fact"] else m[0]

    return lexemes.sub(one, sql)


def bound_sql(sql: str, spec: AttendanceFilter | VisitFilter, fact_table: str, view: str, keyed: frozenset[int] = frozenset()) -> tuple[str, dict]:
    """``(text, arguments)`` of stored widget SQL for a filter selection.

    Every slot token is replaced where it stands: by ``AND`` and a predicate over
    named markers if its filter is active, else by nothing.  Places in ``keyed``
    use the normalised columns.  No value enters the text."""
    values, slots = spec.values(), slots_of(spec)
    used: dict = {}

    def predicate(place: int, token: str) -> str:
        out = []
        for part in slots[token]:
            value = values.get(part.value)
            if value is None:
                continue
            if place in keyed and isinstance(value, list):
                names = {f"{part.value}_{i}": v for i, v in enumerate(value)}
                used.update(names)
                out.append("AND " + part.keyed.format(", ".join(f":{n}" for n in names)))
            else:
                used[part.value] = value
                out.append("AND " + (part.keyed if place in keyed else part.raw))
        return " ".join(out)

    return _rewritten(sql, slots, fact_table, view, predicate), used


def _attributes(df: DataFrame) -> dict[int, tuple]:
    """Attributes that probes resolved to, by the probe's place."""
    plan = df._jdf.queryExecution().analyzed().toString()
    found = {}
    for place, inner in re.findall(r"named_struct\(_slot, (\d+),((?: [^()]*?)?)\)", plan):
        found[int(place)] = tuple((name, int(number)) for name, number in re.findall(r"(\w+)#(\d+)", inner))
    return found


def _one_instance(seen: tuple, own: tuple) -> bool:
    """Are these the fact's attributes, of one reading of it?  Where a statement
    reads the fact twice, the analyzer numbers the second reading's attributes
    anew, in the same order; no other attribute gets one of those numbers."""
    return [n for n, _ in seen] == [n for n, _ in own] and len({a - b for (_, a), (_, b) in zip(seen, own)}) == 1


def _probe(place: int, columns: tuple[str, ...]) -> str:
    return f"named_struct('_slot', {place}, " + ", ".join(f"'c{i}', {c}" for i, c in enumerate(columns)) + ")"


def keyed_places(spark: SparkSession, sql: str, spec: AttendanceFilter | VisitFilter, fact_table: str, view: str) -> frozenset[int]:
    """The places of active slots at which raw and normalised columns are the fact's own."""
    values, slots = spec.values(), slots_of(spec)
    wanted: dict[int, tuple[str, ...]] = {}

    def note(place: int, token: str) -> str:
        parts = [p for p in slots[token] if values.get(p.value) is not None]
        if parts:
            wanted[place] = tuple(dict.fromkeys(c for p in parts for c in (p.raw_column, *p.keyed_columns)))
        return ""

    _rewritten(sql, slots, fact_table, view, note)

    def resolved(places: list[int]) -> dict[int, tuple]:
        probed = lambda place, token: f"AND {_probe(place, wanted[place])} IS NOT NULL" if place in places else ""
        try:
            return _attributes(spark.sql(_rewritten(sql, slots, fact_table, view, probed)))
        except AnalysisException:
            return {p: a for half in (places[: len(places) // 2], places[len(places) // 2 :]) for p, a in resolved(half).items()} if len(places) > 1 else {}

    def of_fact(place: int) -> tuple | None:
        try:
            return _attributes(spark.sql(f"SELECT {_probe(place, wanted[place])} AS p FROM {view}")).get(place)
        except AnalysisException:  # a fact without normalised columns
            return None

    candidates = {p: a for p in wanted if (a := of_fact(p))}
    if not candidates:
        return frozenset()
    seen = resolved(list(candidates))
    return frozenset(p for p, a in candidates.items() if p in seen and _one_instance(seen[p], a))


def run_stored(sql: str, fact: DataFrame, spec: AttendanceFilter | VisitFilter, fact_table: str) -> DataFrame:
    """The result of stored widget SQL over the unfiltered fact.

    The fact is known to the statement as a temporary view with a name of its
    own, which is dropped once the statement is analysed."""
    spark = fact.sparkSession
    view = f"fact_{uuid.uuid4().hex}"
    if "date_txt" in fact.columns and "date" not in fact.columns:
        fact = fact.withColumn("date", F.col("date_txt"))  # the text date has this name upstream
    fact.createTempView(view)
    try:
        text, values = bound_sql(sql, spec, fact_table, view, keyed_places(spark, sql, spec, fact_table, view))
        return spark.sql(text, {k: F.lit(v) for k, v in values.items()} or None)
    finally:
        spark.catalog.dropTempView(view)
