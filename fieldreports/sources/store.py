"""A stored fact that grows by day.

``add`` writes rows and makes them the only rows of their days: new days are
appended, late days replaced.  A write goes to a folder of its own (``rows/part=…``
and ``cells/<table>/part=…``, Parquet by year) that no reader knows; a record in
``commits`` then names it and its days, and that one small file, renamed into
place by Spark's committer, switches all readers.  A day belongs to the newest
record that lists it; of older parts that also hold it, those rows are passed
over by a predicate in the one scan, so replacing a day rewrites nothing else.

* A writer that dies leaves a folder without a record, which is never read.
* Writers need no lock: each record is complete in itself, and of two writers that
  add the same day the later record wins as a whole.
* Readers keep the state they planned with: no folder of a part is changed.
* Cells are written with the rows, under the same record, so they are in step.

Rows without a day form a day of their own.  ``compact`` rewrites the state into
one part, whose record sorts before any that was added meanwhile.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldreports.sources import ingest
from fieldreports.sources.cells import SUM_INPUTS, TABLES, CellTable, cells_of, with_derived

DAY = "date_d"
#: A report reads a cell table only if the fact has at least so many times its rows.
LEAST_REDUCTION = 2

#: Rows of which at least so many in a hundred are cells of their own are dealt once
#: by day and dimensions; fewer cells are gathered first and dealt as cells.
LEAST_DISTINCT = 90
#: From so many rows on the cells are estimated before they are made.
ESTIMATED_ROWS = 1_000_000

_RECORD = "part string, at long, days array<string>, schema string, n_rows long, n_cells map<string,long>"
_NO_DAY = ""


def _day_text(day: dt.date | None) -> str:
    return _NO_DAY if day is None else day.isoformat()


@dataclass(frozen=True)
class Part:
    """A write: its folder and the days it holds; ``owned``: those that are still its own."""

    name: str
    at: int
    days: frozenset[str]
    owned: frozenset[str]
    schema: str
    n_rows: int
    n_cells: dict = field(compare=False)


@dataclass(frozen=True)
class Derived:
    """A fact to be written: narrow rows, their day, and the step that makes the
    fact's columns of them without moving a row (None: ``rows`` is the fact)."""

    rows: DataFrame
    day: Column | None = None
    widened: Callable[[DataFrame], DataFrame] | None = None

    def frame(self) -> DataFrame:
        return self.rows if self.widened is None else self.widened(self.rows)

    def between(self, first: dt.date, last: dt.date) -> "Derived":
        day = F.col(DAY) if self.day is None else self.day
        return replace(self, rows=self.rows.where(day.between(F.lit(first), F.lit(last))))


class FactStore:
    """The fact ``name`` below ``path``, a folder on shared storage."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path.rstrip("/")

    # ------------------------------------------------------------ state

    def parts(self) -> list[Part]:
        """The parts that readers use, oldest first (one record a write, read in full)."""
        try:
            rows = self.spark.read.schema(_RECORD).json(f"{self.path}/commits").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        rows = sorted((r for r in rows if r["part"]), key=lambda r: (r["at"], r["part"]))
        owner = {day: r["part"] for r in rows for day in r["days"]}
        parts = [Part(r["part"], r["at"], frozenset(r["days"]), frozenset(d for d in r["days"] if owner[d] == r["part"]), r["schema"], r["n_rows"], r["n_cells"] or {}) for r in rows]
        # the newest write stays even if it is empty: it tells the schema
        return [p for p in parts if p.owned or p is parts[-1]]

    def is_empty(self) -> bool:
        return not self.parts()

    @staticmethod
    def _passed_over(part: Part) -> Column | None:
        """Rows of a part whose day belongs to another part."""
        lost, kept = part.days - part.owned, part.owned
        if not lost:
            return None
        dates = lambda days: [F.lit(dt.date.fromisoformat(d)) for d in sorted(days) if d != _NO_DAY]
        if len(lost) <= len(kept):
            gone = F.col(DAY).isin(dates(lost)) if dates(lost) else F.lit(False)
        else:
            gone = ~F.col(DAY).isin(dates(kept)) if dates(kept) else F.lit(True)
        gone = F.coalesce(gone, F.lit(_NO_DAY in lost)) if _NO_DAY in part.days else gone
        return (F.col("part") == part.name) & gone

    def _read(self, root: str, parts: list[Part], schema: T.StructType) -> DataFrame:
        used = [p for p in parts if p.n_rows and p.owned]
        if not used:
            return self.spark.createDataFrame([], schema)
        types = T.StructType([*schema.fields, T.StructField("part", T.StringType())])
        df = self.spark.read.schema(types).option("basePath", root).parquet(*[f"{root}/part={p.name}" for p in used])
        for gone in (self._passed_over(p) for p in used):
            if gone is not None:
                df = df.where(~gone)
        return df.select(*schema.names)

    def rows(self, parts: list[Part] | None = None) -> DataFrame:
        """The rows of the present state."""
        parts = self.parts() if parts is None else parts
        if not parts:
            raise ValueError(f"nothing was written below {self.path}")
        return self._read(f"{self.path}/rows", parts, T.StructType.fromJson(_json(parts[-1].schema)))

    def cells(self, parts: list[Part] | None = None, least_reduction: float = LEAST_REDUCTION) -> list[CellTable]:
        """The cell tables of the same state that are small against the rows."""
        parts = self.parts() if parts is None else parts
        if not parts:
            return []
        total, schema, out = sum(p.n_rows for p in parts), T.StructType.fromJson(_json(parts[-1].schema)), []
        empty = self.spark.createDataFrame([], schema)
        for table, dimensions in TABLES[self.name].items():
            n = sum(p.n_cells.get(table, 0) for p in parts)
            if n * least_reduction <= total and all(table in p.n_cells for p in parts):
                kind = cells_of(empty, self.name, dimensions).schema
                out.append(CellTable(table, self._read(f"{self.path}/cells/{table}", parts, kind), n))
        return out

    # ------------------------------------------------------------ writes

    def _scattered(self, written: DataFrame, n_rows: int) -> set[str]:
        """The cell tables with about a cell a row (one pass, estimates only)."""
        if n_rows < ESTIMATED_ROWS:
            return set()
        tables = TABLES[self.name]
        base = with_derived(written, self.name)
        n = base.agg(*[F.approx_count_distinct(F.struct(*dims), 0.02).alias(t) for t, dims in tables.items()]).first()
        return {t for t in tables if n[t] * 100 >= LEAST_DISTINCT * n_rows}

    def _write_cells(self, written: DataFrame, table: str, to: str, n_rows: int, scattered: bool) -> None:
        dimensions = TABLES[self.name][table]
        if not scattered:
            ingest.write_fact(cells_of(written, self.name, dimensions), to)
            return
        # Rows dealt by ranges of all dimensions, the day first, have each cell in
        # one task: the cells are made and written where the rows have arrived.
        base = with_derived(written, self.name).select(*dict.fromkeys([*dimensions, *SUM_INPUTS[self.name]]))
        keys = ["year", DAY, *[c for c in dimensions if c not in ("year", DAY)]]
        ingest.write_fact(cells_of(ingest.ranged(base, keys, n_rows), self.name, dimensions), to, shuffle=False)

    def add(self, df: DataFrame | Derived, days: Iterable[dt.date | None] = (), at: int | None = None, n_rows: int | None = None) -> str:
        """Write ``df`` as the only rows of its days, and of ``days``, which may
        hold none of them.  ``n_rows``: about how many rows it has, if that is
        known.  Returns the part's name."""
        derived = df if isinstance(df, Derived) else Derived(df)
        schema = derived.frame().schema
        if at is None:
            # later than all that this writer can have seen, whatever the clocks say
            at = max([time.time_ns(), *(p.at + 1 for p in self.parts())])
        part = f"w{uuid.uuid4().hex}"
        folder = f"{self.path}/rows/part={part}"
        ingest.write_fact(derived.rows, folder, day=derived.day, widened=derived.widened, n_rows=n_rows)
        written = self.spark.read.schema(schema).parquet(folder)
        counted = {r[DAY]: r["n"] for r in written.groupBy(DAY).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a day
        n_cells, total = {}, sum(counted.values())
        scattered = self._scattered(written, total)
        for table in TABLES[self.name]:
            to = f"{self.path}/cells/{table}/part={part}"
            self._write_cells(written, table, to, total, table in scattered)
            n_cells[table] = self.spark.read.schema("_n long").parquet(to).count()
        names = sorted({_day_text(d) for d in (*counted, *days)})
        record = self.spark.createDataFrame([(part, at, names, schema.json(), total, n_cells)], _RECORD)
        record.coalesce(1).write.json(f"{self.path}/commits/write={part}")
        return part

    def compact(self) -> str | None:
        """Rewrite the present state as one part."""
        parts = self.parts()
        if len(parts) < 2:
            return None
        days = [None if d == _NO_DAY else dt.date.fromisoformat(d) for p in parts for d in p.owned]
        return self.add(self.rows(parts), days, at=max(p.at for p in parts) + 1, n_rows=sum(p.n_rows for p in parts))


def _json(text: str):
    import json

    return json.loads(text)
