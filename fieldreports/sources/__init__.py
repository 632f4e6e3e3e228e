"""Sources: driver tables, the two fact fixtures, ingest, catalogs."""

from __future__ import annotations

import datetime as dt
import threading
import weakref
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldreports.session import scratch_path
from fieldreports.sources import fixtures, ingest
from fieldreports.sources.cells import CellTable
from fieldreports.sources.store import Derived, FactStore
from fieldreports.sources.tables import TABLE_NAMES, read_table  # noqa: F401

FACTS = ("attendance", "visits")

#: Session setting: a folder on shared storage where facts are kept for later sessions.
FACTS_DIR = "spark.fieldreports.facts.dir"


@dataclass
class FactSource:
    """Where the normalised facts come from.

    Without ``base`` they are derived lazily from the driver tables at
    ``sf_dir``.  With it, each fact is written to ``<base>/<name>`` the first
    time it is asked for (a :class:`FactStore`: Parquet by year, in files of
    narrow day ranges, and its cell tables), and scanned from there afterwards;
    a fact that an earlier session completed there is opened as it is.
    ``refresh`` derives some days anew and adds or replaces just those.  A
    failing write is an error.
    """

    spark: SparkSession
    sf_dir: str
    base: str | None = None
    _frames: dict = field(default_factory=dict, repr=False, compare=False)
    _cells: dict = field(default_factory=dict, repr=False, compare=False)
    _locks: dict = field(default_factory=lambda: {n: threading.Lock() for n in FACTS}, repr=False, compare=False)

    def path(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"

    def _derived(self, name: str) -> Derived:
        if name == "visits":
            rows, widened = fixtures.visit_stages(self.spark, self.sf_dir)
            return Derived(rows, ingest.visit_day(fixtures.visit_date("day")), lambda df: ingest.normalise_visits(widened(df)))
        daily = None
        if self.base is not None:
            # The daily event aggregate feeds three consumers (days, roster,
            # the join); writing it once means one pass over events.
            path = scratch_path(self.spark, "daily")
            fixtures.daily_events(self.spark, self.sf_dir).write.parquet(path)
            daily = self.spark.read.parquet(path)
        return Derived(ingest.normalise_attendance(fixtures.attendance(self.spark, self.sf_dir, daily=daily)))

    def _frame(self, name: str) -> DataFrame:
        # One handle per fact: a written table is listed and its footers read
        # once, then every report plans against the same relation.
        with self._locks[name]:
            if name not in self._frames:
                if self.base is None:
                    self._frames[name], self._cells[name] = self._derived(name).frame(), []
                else:
                    store = self.store(name)
                    if store.is_empty():  # what a dead writer left has no record
                        # about a visit a line item; the number is read from the files' footers
                        n_rows = self.table("lineitem").count() if name == "visits" else None
                        store.add(self._derived(name), n_rows=n_rows)
                    parts = store.parts()
                    self._frames[name], self._cells[name] = store.rows(parts), store.cells(parts)
            return self._frames[name]

    def store(self, name: str) -> FactStore:
        if self.base is None:
            raise ValueError("facts without a folder are derived, not stored")
        return FactStore(self.spark, name, self.path(name))

    def cells(self, name: str) -> list[CellTable]:
        """The stored cell tables of a fact (none for a derived fact)."""
        self._frame(name)
        return self._cells[name]

    def refresh(self, name: str, first: dt.date, last: dt.date) -> None:
        """Derive the days from ``first`` to ``last`` anew: days that are new are
        added, days that are there are replaced.  Frames handed out before keep
        the state they had."""
        self._frame(name)  # an empty store gets all days first
        days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
        self.store(name).add(self._derived(name).between(first, last), days)
        with self._locks[name]:
            self._frames.pop(name)

    def attendance(self) -> DataFrame:
        return self._frame("attendance")

    def visits(self) -> DataFrame:
        return self._frame("visits")

    def table(self, name: str, columns=None) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name, columns)

    def materialise(self, base: str | None = None) -> "FactSource":
        """A source with both facts written: below ``base``, a folder on shared
        storage that later sessions give again, or else below a fresh folder of
        the shared checkpoint folder."""
        from concurrent.futures import ThreadPoolExecutor

        out = FactSource(self.spark, self.sf_dir, base or scratch_path(self.spark, "facts"))
        with ThreadPoolExecutor(max_workers=len(FACTS)) as pool:  # two independent jobs
            for f in [pool.submit(out._frame, n) for n in FACTS]:
                f.result()
        return out

    @classmethod
    def shared(cls, spark: SparkSession, sf_dir: str, written: bool = True) -> "FactSource":
        """The session's source for ``sf_dir``.

        With ``written`` (the default) a fact is written when a report first
        asks for it and scanned by every report after that: below the folder
        that the session names in ``spark.fieldreports.facts.dir``, where later
        sessions find it (one folder per state of the tables), else below the
        checkpoint folder.  Otherwise the lazily derived facts are shared.
        """
        key = (sf_dir.rstrip("/"), written)
        with _SHARED_LOCK:
            per_session = _SHARED.setdefault(spark, {})
            if key not in per_session:
                kept = spark.conf.get(FACTS_DIR, None)
                per_session[key] = cls(spark, key[0], (kept or scratch_path(spark, "facts")) if written else None)
            return per_session[key]


_SHARED: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()
_SHARED_LOCK = threading.Lock()
