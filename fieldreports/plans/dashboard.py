"""A whole dashboard for one filter selection.

``run_dashboard`` returns the second-stage report of every active widget as a
lazy DataFrame.  Widgets that a stored cell table can answer read that.  All
others that aggregate share one aggregation over grouping sets, a set for the
columns of each, so the filtered fact is scanned once for them; its rows (cells
of each set) are cached and every report is split off them.  Stored SQL and row
reports read the fact themselves.  Nothing is collected here.  The cache is a
plain DataFrame cache that Spark recomputes from lineage if an executor is lost;
``DashboardRun.close`` (or leaving its ``with`` block) releases it.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldreports.operators.filters import AttendanceFilter, VisitFilter
from fieldreports.plans import registry
from fieldreports.plans.sinks import Pages, pages
from fieldreports.sources.cells import ROWS, SUM_INPUTS, SUMS, CellTable, sums, with_derived

FACT_OF = {"attendance": "attendance", "field": "visits"}


@dataclass
class DashboardRun:
    catalog: list[dict]
    reports: dict[int, DataFrame]
    deferred: list[int]  # employee widgets waiting for an id search
    summaries: dict[int, DataFrame] = field(default_factory=dict)  # day counts shown below a chart
    details: frozenset[int] = frozenset()  # reports that grow with the fact
    cached: DataFrame | None = None
    shared: DataFrame | None = None  # the one aggregation that several reports read
    sources: dict[int, str] = field(default_factory=dict)  # what each report reads: a cell table's name, "shared" or "fact"

    def close(self) -> None:
        """Release what is cached."""
        for df in (self.cached, self.shared):
            if df is not None:
                df.unpersist()
        self.cached = self.shared = None

    def __enter__(self) -> "DashboardRun":
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def shared_cells(base: DataFrame, fact: str, sets: Iterable[tuple[str, ...]]) -> tuple[DataFrame, dict[tuple[str, ...], DataFrame]]:
    """Cells of several column sets by one aggregation over grouping sets: the
    aggregation, and each set's cells as a selection of its rows."""
    sets = list(dict.fromkeys(tuple(s) for s in sets))
    columns = list(dict.fromkeys(c for s in sets for c in s))
    rows = with_derived(base, fact).select(*columns, *SUM_INPUTS[fact])
    totals = [c for c in (ROWS, *SUMS[fact])]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*sums(fact), F.grouping_id().alias("_set"))
    number = lambda s: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)
    out = out.persist(StorageLevel.MEMORY_AND_DISK)
    return out, {s: out.where(F.col("_set") == number(s)).select(*s, *totals) for s in sets}


def run_dashboard(
    fact: DataFrame,
    spec: AttendanceFilter | VisitFilter,
    dashboard: str,
    persist_base: bool = False,
    widgets: tuple | None = None,
    cells: Iterable[CellTable] = (),
) -> DashboardRun:
    """Reports of every active widget (the built-in set, or ``widgets``, e.g.
    from ``registry.widgets_from_catalog``), rendered per the dashboard's
    chart-type rules.  ``cells`` are the fact's stored cell tables."""
    shown = registry.active(dashboard, widgets)
    base = spec.apply(fact)
    run = DashboardRun([registry.entry_of(w) for w in shown], {}, [], details=frozenset(w.id for w in shown if w.is_detail))
    if persist_base:
        run.cached = base = base.persist(StorageLevel.MEMORY_AND_DISK)
    run.deferred = [w.id for w in shown if w.needs_user and not registry.has_user(spec)]
    shown = [w for w in shown if w.id not in run.deferred]
    for w in shown:
        table = registry.cells_for(w, spec, cells)
        can_share = table is None and w.sql is None and w.reads is not None and w.honours is None and not w.is_detail
        run.sources[w.id] = table.name if table else "shared" if can_share else "fact"
    sharing = [w for w in shown if run.sources[w.id] == "shared"]
    split: dict = {}
    if len(sharing) > 1:
        run.shared, split = shared_cells(base, FACT_OF[dashboard], [w.reads for w in sharing])

    def planned(w: registry.Widget) -> tuple[DataFrame, DataFrame | None]:
        if run.sources[w.id] == "shared" and split:
            frame = w.frame(split[w.reads])
        else:
            frame = registry.frame_of(w, fact, spec, base, cells)
        summary = registry.reports.attendance_summary(frame) if registry.shows_summary(w, spec, dashboard) else None
        return registry.render(dashboard, w.chart_type, frame), summary

    with ThreadPoolExecutor(max_workers=8) as pool:  # the analyzer works on several statements at a time
        for w, (report, summary) in zip(shown, pool.map(planned, shown)):
            run.reports[w.id] = report
            if summary is not None:
                run.summaries[w.id] = summary
    return run


def collect_all(run: DashboardRun, threads: int = 8) -> dict[int, list | Pages]:
    """Collect the aggregated reports of a run, submitting the jobs from several
    driver threads so Spark schedules them concurrently (as a browser fetches
    all widgets at once).  Their rows are categories and days.  Detail reports
    grow with the fact and are returned as pages, not collected.  The shared
    aggregation runs first, once, and is released at the end."""
    if run.shared is not None:
        run.shared.count()
    small = {wid: df for wid, df in run.reports.items() if wid not in run.details}
    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        futures = {wid: pool.submit(df.collect) for wid, df in small.items()}
        out: dict[int, list | Pages] = {wid: f.result() for wid, f in futures.items()}
    if run.shared is not None:
        run.shared.unpersist()
    return out | {wid: pages(df) for wid, df in run.reports.items() if wid in run.details}
