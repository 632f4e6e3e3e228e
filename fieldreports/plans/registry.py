"""Widget catalogs and chart-type dispatch for both dashboards.

A widget is a catalog row (id, name, chart type, display order, active flag)
plus either a report function ``filtered fact -> DataFrame`` with the filter
slots it honours, or stored SQL text over the unfiltered fact with filter slot
tokens where its author wanted filters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldreports.functions.constants import ATTENDANCE_TREND_WIDGET_ID, ATTENDANCE_TYPE_ORDER, IMPACT_ORDER, TIMING_ORDER
from fieldreports.functions.dates import day_header
from fieldreports.operators import pivots, reports
from fieldreports.operators.filters import AttendanceFilter, VisitFilter, employee_gate
from fieldreports.operators.order import has_order
from fieldreports.plans import widgets as W
from fieldreports.sources.cells import CellTable, smallest
from fieldreports.plans.paging import Key, Page, page, pruned
from fieldreports.plans.stored import ATTENDANCE_SLOTS, VISIT_SLOTS, bound_sql, run_stored  # noqa: F401

@dataclass(frozen=True)
class Widget:
    id: int
    name: str
    chart_type: str
    display_order: int
    is_active: bool | None
    frame: Callable[[DataFrame], DataFrame] | None = None  # filtered fact -> widget result
    honours: tuple[str, ...] | None = None  # None: every slot
    needs_user: bool = False  # employee widgets: rows only once an id is entered
    reads: tuple[str, ...] | None = None  # columns of the fact (or of its cells) that the frame groups by; None: rows
    sql: str | None = None  # stored widget: text over the unfiltered fact
    fact_table: str | None = None
    pages_by: tuple[Key, ...] = ()  # the order of a detail widget's pages

    @property
    def is_detail(self) -> bool:
        """Does the result have a row for each fact row, so that it grows with it?"""
        return self.chart_type == "table"


def sql_frame(text: str, **args) -> Callable[[DataFrame], DataFrame]:
    """A widget frame written as SQL text over ``{fact}``, the filtered fact.

    The filter is already bound as predicates on the DataFrame passed in as
    ``{fact}``; extra values are bound through named parameter markers
    (``:name`` with ``args``), never spliced into the text.  Example::

        sql_frame("SELECT region, count(*) AS cnt FROM {fact} WHERE qty >= :q GROUP BY region", q=10)
    """

    def frame(base: DataFrame) -> DataFrame:
        return base.sparkSession.sql(text, args or None, fact=base)

    return frame


def widgets_from_catalog(rows: DataFrame | Iterable[Mapping], fact_table: str, dashboard: str) -> tuple["Widget", ...]:
    """Widgets from a stored catalog (``id, widget_name, chart_type,
    display_order, is_active, sql_query``): a DataFrame, e.g. from
    ``sources.ingest.read_jdbc``, of which the active rows are read, or rows.

    Nothing is bound here; SQL is bound when its widget is looked up, so a row
    that cannot run only fails its own widget."""
    if dashboard not in DASHBOARDS:
        raise KeyError(dashboard)
    if isinstance(rows, DataFrame):
        rows = rows.where(F.col("is_active")).orderBy("display_order", "id").toLocalIterator()
    return tuple(
        Widget(int(r["id"]), r["widget_name"], r["chart_type"], r["display_order"], r["is_active"], sql=r["sql_query"], fact_table=fact_table) for r in rows
    )


ATT_ALL = AttendanceFilter.SLOTS
VIS_ALL = VisitFilter.SLOTS

ATTENDANCE_WIDGETS = (
    Widget(1, "Key Figures", "kpi", 1, True, W.att_key_figures, reads=("attendance_type", "user_id")),
    Widget(2, "Attendance Mix", "pie", 2, True, W.att_mix, reads=("attendance_type",)),
    Widget(3, "Attendance Trend", "bar", 3, True, W.att_trend, reads=("attendance_type",)),
    Widget(4, "Daily Trend", "line", 4, True, W.att_daily, reads=("date_d", "attendance_type")),
    Widget(5, "Attendance By Day", "pivot", 5, True, W.att_type_by_date, reads=("date_d", "attendance_type")),
    Widget(6, "Attendance By Region", "pivot_region", 6, True, W.att_type_by_region, reads=("region", "attendance_type")),
    Widget(7, "Check-in Timing", "pivot_timing", 7, True, W.att_timing_by_date, reads=("date_d", "timing")),
    Widget(8, "Employee Detail", "table", 8, True, W.att_employee_rows, needs_user=True, pages_by=(Key("Date", True, "date_d"), Key("User ID"))),
    Widget(9, "Salary Impact", "pivot_salary", 9, True, W.att_impact_by_date, reads=("date_d", "impact")),
    Widget(10, "Retired Widget", "bar", 10, False, W.att_trend, reads=("attendance_type",)),
    Widget(11, "Draft Widget", "pie", 11, None, W.att_mix, reads=("attendance_type",)),
    Widget(15, "Employee Profile", "profile", 0, True, W.att_employees, needs_user=True),
)

VISIT_WIDGETS = (
    Widget(1, "Channel Mix", "pie", 1, True, W.vis_channel_mix, reads=("channel_key",)),
    Widget(2, "Tier Volume", "bar", 2, True, W.vis_tier_volume, reads=("tier_key",)),
    Widget(3, "Top 10 ASE", "top10_table", 3, True, W.vis_ase_volume, reads=("region", "ase_key")),
    Widget(4, "Check-in Location", "pivot_location_in", 4, True, lambda b: W.vis_category_by_date(b, "location_in", "location"), reads=("date_key", "location_in")),
    Widget(5, "Check-out Location", "pivot_location_out", 5, True, lambda b: W.vis_category_by_date(b, "location_out", "location"), reads=("date_key", "location_out")),
    Widget(6, "Working Hours", "pivot_workhour", 6, True, lambda b: W.vis_category_by_date(b, "workhour", "workhour"), reads=("date_key", "workhour")),
    Widget(7, "Visit Detail", "table", 7, True, W.vis_detail, reads=("region", "zse_key", "ase_key", "ase_ho_id"), pages_by=(Key("region"), Key("zse"), Key("ase"))),
)

DASHBOARDS = {"attendance": ATTENDANCE_WIDGETS, "field": VISIT_WIDGETS}


def catalog(spark: SparkSession, dashboard: str) -> DataFrame:
    """Active widgets ordered by display order (NULL active flag = inactive): a
    local table, so no job runs to read it."""
    rows = [entry_of(w) for w in active(dashboard)]
    kinds = pa.schema([("id", pa.int32()), ("widget_name", pa.string()), ("chart_type", pa.string()), ("display_order", pa.int32())])
    return spark.createDataFrame(pa.Table.from_pylist(rows, kinds))


def active(dashboard: str, widgets: Iterable[Widget] | None = None) -> list[Widget]:
    """Active widgets in display order, ties by id."""
    known = widgets if widgets is not None else DASHBOARDS[dashboard]
    return sorted((w for w in known if w.is_active is True), key=lambda w: (w.display_order is None, w.display_order or 0, w.id))


def entry_of(w: Widget) -> dict:
    return {"id": w.id, "widget_name": w.name, "chart_type": w.chart_type, "display_order": w.display_order}


def lookup(dashboard: str, widget_id: int, widgets: Iterable[Widget] | None = None) -> Widget:
    """Active widget by id; ``KeyError`` when absent or inactive (not found)."""
    for w in widgets if widgets is not None else DASHBOARDS[dashboard]:
        if w.id == widget_id and w.is_active is True:
            return w
    raise KeyError(f"no active widget {widget_id} on the {dashboard} dashboard")


def has_user(spec) -> bool:
    """Is an id search entered?"""
    return isinstance(spec, AttendanceFilter) and spec.user_term() is not None


def cells_for(w: Widget, spec, tables: Iterable[CellTable]) -> CellTable | None:
    """The smallest stored cell table that can answer a widget under a filter: it
    has the columns that the widget's frame reads and those that the filter
    compares.  None: the fact is read (stored SQL, row reports, id searches)."""
    if w.sql is not None or w.reads is None:
        return None
    return smallest(tables, {*w.reads, *spec.columns(w.honours)})


def frame_of(w: Widget, fact: DataFrame, spec, base: DataFrame | None = None, cells: Iterable[CellTable] = ()) -> DataFrame:
    """A widget's result frame (first stage).  ``base`` is the fact under the
    whole filter, for widgets that honour every slot; ``cells`` are the fact's
    stored cell tables, which are read instead of it where they can be."""
    if w.sql is not None:
        return run_stored(w.sql, fact, spec, w.fact_table)
    table = cells_for(w, spec, cells)
    if table is not None:
        base = spec.apply(table.frame, w.honours)
    elif base is None or w.honours is not None:
        base = spec.apply(fact, w.honours)
    return w.frame(base.where(employee_gate(spec)) if w.needs_user else base)


def widget_data(
    fact: DataFrame, spec, dashboard: str, widget_id: int, widgets: Iterable[Widget] | None = None, cells: Iterable[CellTable] = ()
) -> DataFrame:
    """The widget's result frame under the filter (first stage)."""
    return frame_of(lookup(dashboard, widget_id, widgets), fact, spec, cells=cells)


def widget_page(
    fact: DataFrame,
    spec,
    dashboard: str,
    widget_id: int,
    size: int,
    token: str | None = None,
    order: Iterable[Key] | None = None,
    widgets: Iterable[Widget] | None = None,
    cells: Iterable[CellTable] = (),
) -> Page:
    """One page of a detail widget's finished report, after the row that ``token``
    names.  The pages are in the widget's own order, or ``order`` (columns of its
    frame; the frame's columns one by one without either)."""
    w = lookup(dashboard, widget_id, widgets)
    if not w.is_detail:
        raise ValueError(f"widget {widget_id} is a {w.chart_type}, which has no pages")
    by = w.pages_by if order is None else tuple(order)
    if w.sql is None and cells_for(w, spec, cells) is None:
        fact = pruned(fact, by, token)
    frame = frame_of(w, fact, spec, cells=cells)
    return page(frame, by, size, token, reports.cell_texts(frame.schema, dashboard))


def shows_summary(w: Widget, spec, dashboard: str) -> bool:
    """The attendance trend bar lists day counts once an id is entered."""
    return dashboard == "attendance" and w.chart_type == "bar" and w.id == ATTENDANCE_TREND_WIDGET_ID and has_user(spec)


def summary(
    fact: DataFrame, spec, dashboard: str, widget_id: int, widgets: Iterable[Widget] | None = None, cells: Iterable[CellTable] = ()
) -> DataFrame | None:
    """The day counts below a widget's chart, or None where it has none."""
    w = lookup(dashboard, widget_id, widgets)
    return reports.attendance_summary(frame_of(w, fact, spec, cells=cells)) if shows_summary(w, spec, dashboard) else None


# ------------------------------------------------------------ second stage

def _day_pivot(frame: DataFrame, row: str, preset) -> DataFrame:
    header = day_header(F.col("date"), frame.schema["date"].dataType)
    return pivots.pivot_long(frame, row, "date", preset, header, seen=has_order(frame))


def _attendance_report(chart_type: str, frame: DataFrame) -> DataFrame:
    if chart_type == "kpi":
        return reports.kpi_cards(frame)
    if chart_type == "table":
        return reports.table_cells(frame, "attendance")
    if chart_type == "bar":
        return reports.bar_series(frame)
    if chart_type == "line":
        return reports.line_series(frame)
    if chart_type == "pivot":
        return pivots.display_order(_day_pivot(frame, "attendance_type", ATTENDANCE_TYPE_ORDER), "attendance_type", "date")
    if chart_type == "pivot_region":
        return pivots.display_order(pivots.totals_cube(frame, "attendance_type", "region", seen=has_order(frame)), "attendance_type", "region", preset=ATTENDANCE_TYPE_ORDER)
    if chart_type == "pivot_timing":
        return pivots.display_order(_day_pivot(frame, "timing", TIMING_ORDER), "timing", "date")
    if chart_type == "pivot_salary":
        return pivots.display_order(pivots.percent_of_partition(_day_pivot(frame, "impact", IMPACT_ORDER), "date"), "impact", "date")
    if chart_type == "profile":
        return reports.profile_card(frame)
    return reports.pie_share(frame)  # any other chart type is drawn as a pie


def _generic_pivot(frame: DataFrame, row: str) -> DataFrame:
    return pivots.display_order(pivots.pivot_long(frame, row, "date", row_out="category"), "category", "date")


def _field_report(chart_type: str, frame: DataFrame) -> DataFrame:
    if chart_type == "pie":
        return reports.pie_share(frame)
    if chart_type == "bar":
        return reports.bar_series(frame)
    if chart_type == "table":
        return reports.table_cells(frame, "field")
    if chart_type == "top10_table":
        top = reports.top_n_per_group(frame, n=10)
        return top.orderBy(F.col(f"`{top.columns[0]}`"), "rank")
    if chart_type in ("pivot_location_in", "pivot_location_out"):
        return _generic_pivot(frame, "location")
    if chart_type == "pivot_workhour":
        return _generic_pivot(frame, "workhour")
    raise ValueError(f"Unknown chart type {chart_type!r}")


def render(dashboard: str, chart_type: str, frame: DataFrame) -> DataFrame:
    """Second-stage report for a chart type.  Unknown attendance chart types
    fall back to a pie; unknown field-activity chart types are an error."""
    if dashboard == "attendance":
        return _attendance_report(chart_type, frame)
    if dashboard == "field":
        return _field_report(chart_type, frame)
    raise KeyError(dashboard)


def report(fact: DataFrame, spec, dashboard: str, widget_id: int, widgets: Iterable[Widget] | None = None, cells: Iterable[CellTable] = ()) -> DataFrame:
    w = lookup(dashboard, widget_id, widgets)
    return render(dashboard, w.chart_type, widget_data(fact, spec, dashboard, widget_id, widgets, cells))
