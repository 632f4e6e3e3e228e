"""One call per data endpoint of the dashboards, returning plain Python data.

Each is a Spark job over the (filtered) fact.  Dimension lists and aggregated
reports come back whole; results that grow with the fact (detail tables) come
back as :class:`~fieldreports.plans.sinks.Pages`, read page by page, or one page
at a time by ``widget_page`` and ``value_page``.  No call has a row limit.

``widgets`` is a tuple of widgets for dashboards whose catalog is stored (see
``registry.widgets_from_catalog``); the built-in set is used otherwise.  ``cells``
are the fact's stored cell tables (``FactSource.cells``), which answer what they can.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from fieldreports.operators import facets as FC
from fieldreports.operators.filters import AttendanceFilter, VisitFilter
from fieldreports.plans import paging, registry
from fieldreports.sources.cells import CellTable
from fieldreports.plans.sinks import Pages, column_list, pages, payload


def widgets(dashboard: str, widgets: Iterable[registry.Widget] | None = None) -> list[dict]:
    """Active widgets in display order: id, widget_name, chart_type, display_order."""
    return [registry.entry_of(w) for w in registry.active(dashboard, widgets)]


def dimension_values(fact: DataFrame, dim: str, cells: Iterable[CellTable] = ()) -> list:
    """Sorted distinct options of one attendance dimension."""
    return column_list(FC.dimension_list(fact, dim, cells=cells), dim)


def zse_ase_map(fact: DataFrame, cells: Iterable[CellTable] = ()) -> list[dict]:
    """Sorted distinct (zse, ase) pairs as records."""
    return payload(FC.zse_ase_pairs(fact, cells))["rows"]


def filter_options(fact: DataFrame, spec: AttendanceFilter | VisitFilter, cells: Iterable[CellTable] = ()) -> dict[str, list]:
    """The seven option lists under the filter (an empty list for an empty facet).

    One pass over the fact; the sorted options are read one partition at a time
    and grouped here, so no task gathers a whole list."""
    facets = FC.VISIT_FACETS if isinstance(spec, VisitFilter) else FC.ATTENDANCE_FACETS
    out: dict[str, list] = {f.name: [] for f in facets}
    for row in FC.option_lists(FC.facets_long(fact, spec, cells=cells)).toLocalIterator():
        out[row["facet"]].append(row["value"])
    return out


def value_page(fact: DataFrame, dim: str, size: int, token: str | None = None, cells: Iterable[CellTable] = ()) -> tuple[list, str | None]:
    """One page of a dimension's sorted options, and the token of the next one."""
    found = paging.page(FC.dimension_list(fact, dim, cells=cells), (), size, token)
    return [r[dim] for r in found.rows], found.next


def _result(df: DataFrame, paged: bool) -> dict | Pages:
    return pages(df) if paged else payload(df)


def widget_data(
    fact: DataFrame, spec, dashboard: str, widget_id: int, widgets: Iterable[registry.Widget] | None = None, cells: Iterable[CellTable] = ()
) -> dict | Pages:
    """``{columns, rows}`` of a widget's result (first stage), pages for detail
    widgets; ``KeyError`` if the widget is absent or inactive."""
    w = registry.lookup(dashboard, widget_id, widgets)
    return _result(registry.widget_data(fact, spec, dashboard, widget_id, widgets, cells), w.is_detail)


def widget_report(
    fact: DataFrame, spec, dashboard: str, widget_id: int, widgets: Iterable[registry.Widget] | None = None, cells: Iterable[CellTable] = ()
) -> dict | Pages:
    """``{columns, rows}`` of a widget's finished report (both stages); with
    ``summary`` (rows of day counts) where the report has one."""
    w = registry.lookup(dashboard, widget_id, widgets)
    out = _result(registry.report(fact, spec, dashboard, widget_id, widgets, cells), w.is_detail)
    extra = registry.summary(fact, spec, dashboard, widget_id, widgets, cells)
    return out if extra is None else out | {"summary": payload(extra)["rows"]}


def widget_page(
    fact: DataFrame,
    spec,
    dashboard: str,
    widget_id: int,
    size: int = 10_000,
    token: str | None = None,
    widgets: Iterable[registry.Widget] | None = None,
    cells: Iterable[CellTable] = (),
) -> dict:
    """``{columns, rows, next}``: one page of a detail widget's finished report;
    ``next`` asks for the page after it, in any later call or session."""
    found = registry.widget_page(fact, spec, dashboard, widget_id, size, token, widgets=widgets, cells=cells)
    return {"columns": found.columns, "rows": found.rows, "next": found.next}
