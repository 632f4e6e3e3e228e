"""Endpoint-style calls over the written facts."""

import pytest

from fieldreports.operators.filters import AttendanceFilter, VisitFilter
from fieldreports.plans import api, registry
from fieldreports.plans.sinks import Pages


def test_lists_and_options(spark, written_source):
    att = written_source.attendance()
    regions = api.dimension_values(att, "region")
    assert regions == sorted(regions) and len(regions) == 5
    assert api.dimension_values(att, "type") == ["PROMOTER", "Promoter", "Supervisor"]
    pairs = api.zse_ase_map(att)
    assert pairs and set(pairs[0]) == {"zse", "ase"}
    opts = api.filter_options(att, AttendanceFilter(region=regions[0]))
    assert list(opts) == ["regions", "types", "channels", "ases", "zses", "atypes", "user_ids"]
    assert opts["regions"] == [regions[0]]
    vopts = api.filter_options(written_source.visits(), VisitFilter(tiers=["Tier-N"]))
    assert vopts["tiers"] == ["Tier-N"] and vopts["dates"] == sorted(vopts["dates"])
    empty = api.filter_options(att, AttendanceFilter(region="nowhere"))
    assert all(v == [] for v in empty.values())


def test_options_are_complete_in_one_pass(spark, written_source):
    """Every id comes back, sorted, and the fact is scanned once."""
    att = written_source.attendance()
    opts = api.filter_options(att, AttendanceFilter())
    assert opts["user_ids"] == sorted(str(r.user_id) for r in att.select("user_id").distinct().collect())
    from fieldreports.operators import facets as FC

    plan = FC.option_lists(FC.facets_long(att))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_widgets_and_widget_payloads(spark, written_source):
    ws = api.widgets("attendance")
    assert [w["display_order"] for w in ws] == sorted(w["display_order"] for w in ws)
    att = written_source.attendance()
    data = api.widget_data(att, AttendanceFilter(), "attendance", 5)
    assert data["columns"] == ["date", "attendance_type", "cnt"]
    rep = api.widget_report(att, AttendanceFilter(), "attendance", 5)
    assert rep["columns"] == ["attendance_type", "ordinal", "date", "header", "cnt", "col_total"]
    keys = [(r["ordinal"], r["date"]) for r in rep["rows"]]
    assert keys == sorted(keys)
    with pytest.raises(KeyError):
        api.widget_data(att, AttendanceFilter(), "attendance", 10)


def test_detail_widgets_come_as_pages(spark, written_source):
    att = written_source.attendance()
    spec = AttendanceFilter(user_id="1")
    out = api.widget_report(att, spec, "attendance", 8)
    assert isinstance(out, Pages) and out.columns[0] == "Profile Picture"
    assert sum(len(p) for p in out) == spec.apply(att).count() > 0


def test_trend_bar_lists_days_once_an_id_is_entered(written_source):
    att = written_source.attendance()
    assert "summary" not in api.widget_report(att, AttendanceFilter(), "attendance", 3)
    rep = api.widget_report(att, AttendanceFilter(user_id="1"), "attendance", 3)
    assert {(r["attendance_type"], r["days"]) for r in rep["summary"]} == {(r["label"], r["value"]) for r in rep["rows"]}


def test_stored_catalog_reaches_the_calls(spark, written_source):
    catalog = spark.createDataFrame(
        [
            (7, "Second", "bar", 2, True, "SELECT region, count(*) AS cnt FROM attendance_fact WHERE 1=1 {region_filter} GROUP BY region"),
            (8, "First", "pie", 1, True, "SELECT trim(type) AS t, count(*) AS cnt FROM attendance_fact GROUP BY 1"),
            (9, "Off", "pie", 3, False, "nonsense"),
        ],
        "id int, widget_name string, chart_type string, display_order int, is_active boolean, sql_query string",
    )
    widgets = registry.widgets_from_catalog(catalog, "attendance_fact", "attendance")
    assert [w["id"] for w in api.widgets("attendance", widgets)] == [8, 7]
    att = written_source.attendance()
    rep = api.widget_report(att, AttendanceFilter(region="ASIA"), "attendance", 7, widgets)
    assert rep["rows"] == [{"label": "ASIA", "value": att.where("region = 'ASIA'").count()}]
    with pytest.raises(KeyError):
        api.widget_data(att, AttendanceFilter(), "attendance", 9, widgets)
