"""Widget catalogs, lookup, chart-type dispatch, employee gating, full dashboard run."""

import pytest

from fieldreports.operators.filters import AttendanceFilter, VisitFilter
from fieldreports.plans import registry
from fieldreports.plans.dashboard import collect_all, run_dashboard
from fieldreports.plans.sinks import Pages


def test_catalog_active_only_ordered(spark):
    rows = registry.catalog(spark, "attendance").collect()
    ids = [r.id for r in rows]
    assert 10 not in ids and 11 not in ids  # inactive and NULL flag
    assert [r.display_order for r in rows] == sorted(r.display_order for r in rows)
    assert rows[0].id == 15
    assert registry.catalog(spark, "field").columns == ["id", "widget_name", "chart_type", "display_order"]


def test_lookup_not_found():
    assert registry.lookup("attendance", 3).chart_type == "bar"
    for wid in (10, 11, 99):
        with pytest.raises(KeyError):
            registry.lookup("attendance", wid)


def test_dispatch_fallbacks(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n long")
    pie = registry.render("attendance", "donut", frame)
    assert pie.columns == ["label", "value", "pct_tenths", "show_label"]
    with pytest.raises(ValueError):
        registry.render("field", "donut", frame)


def test_employee_widgets_gated(written_source):
    att = written_source.attendance()
    assert registry.widget_data(att, AttendanceFilter(), "attendance", 8).count() == 0
    assert registry.widget_data(att, AttendanceFilter(user_id="1"), "attendance", 8).count() > 0


def test_run_dashboards(written_source):
    run = run_dashboard(written_source.attendance(), AttendanceFilter(region="ASIA"), "attendance")
    assert run.deferred == [15, 8]
    for wid, df in run.reports.items():
        df.collect()
    assert set(run.reports) == {1, 2, 3, 4, 5, 6, 7, 9} and run.summaries == {}
    with run_dashboard(written_source.attendance(), AttendanceFilter(user_id="3"), "attendance", persist_base=True) as run2:
        assert run2.reports[15].count() > 0 and run2.summaries[3].count() > 0
        assert run2.cached.storageLevel.useMemory
        cached = run2.cached
        got = collect_all(run2)
        assert isinstance(got[8], Pages) and isinstance(got[5], list)
        assert sum(map(len, got[8])) == run2.reports[8].count()
    assert not cached.storageLevel.useMemory and run2.cached is None
    field = run_dashboard(written_source.visits(), VisitFilter(tiers=["Tier-N"]), "field")
    for wid, df in field.reports.items():
        assert df.count() >= 0
    top = field.reports[3].collect()
    assert max(r["rank"] for r in top) <= 10


def test_sql_widget_binds_fact_and_parameters(written_source):
    from fieldreports.plans.sinks import column_list, payload

    frame = registry.sql_frame(
        "SELECT attendance_type, count(*) AS cnt FROM {fact} WHERE user_id >= :lo GROUP BY attendance_type", lo=5
    )
    spec = AttendanceFilter(region="ASIA")
    att = written_source.attendance()
    got = {r.attendance_type: r.cnt for r in frame(spec.apply(att)).collect()}
    want = {r.attendance_type: r["count"] for r in spec.apply(att).where("user_id >= 5").groupBy("attendance_type").count().collect()}
    assert got == want
    pie = registry.render("attendance", "pie", frame(spec.apply(att)))
    p = payload(pie)
    assert p["columns"] == ["label", "value", "pct_tenths", "show_label"] and len(p["rows"]) == len(got)
    assert column_list(pie.orderBy("label"), "label") == sorted(got)


def stored(sql, widget_id=1, chart="table", active=True):
    return {"id": widget_id, "widget_name": f"w{widget_id}", "chart_type": chart, "display_order": widget_id, "is_active": active, "sql_query": sql}


def test_stored_sql_filters_only_where_its_slots_stand(written_source):
    att = written_source.attendance()
    sql = "SELECT count(*) AS in_region, (SELECT count(*) FROM attendance_fact) AS whole FROM attendance_fact WHERE 1=1 {region_filter} {type_filter}"
    widgets = registry.widgets_from_catalog([stored(sql)], "attendance_fact", "attendance")
    row = registry.widget_data(att, AttendanceFilter(region="ASIA"), "attendance", 1, widgets).first()
    assert row.whole == att.count() and row.in_region == att.where("region = 'ASIA'").count() < row.whole
    # no slot, no filter
    row = registry.widget_data(att, AttendanceFilter(channels=["AUTOMOBILE"]), "attendance", 1, widgets).first()
    assert row.in_region == row.whole


def test_stored_sql_of_every_slot(written_source):
    att, vis = written_source.attendance(), written_source.visits()
    slots = "{region_filter} {type_filter} {channel_filter} {ase_filter} {date_filter} {zse_filter} {atype_filter} {user_filter}"
    widgets = registry.widgets_from_catalog([stored(f"SELECT count(*) AS n FROM att_t WHERE 1=1 {slots}")], "att_t", "attendance")
    from fieldreports.plans import queries as Q

    specs = [v for k, v in vars(Q).items() if k.startswith("SPEC_") and isinstance(v, AttendanceFilter)]
    assert len(specs) > 10
    for spec in specs:
        assert registry.widget_data(att, spec, "attendance", 1, widgets).first().n == spec.apply(att).count(), spec
    slots = "{region_filter} {zse_filter} {ase_filter} {channel_filter} {tier_filter} {date_filter} {user_filter}"
    widgets = registry.widgets_from_catalog([stored(f"SELECT count(*) AS n FROM vis_t WHERE 1=1 {slots}")], "vis_t", "field")
    for spec in [v for k, v in vars(Q).items() if k.startswith("SPEC_") and isinstance(v, VisitFilter)]:
        assert registry.widget_data(vis, spec, "field", 1, widgets).first().n == spec.apply(vis).count(), spec


def test_stored_values_never_enter_the_text(written_source):
    att = written_source.attendance()
    sql = "SELECT count(*) AS n FROM attendance_fact WHERE 1=1 {region_filter} {zse_filter}"
    for value in ("{zse_filter}", "x' OR '1'='1", ":zse", "attendance_fact"):
        spec = AttendanceFilter(region=value)
        text, values = registry.bound_sql(sql, spec, "attendance_fact", "v")
        assert text == "SELECT count(*) AS n FROM v WHERE 1=1 AND region = :region " and values == {"region": value}
        assert registry.run_stored(sql, att, spec, "attendance_fact").first().n == 0


def test_table_names_and_tokens_are_found_by_lexeme():
    def b(sql):
        return registry.bound_sql(sql, AttendanceFilter(), "t_fact", "v")[0]

    assert b("SELECT * FROM t_fact WHERE 1=1 {region_filter}") == "SELECT * FROM v WHERE 1=1 "
    assert b('SELECT * FROM "t_fact" a, `t_fact`, public.t_fact, "s"."t_fact"') == "SELECT * FROM v a, v, v, v"
    assert b("SELECT t_fact.x, 't_fact {region_filter} it''s', t_fact_x FROM t_fact -- t_fact\n, t_fact_2") == (
        "SELECT v.x, 't_fact {region_filter} it''s', t_fact_x FROM v -- t_fact\n, t_fact_2"
    )
    assert b("/* t_fact */ SELECT '{\"k\": 1}' FROM t_fact") == "/* t_fact */ SELECT '{\"k\": 1}' FROM v"


def test_one_bad_row_fails_only_its_own_widget(spark, written_source):
    att = written_source.attendance()
    rows = [
        stored("SELECT no_such_column FROM attendance_fact", 1),
        stored("SELECT 1 AS one", 2),
        stored("SELECT count(*) AS n FROM attendance_fact", 3),
        stored("not sql at all", 4, active=False),
    ]
    widgets = registry.widgets_from_catalog(rows, "attendance_fact", "attendance")
    assert registry.widget_data(att, AttendanceFilter(), "attendance", 2, widgets).first().one == 1
    assert registry.widget_data(att, AttendanceFilter(), "attendance", 3, widgets).first().n == att.count()
    with pytest.raises(Exception, match="no_such_column"):
        registry.widget_data(att, AttendanceFilter(), "attendance", 1, widgets)
    with pytest.raises(KeyError):
        registry.lookup("attendance", 4, widgets)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("fact_")]


def test_stored_widgets_on_a_dashboard(written_source):
    rows = [
        stored("SELECT trim(attendance_type) AS attendance_type, count(*) AS cnt FROM attendance_fact WHERE 1=1 {type_filter} GROUP BY 1", 1, "pie"),
        stored("SELECT attendance_date AS date, trim(attendance_type) AS attendance_type, count(*) AS cnt FROM attendance_fact GROUP BY 1, 2", 2, "pivot"),
    ]
    widgets = registry.widgets_from_catalog(rows, "attendance_fact", "attendance")
    run = run_dashboard(written_source.attendance(), AttendanceFilter(types=["promoter"]), "attendance", widgets=widgets)
    assert [c["id"] for c in run.catalog] == [1, 2]
    assert run.reports[1].columns == ["label", "value", "pct_tenths", "show_label"]
    assert "col_total" in run.reports[2].columns and run.reports[2].count() > 0


def test_reports_come_in_display_order(written_source):
    att, vis = written_source.attendance(), written_source.visits()
    from fieldreports.functions.constants import ATTENDANCE_TYPE_ORDER

    cross = registry.report(att, AttendanceFilter(), "attendance", 6).collect()
    types = [r.attendance_type for r in cross if not r.g_attendance_type]
    ranks = [ATTENDANCE_TYPE_ORDER.index(t) for t in types]
    assert ranks == sorted(ranks) and [r.g_attendance_type for r in cross] == sorted(r.g_attendance_type for r in cross)
    timing = registry.report(att, AttendanceFilter(), "attendance", 7).collect()
    assert [(r.ordinal, r.date) for r in timing] == sorted((r.ordinal, r.date) for r in timing)
    generic = registry.report(vis, VisitFilter(), "field", 6).collect()
    assert [(r.category, r.date) for r in generic] == sorted((r.category, r.date) for r in generic)
    top = registry.report(vis, VisitFilter(), "field", 3).collect()
    assert [(r.region, r["rank"]) for r in top] == sorted((r.region, r["rank"]) for r in top)


def test_top_report_of_other_column_names(spark):
    frame = spark.createDataFrame([("ASIA", "A", 1.5), ("ASIA", "B", 2.5)], "Region string, `ASE Name` string, Sales double")
    got = registry.render("field", "top10_table", frame).collect()
    assert [tuple(r) for r in got] == [("ASIA", 1, "B", 2.5), ("ASIA", 2, "A", 1.5)]
