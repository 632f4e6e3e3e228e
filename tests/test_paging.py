"""Keyset pages: read one by one they are the whole result, in order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fieldreports.operators import facets as FC
from fieldreports.operators.filters import AttendanceFilter, VisitFilter
from fieldreports.plans import api, registry
from fieldreports.plans.paging import Key, page, page_frame, pruned


def all_pages(df, order, size):
    out, token = [], None
    while True:
        got = page(df, order, size, token)
        assert 0 < len(got.rows) <= size or token is None
        out.append(got.rows)
        if got.next is None:
            return out
        assert len(got.rows) == size
        token = got.next


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, ties, copies, NaN, both zeros, names that need quoting."""
    rng = random.Random(5)
    rows = [
        (
            rng.choice([None, "a", "b", "", "é"]),
            rng.choice([None, float("nan"), 0.0, -0.0, 1.5, -2.25, float("inf")]),
            rng.choice([None, dt.date(2024, 1, 5), dt.date(1999, 12, 31)]),
            rng.choice([None, dt.datetime(2024, 3, 31, 1, 30, 0, 5), dt.datetime(1970, 1, 1)]),
            rng.choice([None, True, False]),
            rng.choice([b"", b"\x00\xff"]),
        )
        for _ in range(120)
    ]
    rows += [("a", 1.5, dt.date(2024, 1, 5), None, True, b"")] * 40
    return spark.createDataFrame(rows, "`a b` string, x double, d date, t timestamp, ok boolean, raw binary").repartition(7).cache()


@pytest.mark.parametrize(
    "order, size",
    [((), 45), ((Key("x"),), 17), ((Key("x", True),), 17), ((Key("d", True), Key("a b")), 45), ((Key("t"), Key("x", True)), 45), ((Key("a b", True), Key("ok")), 45)],
)
def test_pages_join_to_the_whole(odd, order, size):
    named = [k.name for k in order]
    by = [F.col(f"`{k.name}`").desc() if k.descending else F.col(f"`{k.name}`").asc() for k in [*order, *[Key(c) for c in odd.columns if c not in named]]]
    whole = page(odd, order, odd.count()).rows
    plain = odd.withColumn("x", F.when(F.col("x") == 0, 0.0).otherwise(F.col("x"))).orderBy(*by)
    from fieldreports.plans.sinks import payload

    assert [str(r) for r in whole] == [str(r) for r in payload(plain)["rows"]]
    got = all_pages(odd, order, size)
    assert [str(r) for p in got for r in p] == [str(r) for r in whole]


def test_edges(spark, odd):
    empty = page(odd.limit(0), (), 3)
    assert empty.rows == [] and empty.next is None and empty.columns == odd.columns
    exact = page(odd, (), odd.count())
    assert exact.next is None
    same = spark.createDataFrame([(1,)] * 25, "v int")
    assert [len(p) for p in all_pages(same, (), 4)] == [4, 4, 4, 4, 4, 4, 1]
    token = page(odd, (Key("x"),), 3).next
    for bad in (lambda: page(odd, (Key("d"),), 3, token), lambda: page(odd, (), 3, "nonsense"), lambda: page(odd, (Key("none"),), 3), lambda: page(odd, (), 0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        page(spark.createDataFrame([([1],)], "v array<int>"), (), 3)


def test_rows_added_later_do_not_shift_pages(spark):
    rows = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "v int")
    first = page(rows, (), 5)
    more = rows.union(spark.createDataFrame([(1,), (3,), (9,)], "v int"))
    assert [r["v"] for r in page(more, (), 5, first.next).rows] == [9, 10, 12, 14, 16]


def test_detail_widgets_page_by_page(written_source):
    att, vis = written_source.attendance(), written_source.visits()
    for fact, spec, dashboard, widget in ((att, AttendanceFilter(user_id="1"), "attendance", 8), (vis, VisitFilter(), "field", 7)):
        rows, token = [], None
        while True:
            got = api.widget_page(fact, spec, dashboard, widget, 150, token)
            rows += got["rows"]
            token = got["next"]
            if token is None:
                break
        want = [r for p in api.widget_report(fact, spec, dashboard, widget) for r in p]
        assert len(rows) > 150 or dashboard == "field"
        assert sorted(map(str, rows)) == sorted(map(str, want))
        assert got["columns"] == list(want[0])
    with pytest.raises(ValueError):
        api.widget_page(att, AttendanceFilter(), "attendance", 2)


def test_value_pages(written_source):
    att, cells = written_source.attendance(), written_source.cells("attendance")
    whole = api.dimension_values(att, "ase")
    for tables in ((), cells):
        out, token = [], None
        while True:
            values, token = api.value_page(att, "ase", 11, token, tables)
            out += values
            if token is None:
                break
        assert out == whole


def test_a_later_page_is_pruned_at_the_scan(written_source):
    """The bound of the first column reaches the files, the year the folders."""
    vis = written_source.visits()
    by = (Key("date_d", True, "date_d"),)
    rows = vis.select("date_d", "region", "ase_key", "qty")
    token = page(rows, by, 50).next
    later = page_frame(pruned(vis, by, token).select(*rows.columns), by, 50, token)
    plan = later._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "date_d" in scan.split("PushedFilters: ")[1].split("]")[0]
    assert "year" in scan.split("PartitionFilters: ")[1].split("]")[0]
    assert page(pruned(vis, by, token).select(*rows.columns), by, 50, token).rows == page(rows, by, 50, token).rows
    by_list = FC.dimension_list(vis.withColumnRenamed("channel", "_raw"), "channel")
    second = page_frame(by_list, (), 2, page(by_list, (), 2).next)
    scan = next(line for line in second._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert "channel_key" in scan.split("PushedFilters: ")[1].split("]")[0]


def test_order_of_stored_detail_widget(spark, written_source):
    sql = "SELECT ase, qty FROM visits_fact WHERE 1=1 {region_filter}"
    catalog = spark.createDataFrame([(1, "Rows", "table", 1, True, sql)], "id int, widget_name string, chart_type string, display_order int, is_active boolean, sql_query string")
    widgets = registry.widgets_from_catalog(catalog, "visits_fact", "field")
    vis = written_source.visits()
    got = registry.widget_page(vis, VisitFilter(region="ASIA"), "field", 1, 20, order=(Key("qty", True),), widgets=widgets)
    top = [r["qty"] for r in vis.where("region = 'ASIA'").orderBy(F.desc("qty")).limit(20).collect()]
    assert [int(r["qty"]) for r in got.rows] == top and got.next
