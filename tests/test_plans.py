"""Plan-shape checks: the physical plans we want, on both fact paths."""

import contextlib
import io
import re


import __spark_entry__ as E
from fieldreports.operators.filters import AttendanceFilter, VisitFilter
from fieldreports.plans import queries as Q

from .conftest import SF_SMALL


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_no_cross_join_or_python_in_any_query(spark, written_source):
    from fieldreports.sources import FactSource

    lazy = FactSource(spark, SF_SMALL)
    for name, fn in Q.QUERIES.items():
        for src in (lazy, written_source):
            p = plan(fn(src), "simple")
            for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "SortAggregate"):
                assert bad not in p, (name, bad)


def test_top10_uses_partial_window_group_limit(written_source):
    p = plan(Q.top10_region_ase(written_source))
    assert "WindowGroupLimit" in p


def test_filters_push_down_on_written_fact(written_source):
    att = written_source.attendance()
    p = plan(AttendanceFilter(channels=["AUTOMOBILE"], region="ASIA").apply(att))
    assert "PushedFilters: [IsNotNull(region), IsNotNull(channel_key), EqualTo(region,ASIA), EqualTo(channel_key,AUTOMOBILE)]" in p or (
        "EqualTo(channel_key,AUTOMOBILE)" in p and "EqualTo(region,ASIA)" in p
    )
    vis = written_source.visits()
    p2 = plan(VisitFilter(date_from="1996-01-01", date_to="1996-12-31").apply(vis))
    assert "PartitionFilters: [isnotnull(year" in p2 and "(year#" in p2
    assert "GreaterThanOrEqual(date_d,1996-01-01)" in p2


def test_long_facets_never_single_partition(written_source):
    from fieldreports.operators.facets import facets_long

    for spec in (AttendanceFilter(), AttendanceFilter(region="ASIA", date_from="2024-01-02")):
        p = plan(facets_long(written_source.attendance(), spec))
        assert "SinglePartition" not in p
        assert "HashAggregate" in p


def test_daily_fixture_aggregate_is_hash_based(spark):
    from fieldreports.sources import fixtures

    p = plan(fixtures.attendance(spark, SF_SMALL), "simple")
    assert "SortAggregate" not in p


def test_dense_grid_is_lazy_and_scans_the_fact_once(spark, written_source):
    written_source.attendance()
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "no job may run while the grid is planned")
    try:
        df = Q.pivot_attendance_dense(written_source)
        assert list(status.getJobIdsForGroup("planning")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    df.collect()
    # the cells are used three times, always as the same columns of the fact, so
    # that two of the three exchanges are reused and one scan runs
    text = df._jdf.queryExecution().executedPlan().toString()
    schemas = set(re.findall(r"ReadSchema: (struct<[^>]*>)", text))
    assert schemas == {"struct<attendance_type:string,date_d:date>"}, text
    assert text.count("ReusedExchange") >= 2, text


def test_dimension_guards_reach_the_scan(written_source):
    p = plan(Q.dim_channels(written_source))
    assert "IsNotNull(channel_key)" in p and "Not(EqualTo(channel_key,))" in p


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["attendance_type", "region", "cnt", "g_attendance_type", "g_region"]
