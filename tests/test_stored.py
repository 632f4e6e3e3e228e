"""Stored widget SQL: where slots are bound to normalised columns, and that rows stay equal."""

import re

import pytest

from fieldreports.operators.filters import AttendanceFilter, VisitFilter
from fieldreports.plans import queries as Q
from fieldreports.plans import stored

ATT = AttendanceFilter(region="ASIA", types=("promoter", "Supervisor", ""), date_from="2024-01-05", date_to="2024-01-20", user_id="1")
VIS = VisitFilter(date="15-Mar-97", date_from="1997-01-01", date_to="1997-12-31", tiers=("Tier-N",))


def scans(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in line]


def places(fact, sql, spec, table="t_fact"):
    from pyspark.sql import functions as F

    if "date_txt" in fact.columns:
        fact = fact.withColumn("date", F.col("date_txt"))
    fact.createOrReplaceTempView("placed")
    try:
        return sorted(stored.keyed_places(fact.sparkSession, sql, spec, table, "placed"))
    finally:
        fact.sparkSession.catalog.dropTempView("placed")


def test_scans_of_stored_widgets_prune(spark, written_source):
    kept = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        (mix,) = scans(Q.stored_widget_region_mix(written_source))
        assert re.search(r"PartitionFilters: \[[^\]]*year#\d+ >= 2024[^\]]*year#\d+ <= 2024", mix) and "GreaterThanOrEqual(date_d,2024-01-10)" in mix
        share = scans(Q.stored_widget_share(written_source))
        assert any("In(type_ci, [promoter,supervisor])" in s for s in share) and len(share) == 2
        parts = next(s for s in scans(Q.stored_widget_two_parts(written_source)) if "PushedFilters: []" not in s)
        assert "In(channel_key, [AUTOMOBILE,BUILDING])" in parts and "In(atype_key, [Leave,Present])" in parts.replace("[Present,Leave]", "[Leave,Present]")
        assert re.search(r"PartitionFilters: \[[^\]]*year#\d+ <= 2024", parts)
        (visits,) = scans(Q.stored_widget_visits(written_source))
        assert re.search(r"PartitionFilters: \[[^\]]*year#\d+ >= 1996[^\]]*year#\d+ <= 1997", visits) and "In(tier_key, [Tier-N,Tier-R])" in visits
        (day,) = scans(Q.stored_widget_text_day(written_source))
        assert re.search(r"PartitionFilters: \[[^\]]*year#\d+ <=> 1997", day) and "EqualTo(date_key,15-Mar-97)" in day and "EqualNullSafe(date_d,1997-03-15)" in day
        (raw,) = scans(Q.stored_widget_raw_subquery(written_source))
        assert "type_ci" not in raw and "PartitionFilters: []" in raw
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", kept)


SLOTTED = {
    "plain": ("SELECT count(*) AS n FROM t_fact WHERE 1=1 {type_filter} {date_filter}", [0, 1]),
    "alias": ("SELECT count(*) AS n FROM t_fact AS f WHERE 1=1 {type_filter} {date_filter}", [0, 1]),
    "star": ("SELECT count(*) AS n FROM (SELECT * FROM t_fact) s WHERE 1=1 {type_filter} {date_filter}", [0, 1]),
    "raw only": ("SELECT count(*) AS n FROM (SELECT type, attendance_date FROM t_fact) s WHERE 1=1 {type_filter} {date_filter}", []),
    "one visible": ("SELECT count(*) AS n FROM (SELECT type, type_ci, attendance_date FROM t_fact) s WHERE 1=1 {type_filter} {date_filter}", [0]),
    "redefined": (
        "SELECT count(*) AS n FROM (SELECT 'Promoter' AS type, type_ci, attendance_date, date_d, year FROM t_fact) s WHERE 1=1 {type_filter} {date_filter}",
        [1],
    ),
    "key redefined": ("SELECT count(*) AS n FROM (SELECT type, 'x' AS type_ci, attendance_date FROM t_fact) s WHERE 1=1 {type_filter} {date_filter}", []),
    "two readings": (
        "WITH a AS (SELECT count(*) AS n FROM t_fact), b AS (SELECT region, count(*) AS k FROM t_fact WHERE 1=1 {type_filter} {date_filter} GROUP BY region) "
        "SELECT n, region, k FROM a JOIN b ON n >= k",
        [0, 1],
    ),
    "scalar": ("SELECT (SELECT count(*) FROM t_fact WHERE 1=1 {type_filter}) AS n, count(*) AS k FROM t_fact WHERE 1=1 {date_filter}", [0, 1]),
    "inactive": ("SELECT count(*) AS n FROM t_fact WHERE 1=1 {channel_filter} {type_filter} /* {date_filter} */", [1]),
    "union": ("SELECT region FROM t_fact WHERE 1=1 {type_filter} UNION ALL SELECT region FROM t_fact WHERE 1=1 {date_filter}", [0, 1]),
}


@pytest.mark.parametrize("case", SLOTTED)
def test_places_that_use_normalised_columns(spark, written_source, case):
    sql, keyed = SLOTTED[case]
    att = written_source.attendance()
    assert places(att, sql, ATT) == keyed
    # the same rows as with raw predicates everywhere
    att.createOrReplaceTempView("raw_rows")
    text, values = stored.bound_sql(sql, ATT, "t_fact", "raw_rows")
    from pyspark.sql import functions as F

    want = spark.sql(text, {k: F.lit(v) for k, v in values.items()}).collect()
    got = stored.run_stored(sql, att, ATT, "t_fact").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and want
    spark.catalog.dropTempView("raw_rows")


def test_places_of_text_dates(written_source):
    vis = written_source.visits()
    assert places(vis, "SELECT 1 AS one FROM t_fact WHERE 1=1 {date_filter} {tier_filter}", VIS) == [0, 1]
    assert places(vis, "SELECT 1 AS one FROM (SELECT date, tier FROM t_fact) s WHERE 1=1 {date_filter} {tier_filter}", VIS) == []
    assert places(vis, "SELECT no_such FROM t_fact WHERE 1=1 {date_filter}", VIS) == []  # the statement's own error comes when it is run


def test_a_raw_fact_keeps_raw_predicates(spark, written_source):
    raw = written_source.attendance().select("region", "type", "attendance_date", "user_id")
    sql = "SELECT count(*) AS n FROM t_fact WHERE 1=1 {region_filter} {type_filter} {date_filter} {user_filter}"
    assert places(raw, sql, ATT) == [0]  # region has no other form
    assert stored.run_stored(sql, raw, ATT, "t_fact").first().n == ATT.apply(written_source.attendance()).count()


def test_many_values_are_bound_one_by_one():
    spec = AttendanceFilter(types=[f"T{i}" for i in range(30)] + ["x') OR 1=1 --"])
    text, values = stored.bound_sql("SELECT 1 FROM t_fact WHERE 1=1 {type_filter}", spec, "t_fact", "v", frozenset([0]))
    assert text.count(":type_") == 31 and sorted(values.values()) == sorted(spec.values()["type"]) and "OR 1=1" not in text
