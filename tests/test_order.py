"""Reports that depend on the order in which a frame returns its rows, and pivots of any measure."""

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fieldreports.operators import order
from fieldreports.operators import pivots as PV
from fieldreports.operators import reports as RP
from fieldreports.plans import registry


@pytest.fixture(scope="module")
def readings(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["T1", "T2", "Zeta", "Alpha", "Present"]), f"2024-01-0{r.randint(1, 4)}", r.choice([None, 0.5, 1.25, -2.0, 7.0])) for i in range(400)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "seq int, attendance_type string, date string, cnt double").repartition(7)


def last_values(rows):
    cell = {}
    for _, t, d, v in sorted(rows):
        cell[t, d] = v or 0.0
    return cell


def test_arrival_follows_the_sort(spark, readings):
    _, df = readings
    for frame in (df.orderBy("seq"), df.orderBy(F.desc("seq")).select("seq", "cnt"), df.orderBy("seq").limit(50)):
        indexed, ordered = order.with_arrival(frame)
        assert ordered
        got = [r.seq for r in indexed.orderBy(order.ARRIVAL).collect()]
        assert got == [r.seq for r in frame.collect()]


def test_what_counts_as_an_order(spark, readings):
    _, df = readings
    df.createOrReplaceTempView("readings")
    yes = [df.orderBy("seq"), spark.sql("SELECT cnt FROM readings ORDER BY seq"), spark.sql("WITH r AS (SELECT * FROM readings) SELECT * FROM r ORDER BY seq LIMIT 9")]
    no = [df, df.sortWithinPartitions("seq"), df.orderBy("seq").groupBy("date").count(), spark.sql("SELECT * FROM readings SORT BY seq")]
    assert [order.has_order(f) for f in yes + no] == [True] * len(yes) + [False] * len(no)
    spark.catalog.dropTempView("readings")


@pytest.mark.parametrize("descending", [False, True])
def test_the_last_row_of_a_cell_wins(readings, descending):
    rows, df = readings
    frame = df.orderBy(F.desc("seq") if descending else "seq").drop("seq")
    want = last_values([(-r[0], *r[1:]) for r in rows] if descending else rows)
    got = registry.render("attendance", "pivot", frame).collect()
    assert {(r.attendance_type, r.date): r.cnt for r in got} == want and len(got) == len(want)
    for r in got:
        assert r.col_total == sum(v for (_, d), v in want.items() if d == r.date)
    # preset types first, then the others as they first arrive
    first = {}
    for r in sorted(rows, reverse=descending):
        first.setdefault(r[1], len(first))
    types = list(dict.fromkeys(r.attendance_type for r in got))
    assert types == ["Present"] + sorted((t for t in first if t != "Present"), key=first.get)


def test_repeated_cells_without_an_order_take_the_largest(readings):
    rows, df = readings
    cells = defaultdict(list)
    for _, t, d, v in rows:
        cells[t, d].append(v or 0.0)
    got = {(r.t, r.d): r.cnt for r in PV.last_cells(df.select(F.col("attendance_type").alias("t"), F.col("date").alias("d"), "cnt"), "t", "d").collect()}
    assert got == {k: max(v) for k, v in cells.items()}


def test_cross_tab_totals_are_of_last_values(readings):
    rows, df = readings
    frame = df.orderBy("seq").select("attendance_type", F.col("date").alias("region"), "cnt")
    want = last_values(rows)
    got = registry.render("attendance", "pivot_region", frame).collect()
    assert next(r.cnt for r in got if r.g_region and r.g_attendance_type) == sum(want.values())
    for r in got:
        if r.g_region and not r.g_attendance_type:
            assert r.cnt == sum(v for (t, _), v in want.items() if t == r.attendance_type)
    assert "_seen" not in got[0].asDict()


def test_top_ten_as_returned(spark):
    rows = [("A", f"x{i:02}", float(i % 7)) for i in range(30)] + [("B", "y", None)]
    df = spark.createDataFrame(rows, "region string, ase string, qty double").repartition(5)
    up = registry.render("field", "top10_table", df.orderBy("qty", "ase")).collect()
    want = sorted((r for r in rows if r[0] == "A"), key=lambda r: (r[2], r[1]))[:10]
    assert [(r.region, r["rank"], r.ase, r.value) for r in up] == [("A", i + 1, w[1], w[2]) for i, w in enumerate(want)] + [("B", 1, "y", 0.0)]
    down = registry.render("field", "top10_table", df).collect()
    want = sorted((r for r in rows if r[0] == "A"), key=lambda r: (-r[2], r[1]))[:10]
    assert [(r["rank"], r.ase) for r in down if r.region == "A"] == [(i + 1, w[1]) for i, w in enumerate(want)]


def test_cells_keep_their_numbers(spark):
    rows = [("a", "2024-01-01", "0.6"), ("b", "2024-01-01", "0.7"), ("a", "2024-01-02", None)]
    text = spark.createDataFrame(rows, "impact string, date string, v string")
    for kind, number in (("double", float), ("decimal(9,3)", Decimal)):
        frame = text.select("impact", "date", F.col("v").cast(kind).alias("cnt"))
        got = {(r.impact, r.date): (r.cnt, round(r.col_total, 9), r.pct) for r in registry.render("attendance", "pivot_salary", frame).collect()}
        assert got["a", "2024-01-01"] == (number("0.6"), number("1.3"), 46) and got["b", "2024-01-01"] == (number("0.7"), number("1.3"), 54)
        assert got["a", "2024-01-02"] == (0, 0, 0)
        wide = {r.impact: r for r in PV.to_wide(frame, "impact", "date", ["2024-01-01", "2024-01-02"]).collect()}
        assert wide["a"]["2024-01-01"] == number("0.6") and wide["b"]["2024-01-02"] == 0
        dense = {(r.impact, r.date): r.cnt for r in PV.dense_grid(frame, "impact", "date").collect()}
        assert dense["b", "2024-01-02"] == 0 and dense["b", "2024-01-01"] == number("0.7") and len(dense) == 4
    counts = registry.render("attendance", "pivot_salary", text.select("impact", "date", F.lit(2).alias("cnt")))
    assert dict(counts.dtypes)["cnt"] == "bigint" and dict(counts.dtypes)["col_total"] == "bigint"


def test_not_a_number_counts_zero(spark):
    frame = spark.createDataFrame([("a", float("nan")), ("b", 3.0), ("c", None), ("d", 1.0)], "label string, count double")
    got = {r.label: (r.value, r.pct_tenths) for r in RP.pie_share(frame).collect()}
    assert got == {"a": (0.0, 0), "b": (3.0, 750), "c": (0.0, 0), "d": (1.0, 250)}
    cells = frame.select(F.col("label").alias("location"), F.lit("x").alias("date"), F.col("count").alias("cnt"))
    assert {r.cnt for r in registry.render("field", "pivot_location_in", cells).collect()} == {0.0, 1.0, 3.0}


def test_headers_of_days_that_are_no_iso_text(spark):
    days = ["2024-01-05", "2024-01-05T10:00:00", "15-Mar-97", "Week 3", "2024-13-45", "", None]
    frame = spark.createDataFrame([("Present", d, 1) for d in days], "attendance_type string, date string, cnt long")
    got = {r.date: r.header for r in registry.render("attendance", "pivot", frame).collect()}
    assert got == {days[0]: "05-Jan(Fri)", days[1]: "05-Jan(Fri)", "15-Mar-97": "15-Mar-97", "Week 3": "Week 3", "2024-13-45": "2024-13-45", "": "", None: None}
    dated = frame.where("date = '2024-01-05'").withColumn("date", F.col("date").cast("date"))
    assert [r.header for r in registry.render("attendance", "pivot", dated).collect()] == ["05-Jan(Fri)"]


def test_last_cells_of_aggregated_cells_shuffle_nothing_more(readings):
    _, df = readings
    cells = df.groupBy("attendance_type", "date").agg(F.count("*").alias("cnt"))
    plan = PV.last_cells(cells, "attendance_type", "date")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
