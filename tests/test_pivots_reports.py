"""Pivot invariants and second-stage reports on small hand-made frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldreports.functions.bands import impact_band, ordinal_of, timing_band, workhour_band, workhour_labels
from fieldreports.functions.constants import ATTENDANCE_TYPE_ORDER
from fieldreports.functions.numeric import pct_int, pct_tenths
from fieldreports.operators import pivots as PV
from fieldreports.operators import reports as RP
from fieldreports.plans.sinks import column_list, export_name, export_report, pages, payload, payload_columns, payload_rows


@pytest.fixture(scope="module")
def facts(spark):
    rows = []
    for i in range(40):
        rows.append((f"T{i % 3}", f"2024-01-0{1 + i % 4}", "R" + str(i % 2), i))
    return spark.createDataFrame(rows, "t string, d string, r string, v long")


def cell_counts(df, row, col):
    return df.groupBy(row, col).agg(F.count(F.lit(1)).alias("cnt"))


def crosstab(df, row, col):
    return PV.totals_cube(cell_counts(df, row, col), row, col)


def test_totals_match_cells(spark, facts):
    cells = cell_counts(facts, "t", "d")
    out = PV.with_col_totals(cells, "d").collect()
    by_day = {}
    for r in out:
        by_day.setdefault(r.d, []).append(r)
    for day, rs in by_day.items():
        assert sum(r.cnt for r in rs) == rs[0].col_total
    assert sum(r.cnt for r in out) == 40


def test_crosstab_cube_totals(spark, facts):
    ct = crosstab(facts, "t", "r").collect()
    grand = [r for r in ct if r.g_t == 1 and r.g_r == 1]
    assert len(grand) == 1 and grand[0].cnt == 40
    row_totals = sum(r.cnt for r in ct if r.g_t == 0 and r.g_r == 1)
    col_totals = sum(r.cnt for r in ct if r.g_t == 1 and r.g_r == 0)
    cells = sum(r.cnt for r in ct if r.g_t == 0 and r.g_r == 0)
    assert row_totals == col_totals == cells == 40


def test_crosstab_null_key_distinct_from_total(spark):
    df = spark.createDataFrame([("A", None), ("A", "X")], "t string, r string")
    ct = crosstab(df, "t", "r").collect()
    null_cell = [r for r in ct if r.r is None and r.g_r == 0 and r.g_t == 0]
    assert len(null_cell) == 1 and null_cell[0].cnt == 1


def test_dense_grid_and_wide(spark, facts):
    cells = cell_counts(facts.where((F.col("t") != "T0") & ~((F.col("t") == "T1") & (F.col("d") == "2024-01-02"))), "t", "d")
    days = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]
    dense = PV.dense_grid(cells, "t", "d").collect()
    assert {(r.t, r.d) for r in dense} == {(t, d) for t in ("T1", "T2") for d in days} and len(dense) == 8
    assert next(r.cnt for r in dense if (r.t, r.d) == ("T1", "2024-01-02")) == 0
    wide = PV.to_wide(cells, "t", "d", days).collect()
    assert sum(sum(r[d] for d in days) for r in wide) == sum(r.cnt for r in dense)


def test_wide_rejects_keys_that_are_not_listed(spark):
    cells = spark.createDataFrame([("a", "2024-01-01", 2), ("a", "2024-01-02", 5)], "t string, d string, cnt long")
    with pytest.raises(Exception, match="column key not listed: 2024-01-02"):
        PV.to_wide(cells, "t", "d", ["2024-01-01"]).collect()


def test_dedupe_last_wins(spark):
    df = spark.createDataFrame([("a", "x", 1, 1), ("a", "x", 7, 3), ("a", "x", 5, 2), ("b", "x", 2, 1)], "r string, c string, cnt long, seq long")
    got = {(r.r, r.c): r.cnt for r in PV.dedupe_last(df, "r", "c", "seq").collect()}
    assert got == {("a", "x"): 7, ("b", "x"): 2}


def test_percentages_integer_half_up(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (0, 0), (5, 200), (1, 0)], "v long, t long")
    got = [(r.a, r.b) for r in df.select(pct_tenths("v", "t").alias("a"), pct_int("v", "t").alias("b")).collect()]
    assert got == [(125, 13), (333, 33), (0, 0), (25, 3), (0, 100)]


def test_percentages_are_exact_for_large_totals(spark):
    rows = [(v, t) for t in (10**15 + 7, 3 * 10**17 + 1, 9 * 10**18) for v in (1, t // 3, t // 2, t // 2000, t // 2000 + 1, t - 1, t, 3 * (t // 2000))]
    df = spark.createDataFrame(rows, "v long, t long")
    got = [tuple(r) for r in df.select("v", "t", pct_tenths("v", "t"), pct_int("v", "t")).collect()]
    assert sorted(got) == sorted((v, t, (2000 * v + t) // (2 * t), (200 * v + t) // (2 * t)) for v, t in rows)


def test_percentages_of_decimals_and_doubles(spark):
    kind = T.DecimalType(12, 3)
    df = spark.createDataFrame([("0.125", "1.000"), ("0.005", "10.000"), ("-0.125", "1.000"), ("1.000", "0.000")], "v string, t string")
    df = df.select(F.col("v").cast(kind).alias("v"), F.col("t").cast(kind).alias("t"))
    assert [r[0] for r in df.select(pct_tenths("v", "t", kind)).collect()] == [125, 1, -125, 0]
    assert [r[0] for r in df.select(pct_int("v", "t", kind)).collect()] == [13, 0, -13, 100]
    two = spark.createDataFrame([(0.4, 3.5), (0.6, 3.5), (2.5, 3.5)], "v double, t double")
    assert [r[0] for r in two.select(pct_tenths("v", "t", T.DoubleType())).collect()] == [114, 171, 714]


def test_fractional_measures_keep_their_values(spark):
    pie = RP.pie_share(spark.createDataFrame([("a", 0.4), ("b", 0.6), ("c", 2.5), ("d", None)], "k string, v double"))
    assert sorted(tuple(r) for r in pie.collect()) == [("a", 0.4, 114, 1), ("b", 0.6, 171, 1), ("c", 2.5, 714, 1), ("d", 0.0, 0, 0)]
    line = RP.line_series(spark.createDataFrame([("2024-01-01", 97.6, 3)], "date string, rate double, n long"))
    assert sorted((r.series, r.value) for r in line.collect()) == [("n", 3.0), ("rate", 97.6)]
    days = RP.attendance_summary(spark.createDataFrame([("Present", 0.5), ("Leave", 1.0)], "`Attendance Type` string, Days double"))
    assert sorted(tuple(r) for r in days.collect()) == [("Leave", 1.0, "day"), ("Present", 0.5, "days")]
    top = RP.top_n_per_group(spark.createDataFrame([("R", "x", 10.2), ("R", "y", 10.9)], "region string, ase string, rate double"))
    assert [(r["rank"], r.ase, r.value) for r in top.orderBy("rank").collect()] == [(1, "y", 10.9), (2, "x", 10.2)]


def test_top_roles():
    s = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
    r = RP.resolve_top_roles(s("Sales", "ASE Name", "Region"))
    assert (r.group, r.item, r.value) == ("Region", "ASE Name", "Sales")
    r = RP.resolve_top_roles(s("zone", "person", "amount"))
    assert (r.group, r.item, r.value) == ("zone", "person", "amount")
    with pytest.raises(ValueError):
        RP.resolve_top_roles(s("a", "b"))


def test_kpi_takes_the_first_row_returned(spark):
    df = spark.createDataFrame([("x", 1), ("y", 9)], "k string, n long")
    assert {r.label: r.value for r in RP.kpi_cards(df.orderBy(F.desc("n"))).collect()} == {"k": "y", "n": "9"}
    df.createOrReplaceTempView("kpi_rows")
    ordered = spark.sql("SELECT n, k FROM kpi_rows ORDER BY n DESC")
    assert {r.label: r.value for r in RP.kpi_cards(ordered).collect()} == {"k": "y", "n": "9"}
    assert {r.label: r.value for r in RP.kpi_cards(df).collect()} == {"k": "x", "n": "1"}  # no order of its own


def test_axis_labels(spark):
    df = spark.createDataFrame([("2024-01-05T10:00:00", 1), ("2024-01-05", 2), ("2024-13-99T", 3), ("Jan", 4)], "date string, n long")
    assert [r.axis for r in RP.line_series(df).orderBy("value").collect()] == ["5-Jan-24", "2024-01-05", "2024-13-99T", "Jan"]
    day = spark.createDataFrame([(dt.date(2024, 1, 5), 1)], "date date, n long")
    assert [(r.x, r.axis) for r in RP.line_series(day).collect()] == [("2024-01-05", "5-Jan-24")]


def test_number_text(spark):
    values = [45.0, 1.2345678e7, 0.5, -3.25, 0.0, 1e-7, 1.5e-7, 1e21, 123456789.125, 1e20, 0.1 + 0.2]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    for style in ("attendance", "field"):
        got = [r.x for r in RP.table_cells(df, style).orderBy(F.col("i").cast("int")).collect()]
        assert got == ["45", "12345678", "0.5", "-3.25", "0", "1e-7", "1.5e-7", "1e+21", "123456789.125", "100000000000000000000", "0.30000000000000004"]
    dec = spark.createDataFrame([("45.00",), ("1.50",), ("100",)], "x string").select(F.col("x").cast("decimal(10,2)").alias("x"))
    assert [r.x for r in RP.table_cells(dec, "field").collect()] == ["45", "1.5", "100"]


def test_ordinal_unknown_is_null(spark):
    df = spark.createDataFrame([("Present",), ("Other",), ("Mystery",)], "c string")
    got = [r.o for r in df.select(ordinal_of("c", ATTENDANCE_TYPE_ORDER).alias("o")).collect()]
    assert got == [1, 11, None]


def test_bands(spark):
    ts = dt.datetime
    rows = [
        (None, None),
        (ts(2024, 1, 1, 9, 59), None),
        (ts(2024, 1, 1, 10, 0), ts(2024, 1, 1, 19, 0)),
        (ts(2024, 1, 1, 12, 30), ts(2024, 1, 1, 17, 0)),
        (ts(2024, 1, 1, 14, 0), ts(2024, 1, 1, 18, 29, 59)),
    ]
    df = spark.createDataFrame(rows, "ci timestamp_ntz, co timestamp_ntz")
    got = [(r.t, r.i) for r in df.select(timing_band("ci").alias("t"), impact_band("ci", "co").alias("i")).collect()]
    assert got == [
        ("Not Check in", "Not Check in"),
        ("Before 10 AM", "No Check-Out (LOP)"),
        ("10 AM To 12 Noon", "9 Hrs (Full Day)"),
        ("12 Noon To 2 PM", "4.5-9 Hrs (Half Day)"),
        ("After 2 PM", "Below 4.5 Hrs"),
    ]
    assert workhour_labels((4, 6, 8)) == ["Below 4 Hrs", "4-6 Hrs", "6-8 Hrs", "8 Hrs & Above"]
    h = spark.createDataFrame([(3.9,), (4.0,), (7.99,), (8.0,), (None,)], "h double")
    assert [r.b for r in h.select(workhour_band("h").alias("b")).collect()] == ["Below 4 Hrs", "4-6 Hrs", "6-8 Hrs", "8 Hrs & Above", None]


def test_roles_from_schema():
    s = T.StructType([T.StructField("day", T.StringType()), T.StructField("n", T.LongType()), T.StructField("count_x", T.LongType())])
    r = RP.resolve_roles(s)
    assert (r.label, r.value, r.date) == ("day", "count_x", "day")
    s2 = T.StructType([T.StructField("a", T.LongType()), T.StructField("my_label", T.StringType()), T.StructField("visit_date", T.DateType())])
    r2 = RP.resolve_roles(s2)
    assert (r2.label, r2.value, r2.date) == ("my_label", "a", "visit_date")


def test_pie_share_zero_total_and_labels(spark):
    df = spark.createDataFrame([("a", 0), ("b", None)], "k string, v long")
    got = [tuple(r) for r in RP.pie_share(df).collect()]
    assert sorted(got) == [("a", 0, 0, 0), ("b", 0, 0, 0)]
    df2 = spark.createDataFrame([("a", 96), ("b", 4)], "k string, v long")
    got2 = {r.label: (r.pct_tenths, r.show_label) for r in RP.pie_share(df2).collect()}
    assert got2 == {"a": (960, 1), "b": (40, 0)}


def test_kpi_and_line(spark):
    df = spark.createDataFrame([(45000, None, "x", 1234.5, 2.0)], "a long, b long, c string, d double, e double")
    got = {r.label: r.value for r in RP.kpi_cards(df).collect()}
    assert got == {"a": "45,000", "b": "—", "c": "x", "d": "1,234.5", "e": "2"}
    daily = spark.createDataFrame([("2024-01-01", 1, 2), ("2024-01-02", 3, 4)], "date string, m long, n long")
    rows = RP.line_series(daily).collect()
    assert len(rows) == 4 and {r.axis for r in rows} == {"2024-01-01", "2024-01-02"}  # text without a time part stays


def test_top_n_ties_and_nulls(spark):
    rows = [("R1", f"a{i:02d}", 10) for i in range(12)] + [("R1", "zz", None), ("R2", "b", 5), (None, "c", 1)]
    df = spark.createDataFrame(rows, "region string, ase string, qty long")
    out = RP.top_n_per_group(df, "region", "ase", "qty", 10).collect()
    r1 = sorted((r.rank, r.ase) for r in out if r.region == "R1")
    assert r1 == [(i + 1, f"a{i:02d}") for i in range(10)]
    assert [(r.rank, r.value) for r in out if r.region is None] == [(1, 1)]


def test_attendance_summary_and_profile(spark):
    df = spark.createDataFrame([("Present", 1), ("", 4), (None, 2), ("Leave", 0), ("Training", None), ("Half Day", 3)], "`Attendance Type` string, Days long")
    got = sorted(tuple(r) for r in RP.attendance_summary(df).collect())
    assert got == [("Half Day", 3, "days"), ("Leave", 0, "days"), ("Present", 1, "day")]
    prof = spark.createDataFrame(
        [("NA", "Asha", "E1", "1", "F", "ASIA", "", "A", "Z", dt.date(2024, 1, 2)), ("http://x/p.png", "Bo", "E2", "2", "M", None, "T", "A", "Z", dt.date(2024, 1, 1))],
        "`Profile Picture` string, `Employee Name` string, `Employee ID` string, `User ID` string, Gender string, Region string, Type string, ASE string, ZSE string, Date date",
    )
    card = RP.profile_card(prof, [F.col("Date").desc()]).collect()
    assert {r.attribute for r in card} == {"Employee ID", "User ID", "Gender", "Region", "ASE", "ZSE"}
    assert card[0].initial == "A" and card[0].picture is None and card[0].name == "Asha"
    nine = prof.drop("Date").orderBy(F.desc("`User ID`"))
    assert RP.profile_card(nine).first().name == "Bo"  # the first row returned
    blank = prof.withColumn("Employee Name", F.lit(""))
    assert {(r.name, r.initial) for r in RP.profile_card(blank.drop("Date")).collect()} == {("-", "?")}


def test_table_cells_styles(spark):
    df = spark.createDataFrame([(0, None, "2024-01-05", False, dt.date(2024, 3, 1)), (None, "x", "", True, None)], "n long, s string, iso string, b boolean, d date")
    a = [tuple(r) for r in RP.table_cells(df, "attendance").collect()]
    assert a == [("0", "", "5-Jan-2024", "", "1-Mar-2024"), ("", "x", "", "true", "")]
    f = [tuple(r) for r in RP.table_cells(df, "field").collect()]
    assert f[1][0] == "" and f[0][0] == "0"


def test_payload_and_export_name(spark):
    df = spark.createDataFrame([(dt.date(2026, 6, 1), None, 3)], "d date, s string, n long")
    assert payload_columns(df) == ["d", "s", "n"]
    obj = json.loads(payload_rows(df).first().json)
    assert obj == {"d": "2026-06-01T00:00:00.000", "s": None, "n": 3}
    assert list(obj) == ["d", "s", "n"]
    assert export_name("MIDDLE EAST", dt.datetime(2026, 6, 1, 9, 5), "png") == "MIDDLE_EAST_Dashboard_1-Jun-2026_905.png"
    assert export_name("All", dt.datetime(2026, 12, 31, 14, 30), "pdf") == "All_Regions_Dashboard_31-Dec-2026_1430.pdf"


def test_exported_report_has_the_derived_name(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    path = export_report(df, str(tmp_path), "MIDDLE EAST", dt.datetime(2026, 6, 1, 9, 5), "csv")
    assert path == f"{tmp_path}/MIDDLE_EAST_Dashboard_1-Jun-2026_905.csv"
    assert sorted(tuple(r) for r in spark.read.option("header", "true").csv(path).collect()) == [("a", "1"), ("b", "2")]


def test_pages_hold_every_row_in_order(spark):
    df = spark.range(2500).orderBy(F.desc("id"))
    got = list(pages(df, size=1000))
    assert [len(p) for p in got] == [1000, 1000, 500]
    assert [r["id"] for p in got for r in p] == list(range(2499, -1, -1))
    assert payload(df)["rows"][0] == {"id": 2499} and column_list(df, "id")[-1] == 0


def test_time_id_key_orders_like_the_pair(spark):
    rows = [
        (dt.datetime(2024, 1, 1, 10, 0, 0, 5), -7),
        (dt.datetime(2024, 1, 1, 10, 0, 0, 5), 3),
        (dt.datetime(2024, 1, 1, 10, 0, 0, 6), -9),
        (dt.datetime(1969, 12, 31, 23, 59, 59), 2**62),
        (dt.datetime(2024, 1, 1, 9, 0), 2**62),
    ]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id long")
    got = [(r.ts, r.id) for r in df.select("ts", "id", PV.time_id_key("ts", "id").alias("k")).orderBy("k").collect()]
    assert got == sorted(rows)
    cells = df.select(F.lit("r").alias("r"), F.lit("c").alias("c"), F.col("id").alias("cnt"), PV.time_id_key("ts", "id").alias("seq"))
    assert PV.dedupe_last(cells, "r", "c", "seq").first().cnt == -9
