"""Filter rules N1-N13 and the scalar rules O-90 (text dates) and O-91 (ILIKE)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldreports.functions.dates import parse_dd_mon_yy
from fieldreports.functions.text import contains_pattern
from fieldreports.operators.filters import AttendanceFilter, VisitFilter
from fieldreports.sources.ingest import normalise_attendance, normalise_visits

ATT_COLS = "user_id long, region string, type string, channel string, zse string, ase string, attendance_type string, attendance_date date"


def att(spark, rows):
    return normalise_attendance(spark.createDataFrame(rows, ATT_COLS))


def ids(df):
    return sorted(r.user_id for r in df.select("user_id").collect())


D = dt.date(2024, 1, 5)


@pytest.fixture(scope="module")
def rows():
    return [
        (1, "ASIA", " Promoter ", " RETAIL ", "Z1 ", "A1", "Present ", D),
        (2, "ASIA ", "PROMOTER", "RETAIL", "Z1", "A2", "Leave", D + dt.timedelta(days=1)),
        (3, "", "  ", "B2B", "Z2", "A3", "", D + dt.timedelta(days=2)),
        (4, None, None, None, None, None, None, D + dt.timedelta(days=3)),
        (14, "asia", "Supervisor", "\tRETAIL", "Z1", "A1", "Present", D),
        (40, "EUROPE", "supervisor", "RETAIL", "Z3", "A4", "Half Day", D + dt.timedelta(days=9)),
    ]


def test_region_raw_case_sensitive_untrimmed(spark, rows):  # N1
    df = att(spark, rows)
    assert ids(AttendanceFilter(region="ASIA").apply(df)) == [1]
    assert ids(AttendanceFilter(region="ASIA ").apply(df)) == [2]


def test_all_or_blank_disables_single_selects(spark, rows):  # N6
    df = att(spark, rows)
    for spec in (AttendanceFilter(region="All"), AttendanceFilter(region=""), AttendanceFilter(ase="All", zse=None)):
        assert ids(spec.apply(df)) == [1, 2, 3, 4, 14, 40]


def test_type_filter_case_insensitive(spark, rows):  # N4
    df = att(spark, rows)
    assert ids(AttendanceFilter(types=["promoter"]).apply(df)) == [1, 2]
    assert ids(AttendanceFilter(types=["SUPERVISOR "]).apply(df)) == [14, 40]


def test_empty_token_dropped_whitespace_token_matches_blank(spark, rows):  # N5
    df = att(spark, rows)
    assert ids(AttendanceFilter(types=[""]).apply(df)) == [1, 2, 3, 4, 14, 40]
    assert ids(AttendanceFilter(types=["  "]).apply(df)) == [3]


def test_trim_only_spaces(spark, rows):  # N7: a stored tab never matches
    df = att(spark, rows)
    assert ids(AttendanceFilter(channels=["RETAIL"]).apply(df)) == [1, 2, 40]


def test_null_never_matches(spark, rows):  # N8
    df = att(spark, rows)
    assert 4 not in ids(AttendanceFilter(atypes=["", "Present"]).apply(df))
    assert ids(AttendanceFilter(atypes=["Present"]).apply(df)) == [1, 14]


def test_dates_inclusive(spark, rows):  # N9
    df = att(spark, rows)
    spec = AttendanceFilter(date_from="2024-01-06", date_to="2024-01-08")
    assert ids(spec.apply(df)) == [2, 3, 4]


def test_user_search_substring_and_wildcards(spark, rows):  # N10
    df = att(spark, rows)
    assert ids(AttendanceFilter(user_id=" 4 ").apply(df)) == [4, 14, 40]
    assert ids(AttendanceFilter(user_id="1_").apply(df)) == [14]
    assert ids(AttendanceFilter(user_id="   ").apply(df)) == [1, 2, 3, 4, 14, 40]


def test_from_params_multi_valued():
    spec = AttendanceFilter.from_params({"region": "All", "type": ["", "Promoter"], "atype": "Leave", "user_id": ""})
    assert set(spec.slots()) == {"type", "atype"}


def test_honours_subset(spark, rows):  # N13
    df = att(spark, rows)
    spec = AttendanceFilter(region="EUROPE", types=["promoter"])
    assert ids(spec.apply(df, honours=["region"])) == [40]
    with pytest.raises(KeyError):
        spec.predicate(honours=["nope"])


def test_contains_pattern_backslashes():  # O-91
    assert contains_pattern(" ab ") == "%ab%"
    assert contains_pattern(r"a\bc") == "%abc%"
    assert contains_pattern(r"50\%") == r"%50\%%"
    assert contains_pattern("a\\\\b") == "%a\\\\b%"
    assert contains_pattern("x\\") == "%x\\%"


def test_ilike_backslash_runs(spark):
    df = spark.createDataFrame([("abc",), ("a%c",), ("xbz",)], "s string")
    got = sorted(r.s for r in df.where(F.col("s").ilike(contains_pattern(r"\b"))).collect())
    assert got == ["abc", "xbz"]
    got = [r.s for r in df.where(F.col("s").ilike(contains_pattern(r"\%"))).collect()]
    assert got == ["a%c"]


def test_parse_two_digit_years(spark):  # O-90
    texts = ["02-Jun-95", "2-Jun-95", "01-Jan-00", "31-Dec-68", "15-Jul-70", "29-Feb-96", "", "junk", None, "31-Feb-99"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.d for r in df.select(parse_dd_mon_yy("t").alias("d")).collect()]
    assert got == [
        dt.date(1995, 6, 2),
        dt.date(1995, 6, 2),
        dt.date(2000, 1, 1),
        dt.date(2068, 12, 31),
        dt.date(1970, 7, 15),
        dt.date(1996, 2, 29),
        None,
        None,
        None,
        None,
    ]


def test_visit_filter_text_date_and_range(spark):
    rows = [("R", "Z ", " A", "C ", " Tier-A", d, "HO1", 1) for d in ("05-Mar-97", " 06-Mar-97", "01-Jan-00", "junk")]
    df = normalise_visits(spark.createDataFrame(rows, "region string, zse string, ase string, channel string, tier string, date_txt string, ase_ho_id string, qty int"))
    assert df.where(VisitFilter(date=" 06-Mar-97 ").predicate(columns=set(df.columns))).count() == 1
    rng = VisitFilter(date_from="1997-03-05", date_to="2000-01-01")
    assert rng.apply(df).count() == 3
    assert VisitFilter(user_id="ho").apply(df).count() == 4
    assert VisitFilter(tiers=["Tier-A"], zse="Z", ase="A").apply(df).count() == 4
