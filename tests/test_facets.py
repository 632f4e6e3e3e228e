"""Facets: long and wide forms, exclude_self, dimension lists, lists of the field side."""

import pytest

from fieldreports.operators import facets as FC
from fieldreports.operators import pivots as PV
from fieldreports.operators.filters import AttendanceFilter, VisitFilter
from fieldreports.sources.ingest import normalise_attendance, normalise_visits

import datetime as dt

D = dt.date(2024, 1, 5)


@pytest.fixture(scope="module")
def att(spark):
    rows = [
        (1, "ASIA", " Promoter ", " RETAIL ", "Z1 ", "A1", "Present ", D),
        (2, "", "PROMOTER", "RETAIL", "Z1", "A2", "Leave", D),
        (3, None, "  ", "", "Z2", "A3", "", D),
        (4, "EUROPE", "Supervisor", "B2B", "Z3", " ", "Leave", D),
    ]
    return normalise_attendance(
        spark.createDataFrame(rows, "user_id long, region string, type string, channel string, zse string, ase string, attendance_type string, attendance_date date")
    )


def pairs(df):
    return {(r.facet, r.value) for r in df.collect()}


def test_blank_region_is_an_option_but_blank_types_are_not(att):
    got = pairs(FC.facets_long(att))
    assert ("regions", "") in got and ("regions", None) not in got
    assert ("types", "") not in got
    assert {v for f, v in got if f == "types"} == {"Promoter", "PROMOTER", "Supervisor"}  # N4: not folded
    assert {v for f, v in got if f == "user_ids"} == {"1", "2", "3", "4"}


def test_own_filter_applies_and_user_search_is_ignored(att):  # N11, N12
    got = pairs(FC.facets_long(att, AttendanceFilter(region="ASIA", user_id="4")))
    assert {v for f, v in got if f == "regions"} == {"ASIA"}
    assert {v for f, v in got if f == "user_ids"} == {"1"}


def test_exclude_self(att):
    got = pairs(FC.facets_long(att, AttendanceFilter(region="ASIA", types=["supervisor"]), exclude_self=True))
    assert {v for f, v in got if f == "regions"} == {"EUROPE"}
    assert {v for f, v in got if f == "types"} == {"Promoter"}
    assert {v for f, v in got if f == "channels"} == set()


def test_facet_is_distinct_of_filtered_rows(att):  # invariant
    spec = AttendanceFilter(types=["promoter"])
    got = {v for f, v in pairs(FC.facets_long(att, spec)) if f == "zses"}
    direct = {r.zse_key for r in spec.apply(att).collect() if r.zse_key}
    assert got == direct


def test_widening_never_loses_options(att):  # invariant
    narrow = pairs(FC.facets_long(att, AttendanceFilter(region="ASIA", types=["promoter"])))
    wide = pairs(FC.facets_long(att, AttendanceFilter(types=["promoter"])))
    assert narrow <= wide


def test_wide_form(att):
    names = [f.name for f in FC.ATTENDANCE_FACETS if f.slot]
    long = FC.facets_long(att, AttendanceFilter(region="EUROPE"))
    row = FC.facets_wide(long, names).first()
    assert row.regions == ["EUROPE"] and row.ases == [] and "user_ids" not in row
    sizes = FC.facet_sizes(long, [*names, "user_ids"]).first()
    assert sizes.n_regions == 1 and sizes.n_ases == 0 and sizes.n_user_ids == 1
    whole = FC.facets_wide(FC.facets_long(att), names).first()
    assert whole.types == ["PROMOTER", "Promoter", "Supervisor"]


def test_dimension_lists(att):
    assert [r.region for r in FC.dimension_list(att, "region").collect()] == ["", "ASIA", "EUROPE"]
    assert [r.ase for r in FC.dimension_list(att, "ase").collect()] == ["A1", "A2", "A3"]
    assert [(r.zse, r.ase) for r in FC.zse_ase_pairs(att).collect()] == [("Z1", "A1"), ("Z1", "A2"), ("Z2", "A3")]


def test_field_facets_apply_user_search_and_text_dates(spark):
    rows = [
        ("ASIA", "Z1 ", " A1", "C1 ", " Tier-A", "05-Mar-97", "HO1", 1),
        ("ASIA", "Z1 ", " A2", None, " Tier-B", "06-Mar-97", "HO22", 2),
        ("EUROPE", "Z2 ", " A3", "", " Tier-A", " ", " HO3", 3),
    ]
    vis = normalise_visits(
        spark.createDataFrame(rows, "region string, zse string, ase string, channel string, tier string, date_txt string, ase_ho_id string, qty int")
    )
    spec = VisitFilter.from_params({"region": "All", "user_id": "ho", "tier": ["", "Tier-A"]})
    got = pairs(FC.facets_long(vis, spec))
    assert {v for f, v in got if f == "ase_ho_ids"} == {"HO1", "HO3"}
    assert {v for f, v in got if f == "dates"} == {"05-Mar-97"}
    assert {v for f, v in got if f == "channels"} == {"C1"}
    ex = pairs(FC.facets_long(vis, VisitFilter(tiers=["Tier-B"]), exclude_self=True))
    assert {v for f, v in ex if f == "tiers"} == {"Tier-A", "Tier-B"}


def test_display_order_puts_unknown_last(spark):
    df = spark.createDataFrame([("Mystery", None, "d1"), ("Leave", 6, "d1"), ("Present", 1, "d2")], "t string, ordinal long, d string")
    assert [r.t for r in PV.display_order(df, "t", "d").collect()] == ["Present", "Leave", "Mystery"]
