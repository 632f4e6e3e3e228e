"""Property tests: random dirty facts and random selections, checked against a
plain-Python statement of the filter and facet rules (brute force)."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fieldreports.operators.facets import facets_long
from fieldreports.operators.filters import AttendanceFilter
from fieldreports.sources.ingest import normalise_attendance

REGIONS = ["ASIA", "ASIA ", "asia", "", None]
TYPES = [" Promoter ", "PROMOTER", "Supervisor", "  ", "", None]
CHANNELS = [" RETAIL ", "RETAIL", "B2B", "\tRETAIL", "", None]
ASES = ["A1", " A1", "A2 ", "", None]
ATYPES = ["Present ", "Present", "Leave", "", None]
DAY0 = dt.date(2024, 1, 1)

row_st = st.tuples(
    st.integers(0, 60),
    st.sampled_from(REGIONS),
    st.sampled_from(TYPES),
    st.sampled_from(CHANNELS),
    st.sampled_from(ASES),
    st.sampled_from(ASES),
    st.sampled_from(ATYPES),
    st.integers(0, 9),
)
# A third or more of the rows share one key: the skewed shape the plans must handle.
rows_st = st.lists(row_st, min_size=1, max_size=40).map(lambda rs: rs + [(7, "ASIA", "PROMOTER", "RETAIL", "A1", "A1", "Leave", 3)] * (len(rs) // 2 + 1))

tok = st.sampled_from(["", "  ", "promoter", "PROMOTER ", "supervisor", "RETAIL", " B2B", "Present", "Leave ", "All"])
spec_st = st.builds(
    AttendanceFilter,
    region=st.sampled_from([None, "All", "", "ASIA", "ASIA ", "asia"]),
    types=st.lists(tok, max_size=3),
    channels=st.lists(tok, max_size=3),
    ase=st.sampled_from([None, "All", " A1 ", "A2"]),
    zse=st.sampled_from([None, "All", "A1"]),
    atypes=st.lists(tok, max_size=3),
    date_from=st.sampled_from([None, "2024-01-03"]),
    date_to=st.sampled_from([None, "2024-01-06"]),
    user_id=st.sampled_from([None, "", " 7 ", "1", "%", "_0"]),
)


def trim(v):  # SQL trim: spaces only
    return None if v is None else v.strip(" ")


def like_contains(text, term):
    import re

    pat = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in term.strip())
    return re.search(pat, text, re.IGNORECASE | re.DOTALL) is not None


def keep(r, spec, with_user=True):
    uid, region, typ, channel, ase, zse, atype, day = r
    d = DAY0 + dt.timedelta(days=day)
    if spec.region and spec.region != "All" and region != spec.region:
        return False
    types = [t.strip().lower() for t in spec.types if t]
    if types and (typ is None or trim(typ).lower() not in types):
        return False
    chans = [c.strip() for c in spec.channels if c]
    if chans and (channel is None or trim(channel) not in chans):
        return False
    if spec.ase and spec.ase != "All" and (ase is None or trim(ase) != spec.ase.strip()):
        return False
    if spec.zse and spec.zse != "All" and (zse is None or trim(zse) != spec.zse.strip()):
        return False
    atypes = [a.strip() for a in spec.atypes if a]
    if atypes and (atype is None or trim(atype) not in atypes):
        return False
    if spec.date_from and d < dt.date.fromisoformat(spec.date_from):
        return False
    if spec.date_to and d > dt.date.fromisoformat(spec.date_to):
        return False
    if with_user and spec.user_id and spec.user_id.strip() and not like_contains(str(uid), spec.user_id):
        return False
    return True


def brute_facets(rows, spec):
    out = set()
    for r in rows:
        if not keep(r, spec, with_user=False):
            continue
        uid, region, typ, channel, ase, zse, atype, _ = r
        if region is not None:
            out.add(("regions", region))
        for name, v in (("types", typ), ("channels", channel), ("ases", ase), ("zses", zse), ("atypes", atype)):
            if v is not None and trim(v) != "":
                out.add((name, trim(v)))
        out.add(("user_ids", str(uid)))
    return out


def frame(spark, rows):
    data = [(u, rg, t, c, a, z, at, DAY0 + dt.timedelta(days=d)) for u, rg, t, c, a, z, at, d in rows]
    schema = "user_id long, region string, type string, channel string, ase string, zse string, attendance_type string, attendance_date date"
    return normalise_attendance(spark.createDataFrame(data, schema))


@settings(max_examples=25, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_st, spec=spec_st)
def test_filter_and_facets_match_brute_force(spark, rows, spec):
    df = frame(spark, rows)
    got_rows = sorted(tuple(r) for r in spec.apply(df).select("user_id", "date_d").collect())
    want_rows = sorted((r[0], DAY0 + dt.timedelta(days=r[7])) for r in rows if keep(r, spec))
    assert got_rows == want_rows
    got = {(r.facet, r.value) for r in facets_long(df, spec).collect()}
    assert got == brute_facets(rows, spec)


vis_row = st.tuples(st.sampled_from(["R1", "R2", "R3"]), st.sampled_from([f"A{i}" for i in range(14)]), st.one_of(st.none(), st.integers(0, 9)))


@settings(max_examples=15, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(vis_row, min_size=1, max_size=60))
def test_top_n_and_crosstab_match_brute_force(spark, rows):
    from collections import Counter, defaultdict

    from fieldreports.operators import pivots as PV
    from fieldreports.operators import reports as RP

    df = spark.createDataFrame(rows, "region string, ase string, qty long")
    sums = defaultdict(int)
    for region, ase, qty in rows:
        sums[(region, ase)] += qty or 0
    want = set()
    for region in {r for r, _ in sums}:
        ranked = sorted(((-v, a) for (rg, a), v in sums.items() if rg == region))[:10]
        want |= {(region, i + 1, a, -nv) for i, (nv, a) in enumerate(ranked)}
    agg = df.groupBy("region", "ase").agg({"qty": "sum"}).withColumnRenamed("sum(qty)", "qty")
    got = {tuple(r) for r in RP.top_n_per_group(agg, "region", "ase", "qty", 10).collect()}
    assert got == want

    cells = Counter((a, r) for r, a, _ in rows)
    ct = {(r.ase, r.region, r.g_ase, r.g_region): r.cnt for r in PV.totals_cube(df.groupBy("ase", "region").count().withColumnRenamed("count", "cnt"), "ase", "region").collect()}
    for (a, r), n in cells.items():
        assert ct[(a, r, 0, 0)] == n
    assert ct[(None, None, 1, 1)] == len(rows)
    for r in {r for _, r, _ in [(0, x, 0) for x in (rr for rr, _, _ in rows)]}:
        assert ct[(None, r, 1, 0)] == sum(n for (_, rr), n in cells.items() if rr == r)


cell_st = st.lists(
    st.tuples(st.sampled_from(["P", "L", "T", "X"]), st.sampled_from(["d1", "d2", "d3"]), st.integers(0, 500)),
    min_size=1,
    max_size=30,
    unique_by=lambda t: (t[0], t[1]),
)


@settings(max_examples=15, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cells=cell_st)
def test_totals_and_percent_match_brute_force(spark, cells):
    import math
    from fractions import Fraction

    from fieldreports.operators import pivots as PV

    df = spark.createDataFrame(cells, "impact string, date string, cnt long")
    out = {(r.impact, r.date): (r.col_total, r.pct) for r in PV.percent_of_partition(df, "date").collect()}
    for impact, date, cnt in cells:
        total = sum(c for _, d, c in cells if d == date)
        denom = total or 1  # a zero total counts as 1
        pct = math.floor(Fraction(cnt * 100, denom) + Fraction(1, 2))
        assert out[(impact, date)] == (total, pct)
