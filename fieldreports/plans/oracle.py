"""Oracle SQL (DuckDB dialect) for every registered query with an SQL form.

Written independently of the Spark code: the two fact views are derived from
the driver tables with plain SQL, each query restates its filter by hand, and
labels, orders and edges are stated here again rather than imported, so a wrong
one in the package shows.  All integer outputs are BIGINT and day keys are
``yyyy-MM-dd`` text on both sides so results compare exactly.
"""

from __future__ import annotations

import datetime as dt

# Fixed values, restated: preset orders of categories.
ATT_ORDER = (
    "Present",
    "Gate Meeting",
    "Training",
    "Half Day",
    "Weekoff",
    "Leave",
    "Outlet Closed",
    "Absent",
    "Holiday",
    "Not Marked",
    "Other",
)
TIME_ORDER = ("Before 10 AM", "10 AM To 12 Noon", "12 Noon To 2 PM", "After 2 PM", "Not Check in")
PAY_ORDER = ("4.5-9 Hrs (Half Day)", "9 Hrs (Full Day)", "No Check-Out (LOP)", "Not Check in")


def _rank_case(col: str, order) -> str:
    whens = " ".join(f"WHEN {col} = '{v}' THEN {i}" for i, v in enumerate(order, start=1))
    return f"CAST(CASE {whens} END AS BIGINT)"


ATT_CTE = """
ev AS (SELECT user_id, CAST(ts AS DATE) AS d, ts, event_type FROM events),
daily AS (
  SELECT user_id, d, min(event_type) AS first_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events
  FROM ev GROUP BY user_id, d),
days AS (SELECT DISTINCT d FROM daily),
roster AS (
  SELECT u.user_id, c.c_custkey, c.c_name, c.c_mktsegment, n.n_name, r.r_name
  FROM (SELECT DISTINCT user_id FROM daily) u
  JOIN customer c ON c.c_custkey = u.user_id
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey),
att_raw AS (
  SELECT ro.user_id,
    CASE WHEN ro.c_custkey % 29 = 0 THEN NULL ELSE ro.r_name END AS region,
    CASE WHEN ro.user_id % 17 = 0 THEN NULL WHEN ro.user_id % 19 = 0 THEN '  '
         WHEN ro.user_id % 3 = 0 THEN ' Promoter ' WHEN ro.user_id % 3 = 1 THEN 'PROMOTER'
         ELSE 'Supervisor' END AS type,
    ' ' || ro.c_mktsegment || ' ' AS channel,
    ro.n_name || ' ' AS zse,
    ro.n_name || '-A' || CAST(ro.user_id % 3 AS VARCHAR) AS ase,
    CASE WHEN dl.first_type IS NULL THEN 'Not Marked' WHEN dl.first_type = 'view' THEN 'Present '
         WHEN dl.first_type = 'click' THEN 'Gate Meeting' WHEN dl.first_type = 'signup' THEN 'Training'
         WHEN dl.first_type = 'purchase' THEN 'Half Day' ELSE 'Leave' END AS attendance_type,
    dd.d AS attendance_date,
    dl.first_ts AS check_in,
    CASE WHEN dl.n_events > 1 THEN dl.last_ts END AS check_out,
    ro.c_name AS employee_name,
    'E' || CAST(ro.user_id AS VARCHAR) AS employee_id,
    CASE WHEN ro.user_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
    CASE WHEN ro.user_id % 3 = 0 THEN 'NA' WHEN ro.user_id % 3 = 1 THEN NULL
         ELSE 'http://images.example.org/' || CAST(ro.user_id AS VARCHAR) || '.png' END AS profile_picture
  FROM roster ro CROSS JOIN days dd
  LEFT JOIN daily dl ON dl.user_id = ro.user_id AND dl.d = dd.d),
att AS (
  SELECT *, trim(type) AS type_key, lower(trim(type)) AS type_ci, trim(channel) AS channel_key,
         trim(ase) AS ase_key, trim(zse) AS zse_key, trim(attendance_type) AS atype_key,
         attendance_date AS date_d, CAST(user_id AS VARCHAR) AS user_txt,
         CASE WHEN attendance_type IS NULL OR trim(attendance_type) = '' THEN 'Not Marked'
              ELSE trim(attendance_type) END AS atype_n,
         strftime(attendance_date, '%Y-%m-%d') AS day
  FROM att_raw)
"""

VIS_CTE = """
vis_raw AS (
  SELECT r.r_name AS region, n.n_name || ' ' AS zse, ' ' || s.s_name AS ase,
    CASE WHEN l.l_partkey % 23 = 0 THEN NULL WHEN l.l_partkey % 31 = 0 THEN '' ELSE p.p_type || ' ' END AS channel,
    ' Tier-' || l.l_returnflag AS tier,
    strftime(l.l_shipdate, '%d-%b-%y') AS date_txt,
    'HO' || CAST(s.s_suppkey AS VARCHAR) AS ase_ho_id,
    CAST(trunc(l.l_quantity) AS INTEGER) AS qty,
    l.l_linestatus AS location_in,
    l.l_returnflag AS location_out,
    CASE WHEN l.l_quantity IS NULL THEN NULL WHEN l.l_quantity / 5.0 < 4 THEN 'Below 4 Hrs' WHEN l.l_quantity / 5.0 < 6 THEN '4-6 Hrs'
         WHEN l.l_quantity / 5.0 < 8 THEN '6-8 Hrs' ELSE '8 Hrs & Above' END AS workhour
  FROM lineitem l
  JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation n ON n.n_nationkey = s.s_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
  JOIN part p ON p.p_partkey = l.l_partkey),
vis AS (
  SELECT *, trim(zse) AS zse_key, trim(ase) AS ase_key, trim(channel) AS channel_key, trim(tier) AS tier_key,
         trim(date_txt) AS date_key, CAST(strptime(trim(date_txt), '%d-%b-%y') AS DATE) AS date_d
  FROM vis_raw)
"""


def _a(body: str) -> str:
    return f"WITH {ATT_CTE.strip()}\n{body.strip()}"


def _v(body: str) -> str:
    return f"WITH {VIS_CTE.strip()}\n{body.strip()}"


def _dim(col: str, out: str, keep_blank: bool) -> str:
    cond = f"{col} IS NOT NULL" + ("" if keep_blank else f" AND {col} <> ''")
    return _a(f"SELECT DISTINCT {col} AS {out} FROM att WHERE {cond}")


_A_FACETS = (
    ("regions", "region", True),
    ("types", "type_key", False),
    ("channels", "channel_key", False),
    ("ases", "ase_key", False),
    ("zses", "zse_key", False),
    ("atypes", "atype_key", False),
    ("user_ids", "user_txt", True),
)
_V_FACETS = (
    ("regions", "region", True),
    ("zses", "zse_key", False),
    ("ases", "ase_key", False),
    ("channels", "channel_key", False),
    ("tiers", "tier_key", False),
    ("dates", "date_key", False),
    ("ase_ho_ids", "trim(ase_ho_id)", False),
)


def _facets(view: str, facets, where: str = "TRUE", own: dict | None = None) -> str:
    parts = []
    for name, col, keep_blank in facets:
        cond = f"{col} IS NOT NULL" + ("" if keep_blank else f" AND {col} <> ''")
        w = where if own is None else own[name]
        parts.append(f"SELECT '{name}' AS facet, {col} AS value FROM {view} WHERE ({w}) AND {cond}")
    return "\nUNION\n".join(parts)


_FA_REGION = "region = 'ASIA'"
_FA_TYPE = "lower(trim(type)) IN ('promoter')"
_FA_DATE = "attendance_date >= DATE '2024-01-05' AND attendance_date <= DATE '2024-01-20'"
FA_WHERE = f"{_FA_REGION} AND {_FA_TYPE} AND {_FA_DATE}"
_FV_REGION = "region = 'EUROPE'"
_FV_TIER = "trim(tier) IN ('Tier-N')"
_FV_DATE = "date_d >= DATE '1996-01-01' AND date_d <= DATE '1996-06-30'"
_FV_USER = "ase_ho_id ILIKE '%1%'"
FV_WHERE = f"{_FV_REGION} AND {_FV_TIER} AND {_FV_DATE} AND {_FV_USER}"


def _by_type(where: str) -> str:
    return _a(f"SELECT atype_key AS attendance_type, count(*) AS cnt FROM att WHERE {where} GROUP BY atype_key")


def _by_channel(where: str) -> str:
    return _v(
        f"SELECT channel_key AS channel, count(*) AS cnt, CAST(sum(qty) AS BIGINT) AS qty "
        f"FROM vis WHERE {where} GROUP BY channel_key"
    )


def _pivot(cells: str, row: str, order, header: bool) -> str:
    rank = f", {_rank_case(row, order)} AS ordinal" if order is not None else ""
    hdr = ", strftime(CAST(date AS DATE), '%d-%b(%a)') AS header" if header else ""
    return f"""
, cells AS ({cells})
SELECT {row}{rank}, date{hdr}, cnt, CAST(sum(cnt) OVER (PARTITION BY date) AS BIGINT) AS col_total FROM cells
"""


def _timing_case() -> str:
    return (
        "CASE WHEN check_in IS NULL THEN 'Not Check in' WHEN hour(check_in) < 10 THEN 'Before 10 AM' "
        "WHEN hour(check_in) < 12 THEN '10 AM To 12 Noon' WHEN hour(check_in) < 14 THEN '12 Noon To 2 PM' ELSE 'After 2 PM' END"
    )


def _impact_case() -> str:
    span = "date_sub('microsecond', check_in, check_out)"
    return (
        "CASE WHEN check_in IS NULL THEN 'Not Check in' WHEN check_out IS NULL THEN 'No Check-Out (LOP)' "
        f"WHEN {span} >= 32400000000 THEN '9 Hrs (Full Day)' WHEN {span} * 2 >= 32400000000 THEN '4.5-9 Hrs (Half Day)' "
        f"ELSE 'Below 4.5 Hrs' END"
    )


def _generic_pivot(col: str) -> str:
    return _v(
        f"""
SELECT category, date, cnt, CAST(sum(cnt) OVER (PARTITION BY date) AS BIGINT) AS col_total
FROM (SELECT {col} AS category, date_key AS date, count(*) AS cnt FROM vis GROUP BY {col}, date_key) c
"""
    )


def _pie(cells: str) -> str:
    return f"""
, w AS ({cells}),
t AS (SELECT CAST(coalesce(sum(coalesce(cnt, 0)), 0) AS BIGINT) AS total FROM w)
SELECT CAST(label AS VARCHAR) AS label, CAST(coalesce(cnt, 0) AS BIGINT) AS value,
       CAST(CASE WHEN t.total = 0 THEN 0 ELSE (coalesce(cnt, 0) * 2000 + t.total) // (2 * t.total) END AS BIGINT) AS pct_tenths,
       CAST(CASE WHEN t.total <> 0 AND (coalesce(cnt, 0) * 2000 + t.total) // (2 * t.total) >= 50 THEN 1 ELSE 0 END AS BIGINT) AS show_label
FROM w, t
"""


JANUARY = [dt.date(2024, 1, i).isoformat() for i in range(1, 32)]


def _array(col: str, keep_blank: bool, where: str) -> str:
    cond = f"{col} IS NOT NULL" + ("" if keep_blank else f" AND {col} <> ''")
    return f"(SELECT '[' || coalesce(string_agg(v, ',' ORDER BY v), '') || ']' FROM (SELECT DISTINCT {col} AS v FROM att WHERE {where} AND {cond}) s)"


ORACLE: dict[str, str] = {
    "dim_regions": _dim("region", "region", True),
    "dim_types": _dim("type_key", "type", False),
    "dim_channels": _dim("channel_key", "channel", False),
    "dim_ases": _dim("ase_key", "ase", False),
    "dim_zses": _dim("zse_key", "zse", False),
    "dim_attendance_types": _dim("atype_key", "atype", False),
    "dim_zse_ase_pairs": _a(
        "SELECT DISTINCT zse_key AS zse, ase_key AS ase FROM att "
        "WHERE zse IS NOT NULL AND zse_key <> '' AND ase IS NOT NULL AND ase_key <> ''"
    ),
    "facets_attendance": _a(_facets("att", _A_FACETS)),
    "facets_attendance_filtered": _a(_facets("att", _A_FACETS, FA_WHERE)),
    "facets_attendance_exclude_self": _a(
        _facets(
            "att",
            _A_FACETS,
            own={
                "regions": f"{_FA_TYPE} AND {_FA_DATE}",
                "types": f"{_FA_REGION} AND {_FA_DATE}",
                "channels": FA_WHERE,
                "ases": FA_WHERE,
                "zses": FA_WHERE,
                "atypes": FA_WHERE,
                "user_ids": FA_WHERE,
            },
        )
    ),
    "facets_visits": _v(_facets("vis", _V_FACETS)),
    "facets_visits_filtered": _v(_facets("vis", _V_FACETS, FV_WHERE)),
    "facets_visits_exclude_self": _v(
        _facets(
            "vis",
            _V_FACETS,
            own={
                "regions": f"{_FV_TIER} AND {_FV_DATE} AND {_FV_USER}",
                "zses": FV_WHERE,
                "ases": FV_WHERE,
                "channels": FV_WHERE,
                "tiers": f"{_FV_REGION} AND {_FV_DATE} AND {_FV_USER}",
                "dates": f"{_FV_REGION} AND {_FV_TIER} AND {_FV_USER}",
                "ase_ho_ids": f"{_FV_REGION} AND {_FV_TIER} AND {_FV_DATE}",
            },
        )
    ),
    "facet_counts_wide": _a(
        f", f AS ({_facets('att', _A_FACETS, FA_WHERE)})\nSELECT "
        + ", ".join(f"CAST(count(*) FILTER (WHERE facet = '{n}') AS BIGINT) AS n_{n}" for n, _, _ in _A_FACETS)
        + " FROM f"
    ),
    "facet_arrays": _a(
        "SELECT "
        + ", ".join(
            f"{_array(col, keep, "trim(zse) = 'NATION_7' AND lower(trim(type)) IN ('')")} AS {name}" for name, col, keep in _A_FACETS if name != "user_ids"
        )
    ),
    "filter_region": _by_type("region = 'EUROPE'"),
    "filter_types_ci": _by_type("lower(trim(type)) IN ('promoter', '')"),
    "filter_channels": _by_type("trim(channel) IN ('AUTOMOBILE', 'HOUSEHOLD')"),
    "filter_ase": _by_type("trim(ase) = 'NATION_3-A1'"),
    "filter_zse": _by_type("trim(zse) = 'NATION_7'"),
    "filter_atypes": _by_type("trim(attendance_type) IN ('Present', 'Half Day')"),
    "filter_dates": _by_type("attendance_date >= DATE '2024-01-10' AND attendance_date <= DATE '2024-01-12'"),
    "filter_user": _by_type("CAST(user_id AS VARCHAR) ILIKE '%4%'"),
    "filter_all_attendance": _by_type(
        "region = 'AMERICA' AND lower(trim(type)) IN ('promoter', 'supervisor') "
        "AND trim(channel) IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') "
        "AND trim(attendance_type) IN ('Not Marked', 'Leave', 'Training', 'Present') "
        "AND attendance_date >= DATE '2024-01-03' AND attendance_date <= DATE '2024-01-27' "
        "AND CAST(user_id AS VARCHAR) ILIKE '%1%'"
    ),
    "visits_filter_tier": _by_channel("trim(tier) IN ('Tier-R', 'Tier-A')"),
    "visits_filter_zse": _by_channel("trim(zse) = 'NATION_5'"),
    "visits_filter_ase": _by_channel("trim(ase) = 'Supplier#000000007'"),
    "visits_filter_text_date": _by_channel("trim(date_txt) = '15-Mar-97'"),
    "visits_filter_date_range": _by_channel("date_d >= DATE '1999-12-01' AND date_d <= DATE '2000-01-31'"),
    "visits_filter_user": _by_channel("ase_ho_id ILIKE '%ho1%'"),
    "visits_filter_all": _by_channel(
        "region = 'AMERICA' AND trim(channel) IN ('PROMO', 'STANDARD', 'ECONOMY') AND trim(tier) IN ('Tier-N', 'Tier-R') "
        "AND date_d >= DATE '1996-01-01' AND date_d <= DATE '1998-12-31' AND ase_ho_id ILIKE '%2%'"
    ),
    "pivot_attendance_date": _a(
        _pivot(
            "SELECT day AS date, atype_n AS attendance_type, count(*) AS cnt FROM att GROUP BY day, atype_n",
            "attendance_type",
            ATT_ORDER,
            True,
        )
    ),
    "pivot_attendance_dense": _a(
        """
, cells AS (SELECT day AS date, atype_n AS attendance_type, count(*) AS cnt FROM att GROUP BY day, atype_n),
grid AS (SELECT r.attendance_type, c.date FROM (SELECT DISTINCT attendance_type FROM cells) r
         CROSS JOIN (SELECT DISTINCT date FROM cells) c),
dense AS (SELECT g.attendance_type, g.date, CAST(coalesce(cells.cnt, 0) AS BIGINT) AS cnt
          FROM grid g LEFT JOIN cells ON cells.attendance_type = g.attendance_type AND cells.date = g.date)
SELECT attendance_type, date, cnt, CAST(sum(cnt) OVER (PARTITION BY date) AS BIGINT) AS col_total FROM dense
"""
    ),
    "pivot_attendance_wide": _a(
        "SELECT atype_n AS attendance_type, "
        + ", ".join(f"count(*) FILTER (WHERE day = '{d}') AS \"{d}\"" for d in JANUARY)
        + " FROM att WHERE attendance_date >= DATE '2024-01-01' AND attendance_date <= DATE '2024-01-31' GROUP BY atype_n"
    ),
    "crosstab_region": _a(
        """
, cells AS (SELECT region, atype_n AS attendance_type, count(*) AS cnt FROM att GROUP BY region, atype_n)
SELECT attendance_type, region, CAST(sum(cnt) AS BIGINT) AS cnt,
       CAST(grouping(attendance_type) AS BIGINT) AS g_attendance_type, CAST(grouping(region) AS BIGINT) AS g_region
FROM cells GROUP BY CUBE (attendance_type, region)
"""
    ),
    "pivot_timing": _a(
        _pivot(
            f"SELECT day AS date, {_timing_case()} AS timing, count(*) AS cnt FROM att GROUP BY ALL",
            "timing",
            TIME_ORDER,
            True,
        )
    ),
    "pivot_salary": _a(
        f"""
, cells AS (SELECT day AS date, {_impact_case()} AS impact, count(*) AS cnt FROM att GROUP BY ALL),
tot AS (SELECT impact, {_rank_case('impact', PAY_ORDER)} AS ordinal, date, cnt,
               CAST(sum(cnt) OVER (PARTITION BY date) AS BIGINT) AS col_total FROM cells)
SELECT impact, ordinal, date, strftime(CAST(date AS DATE), '%d-%b(%a)') AS header, cnt, col_total,
       CAST((cnt * 200 + (CASE WHEN col_total = 0 THEN 1 ELSE col_total END))
            // (2 * (CASE WHEN col_total = 0 THEN 1 ELSE col_total END)) AS BIGINT) AS pct
FROM tot
"""
    ),
    "pivot_location_in": _generic_pivot("location_in"),
    "pivot_location_out": _generic_pivot("location_out"),
    "pivot_workhour": _generic_pivot("workhour"),
    "pie_share": _a(_pie("SELECT atype_n AS label, count(*) AS cnt FROM att GROUP BY atype_n")),
    "visits_channel_share": _v(_pie("SELECT channel_key AS label, count(*) AS cnt FROM vis GROUP BY channel_key")),
    "bar_trend": _a("SELECT atype_n AS label, count(*) AS value FROM att GROUP BY atype_n"),
    "visits_tier_bar": _v("SELECT tier_key AS label, CAST(sum(qty) AS BIGINT) AS value FROM vis GROUP BY tier_key"),
    "line_trend": _a(
        """
, d AS (SELECT day AS x, CAST(sum(CASE WHEN atype_n <> 'Not Marked' THEN 1 ELSE 0 END) AS BIGINT) AS marked,
               count(check_in) AS checked_in, count(*) AS records FROM att GROUP BY day)
SELECT x, strftime(CAST(x AS DATE), '%-d-%b-%y') AS axis, 'marked' AS series, marked AS value FROM d
UNION ALL SELECT x, strftime(CAST(x AS DATE), '%-d-%b-%y'), 'checked_in', checked_in FROM d
UNION ALL SELECT x, strftime(CAST(x AS DATE), '%-d-%b-%y'), 'records', records FROM d
"""
    ),
    "kpi_cards": _a(
        """
, k AS (SELECT count(DISTINCT user_id) AS employees, count(*) AS records, count(check_in) AS checked_in,
               CAST(sum(CASE WHEN atype_n = 'Not Marked' THEN 1 ELSE 0 END) AS BIGINT) AS not_marked FROM att)
SELECT 'employees' AS label, format('{:,}', employees) AS value FROM k
UNION ALL SELECT 'records', format('{:,}', records) FROM k
UNION ALL SELECT 'checked_in', format('{:,}', checked_in) FROM k
UNION ALL SELECT 'not_marked', coalesce(format('{:,}', not_marked), '—') FROM k
"""
    ),
    "attendance_summary": _a(
        """
SELECT atype_n AS attendance_type, count(*) AS days, CASE WHEN count(*) = 1 THEN 'day' ELSE 'days' END AS unit
FROM att WHERE CAST(user_id AS VARCHAR) ILIKE '%7%' GROUP BY atype_n
"""
    ),
    "employee_detail": _a(
        """
SELECT coalesce(profile_picture, '') AS "Profile Picture", coalesce(employee_name, '') AS "Employee Name", coalesce(employee_id, '') AS "Employee ID",
       coalesce(CAST(user_id AS VARCHAR), '') AS "User ID", coalesce(gender, '') AS "Gender",
       coalesce(region, '') AS "Region", coalesce(type_key, '') AS "Type", coalesce(ase_key, '') AS "ASE",
       coalesce(zse_key, '') AS "ZSE", strftime(attendance_date, '%-d-%b-%Y') AS "Date",
       atype_n AS "Attendance Type",
       coalesce(strftime(check_in, '%-d-%b-%Y'), '') AS "Check In",
       coalesce(strftime(check_out, '%-d-%b-%Y'), '') AS "Check Out"
FROM att WHERE CAST(user_id AS VARCHAR) ILIKE '%12%'
"""
    ),
    "employee_profile": _a(
        """
, first AS (SELECT * FROM att WHERE CAST(user_id AS VARCHAR) ILIKE '%12%'
            ORDER BY attendance_date DESC, CAST(user_id AS VARCHAR) ASC LIMIT 1),
card AS (SELECT coalesce(employee_name, '-') AS name,
                CASE WHEN profile_picture IS NOT NULL AND profile_picture <> 'NA' AND starts_with(profile_picture, 'http')
                     THEN profile_picture END AS picture,
                CASE WHEN profile_picture IS NOT NULL AND profile_picture <> 'NA' AND starts_with(profile_picture, 'http')
                     THEN NULL WHEN employee_name IS NULL OR employee_name = '' THEN '?'
                     ELSE substr(employee_name, 1, 1) END AS initial,
                employee_id, CAST(user_id AS VARCHAR) AS uid, gender, region, type_key, ase_key, zse_key FROM first),
attrs AS (
  SELECT name, picture, initial, 'Employee ID' AS attribute, employee_id AS value FROM card
  UNION ALL SELECT name, picture, initial, 'User ID', uid FROM card
  UNION ALL SELECT name, picture, initial, 'Gender', gender FROM card
  UNION ALL SELECT name, picture, initial, 'Region', region FROM card
  UNION ALL SELECT name, picture, initial, 'Type', type_key FROM card
  UNION ALL SELECT name, picture, initial, 'ASE', ase_key FROM card
  UNION ALL SELECT name, picture, initial, 'ZSE', zse_key FROM card)
SELECT * FROM attrs WHERE value IS NOT NULL AND value <> ''
"""
    ),
    "visits_detail_table": _v(
        """
SELECT coalesce(region, '') AS region, coalesce(zse_key, '') AS zse, coalesce(ase_key, '') AS ase,
       coalesce(ase_ho_id, '') AS ase_ho_id, CAST(count(*) AS VARCHAR) AS visits,
       coalesce(CAST(sum(qty) AS VARCHAR), '') AS qty
FROM vis WHERE region = 'ASIA' AND trim(channel) IN ('PROMO', 'SMALL')
GROUP BY region, zse_key, ase_key, ase_ho_id
"""
    ),
    "top10_region_ase": _v(
        """
, s AS (SELECT region, ase_key AS ase, CAST(coalesce(sum(qty), 0) AS BIGINT) AS value FROM vis GROUP BY region, ase_key),
r AS (SELECT region, CAST(row_number() OVER (PARTITION BY region ORDER BY value DESC, ase ASC) AS BIGINT) AS rank, ase, value FROM s)
SELECT * FROM r WHERE rank <= 10
"""
    ),
    "share_fractional": """
WITH c AS (SELECT l_returnflag AS label, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue FROM lineitem GROUP BY l_returnflag),
     w AS (SELECT label, revenue, CAST(revenue * 100 AS HUGEINT) AS v FROM c), t AS (SELECT CAST(sum(v) AS HUGEINT) AS total FROM w)
SELECT label, CAST(revenue AS DOUBLE) AS value, CAST((v * 2000 + total) // (2 * total) AS BIGINT) AS pct_tenths,
       CAST(CASE WHEN (v * 2000 + total) // (2 * total) >= 50 THEN 1 ELSE 0 END AS BIGINT) AS show_label
FROM w, t
""",
    "line_fractional": """
WITH m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue, count(*) AS lines
           FROM lineitem GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS x, strftime(d, '%-d-%b-%y') AS axis, 'revenue' AS series, CAST(revenue AS DOUBLE) AS value FROM m
UNION ALL SELECT strftime(d, '%Y-%m-%d'), strftime(d, '%-d-%b-%y'), 'lines', CAST(lines AS DOUBLE) FROM m
""",
    "top10_fractional": """
WITH s AS (SELECT r_name AS "Region", c_name AS "ASE Name", coalesce(CAST(c_acctbal AS DECIMAL(18,2)), 0) AS v
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "Region" ORDER BY v DESC, "ASE Name" ASC) AS BIGINT) AS rank FROM s)
SELECT "Region", rank, "ASE Name", CAST(v AS DOUBLE) AS value FROM r WHERE rank <= 10
""",
    "summary_fractional": """
SELECT c_mktsegment AS attendance_type, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS days,
       CASE WHEN sum(CAST(c_acctbal AS DECIMAL(18,2))) = 1000 THEN 'day' ELSE 'days' END AS unit
FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment <> '' GROUP BY c_mktsegment
""",
    "pivot_fractional": f"""
WITH cells AS (SELECT o_orderpriority AS attendance_type, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS date,
                      CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000 AS cnt FROM orders GROUP BY ALL)
SELECT attendance_type, {_rank_case('attendance_type', ATT_ORDER)} AS ordinal, date, strftime(CAST(date AS DATE), '%d-%b(%a)') AS header, cnt,
       sum(cnt) OVER (PARTITION BY date) AS col_total FROM cells
""",
    "pivot_salary_fractional": f"""
WITH cells AS (SELECT c_mktsegment AS impact, 'Nation ' || c_nationkey AS date,
                      coalesce(sum(CAST(c_acctbal AS DECIMAL(18,2))) FILTER (WHERE c_acctbal > 500), 0) AS cnt FROM customer GROUP BY ALL),
tot AS (SELECT *, sum(cnt) OVER (PARTITION BY date) AS t FROM cells)
SELECT impact, {_rank_case('impact', PAY_ORDER)} AS ordinal, date, date AS header, CAST(cnt AS DOUBLE) AS cnt, CAST(t AS DOUBLE) AS col_total,
       CAST(floor(CAST(cnt AS DOUBLE) / CAST(CASE WHEN t = 0 THEN 1 ELSE t END AS DOUBLE) * 100 + 0.5) AS BIGINT) AS pct FROM tot
""",
    "crosstab_fractional": """
SELECT c_mktsegment AS attendance_type, r_name AS region, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS cnt,
       CAST(grouping(c_mktsegment) AS BIGINT) AS g_attendance_type, CAST(grouping(r_name) AS BIGINT) AS g_region
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (c_mktsegment, r_name)
""",
    "pivot_location_fractional": """
WITH cells AS (SELECT l_linestatus AS category, strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS date,
                      sum(CAST(l_discount AS DECIMAL(18,2))) AS cnt FROM lineitem GROUP BY ALL)
SELECT category, date, CAST(cnt AS DOUBLE) AS cnt, CAST(sum(cnt) OVER (PARTITION BY date) AS DOUBLE) AS col_total FROM cells
""",
    "pivot_last_row": f"""
WITH c AS (SELECT event_type AS attendance_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, CAST(value AS DECIMAL(18,2)) AS cnt,
                  row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT attendance_type, {_rank_case('attendance_type', ATT_ORDER)} AS ordinal, date, strftime(CAST(date AS DATE), '%d-%b(%a)') AS header,
       CAST(coalesce(cnt, 0) AS DOUBLE) AS cnt, CAST(sum(coalesce(cnt, 0)) OVER (PARTITION BY date) AS DOUBLE) AS col_total FROM c WHERE rn = 1
""",
    "pivot_repeated_cells": """
WITH c AS (SELECT event_type AS category, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, max(coalesce(CAST(value AS DECIMAL(18,2)), 0)) AS cnt
           FROM events GROUP BY ALL)
SELECT category, date, CAST(cnt AS DOUBLE) AS cnt, CAST(sum(cnt) OVER (PARTITION BY date) AS DOUBLE) AS col_total FROM c
""",
    "top10_ascending": """
WITH r AS (SELECT r_name AS region, CAST(row_number() OVER (PARTITION BY r_name ORDER BY c_acctbal, c_custkey) AS BIGINT) AS rank, c_name AS ase,
                  CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS value
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT * FROM r WHERE rank <= 10
""",
    "top10_tied": """
WITH s AS (SELECT r_name AS region, c_name AS ase, CAST(floor(c_acctbal / 2500) AS BIGINT) AS value
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT region, CAST(row_number() OVER (PARTITION BY region ORDER BY value DESC, ase) AS BIGINT) AS rank, ase, value FROM s)
SELECT * FROM r WHERE rank <= 10
""",
    "stored_top10_latest": _v(
        """
, days AS (SELECT region, date_txt, count(*) AS value, min(date_d) AS day FROM vis
           WHERE date_d >= DATE '1995-03-01' AND date_d <= DATE '1995-08-31' GROUP BY region, date_txt),
ranked AS (SELECT region, CAST(row_number() OVER (PARTITION BY region ORDER BY day DESC, date_txt) AS BIGINT) AS rank, date_txt AS ase_day, value FROM days)
SELECT * FROM ranked WHERE rank <= 10
"""
    ),
    "dedupe_last_cell": """
WITH c AS (SELECT event_type AS row_key, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS col_key,
                  CAST(round(value * 100) AS BIGINT) AS cnt,
                  row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn
           FROM events)
SELECT row_key, col_key, cnt FROM c WHERE rn = 1
""",
    "category_domain": _a(
        f"""
SELECT category, {_rank_case('category', ATT_ORDER)} AS ordinal,
       CAST(CASE WHEN {_rank_case('category', ATT_ORDER)} IS NULL THEN 0 ELSE 1 END AS BIGINT) AS known
FROM (SELECT DISTINCT atype_n AS category FROM att) s
"""
    ),
    "cell_formats": _a(
        """
SELECT region, strftime(date_d, '%Y-%m-%d') AS date, strftime(date_d, '%-d-%b-%y') AS axis,
       strftime(date_d, '%-d-%b-%Y') AS cell, strftime(date_d, '%d-%b(%a)') AS header,
       regexp_replace(coalesce(region, 'All_Regions') || '_Dashboard_' || strftime(CAST(date_d AS TIMESTAMP), '%-d-%b-%Y_%-H%M'),
                      '\\s+', '_', 'g') AS file_name
FROM (SELECT DISTINCT region, date_d FROM att) p
"""
    ),
    "figure_formats": _v(
        """
SELECT region, CAST(sum(qty) AS BIGINT) AS qty, format('{:,}', CAST(sum(qty) AS BIGINT)) AS qty_text
FROM vis GROUP BY region
"""
    ),
    "sql_widget_channels": _a(
        """
SELECT channel_key AS channel, count(*) AS cnt, count(DISTINCT user_id) AS employees
FROM att WHERE region = 'ASIA' AND atype_key <> 'Not Marked' GROUP BY channel_key
"""
    ),
    "stored_widget_region_mix": _a(
        """
SELECT region, trim(attendance_type) AS attendance_type, count(*) AS cnt FROM att
WHERE attendance_date >= DATE '2024-01-10' AND attendance_date <= DATE '2024-01-20'
GROUP BY region, trim(attendance_type)
"""
    ),
    "stored_widget_share": _a(
        """
SELECT trim(attendance_type) AS attendance_type, count(*) AS cnt, (SELECT count(*) FROM att) AS whole FROM att
WHERE region = 'ASIA' AND lower(trim(type)) IN ('promoter', 'supervisor') GROUP BY trim(attendance_type)
"""
    ),
    "stored_widget_two_parts": _a(
        """
SELECT trim(channel) AS channel, count(*) AS n,
       count(*) FILTER (WHERE trim(channel) IN ('AUTOMOBILE', 'BUILDING') AND trim(attendance_type) IN ('Present', 'Leave')
                        AND attendance_date <= DATE '2024-01-20' AND CAST(user_id AS VARCHAR) ILIKE '%1%') AS k
FROM att GROUP BY channel
"""
    ),
    "stored_widget_literal": _a(
        """
SELECT region, count(*) AS cnt, 'attendance_fact {region_filter}' AS source FROM att
WHERE region IS NOT NULL AND trim(zse) = 'NATION_7' GROUP BY region
"""
    ),
    "stored_widget_visits": _v(
        """
SELECT trim(tier) AS tier, count(*) AS cnt FROM vis
WHERE trim(tier) IN ('Tier-N', 'Tier-R') AND date_d >= DATE '1996-01-01' AND date_d <= DATE '1997-06-30' AND ase_ho_id ILIKE '%2%'
GROUP BY trim(tier)
"""
    ),
    "stored_widget_raw_subquery": _a(
        """
SELECT region, count(*) AS cnt FROM att
WHERE lower(trim(type)) IN ('promoter', 'supervisor') AND attendance_date >= DATE '2024-01-10' AND attendance_date <= DATE '2024-01-20'
GROUP BY region
"""
    ),
    "stored_widget_text_day": _v(
        """
SELECT region, trim(channel) AS channel, count(*) AS cnt FROM vis
WHERE trim(date_txt) = '15-Mar-97' AND trim(tier) IN ('Tier-N', 'Tier-R', 'Tier-A') GROUP BY region, trim(channel)
"""
    ),
    "stored_widget_joined": _v(
        """
SELECT region, count(*) AS all_visits,
       count(*) FILTER (WHERE trim(channel) IN ('PROMO', 'ECONOMY') AND date_d >= DATE '1995-03-01' AND date_d <= DATE '1995-08-31') AS picked
FROM vis WHERE region IS NOT NULL GROUP BY region HAVING picked > 0
"""
    ),
    "page_visit_rows": _v(
        """
SELECT strftime(date_d, '%Y-%m-%d') AS day, region, ase_key AS ase, channel_key AS channel, CAST(qty AS BIGINT) AS qty FROM vis
ORDER BY date_d DESC NULLS LAST, vis.qty DESC NULLS LAST, region NULLS FIRST, ase_key NULLS FIRST, channel_key NULLS FIRST LIMIT 500 OFFSET 1000
"""
    ),
    "page_employee_rows": _a(
        """
SELECT coalesce(profile_picture, '') AS "Profile Picture", coalesce(employee_name, '') AS "Employee Name", coalesce(employee_id, '') AS "Employee ID",
       coalesce(CAST(user_id AS VARCHAR), '') AS "User ID", coalesce(gender, '') AS "Gender",
       coalesce(region, '') AS "Region", coalesce(type_key, '') AS "Type", coalesce(ase_key, '') AS "ASE",
       coalesce(zse_key, '') AS "ZSE", strftime(attendance_date, '%-d-%b-%Y') AS "Date",
       atype_n AS "Attendance Type",
       coalesce(strftime(check_in, '%-d-%b-%Y'), '') AS "Check In",
       coalesce(strftime(check_out, '%-d-%b-%Y'), '') AS "Check Out"
FROM att WHERE CAST(user_id AS VARCHAR) ILIKE '%12%'
ORDER BY attendance_date DESC NULLS LAST, CAST(user_id AS VARCHAR) NULLS FIRST LIMIT 20 OFFSET 20
"""
    ),
    "page_ase_list": _a(
        """
SELECT DISTINCT ase_key AS ase FROM att WHERE ase_key IS NOT NULL AND ase_key <> '' ORDER BY ase NULLS FIRST LIMIT 10 OFFSET 10
"""
    ),
    "payload_rows": _a(
        """
SELECT CAST(to_json({'region': region, 'attendance_type': atype_n, 'cnt': count(*)}) AS VARCHAR) AS json
FROM att GROUP BY region, atype_n
"""
    ),
    "profile_links": _a(
        """
SELECT user_id,
       CAST(CASE WHEN profile_picture IS NOT NULL AND profile_picture <> 'NA' AND starts_with(profile_picture, 'http') THEN 1 ELSE 0 END AS BIGINT) AS picture_ok,
       CAST(CASE WHEN regexp_matches(profile_picture, '^https?://.+\\.(jpg|jpeg|png|gif|webp)', 'i')
                   OR regexp_matches(profile_picture, 's3[^/]*amazonaws\\.com', 'i') THEN 1 ELSE 0 END AS BIGINT) AS image_link,
       CASE WHEN employee_name IS NULL OR employee_name = '' THEN '?' ELSE substr(employee_name, 1, 1) END AS initial
FROM (SELECT DISTINCT user_id, employee_name, profile_picture FROM att) e
"""
    ),
}
