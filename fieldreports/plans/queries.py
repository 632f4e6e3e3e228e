"""The registered queries: one per reported operator group.

Each query is a function of a :class:`FactSource` returning a lazy DataFrame
over the whole fact tables.  ``__spark_entry__.queries()`` exposes them as
``(spark, sf_dir) -> DataFrame``; ``plans.oracle`` holds the matching SQL.
The filter selections below are fixed example selections of a dashboard user.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldreports.functions.bands import normalise_attendance_type, ordinal_of
from fieldreports.functions.constants import ATTENDANCE_TYPE_ORDER, UNKNOWN_RANK
from fieldreports.functions.dates import axis_date, cell_date, file_stamp, iso_day, pivot_header
from fieldreports.functions.constants import EXPORT_ALL_REGIONS, EXPORT_INFIX
from fieldreports.functions.text import first_letter, is_image_url, underscored, usable_picture
from fieldreports.operators import facets as FC
from fieldreports.operators import pivots as PV
from fieldreports.operators import reports as RP
from fieldreports.operators.filters import AttendanceFilter, VisitFilter, days_between
from fieldreports.plans import registry
from fieldreports.plans import widgets as W
from fieldreports.plans.paging import Key, page, page_frame, pruned
from fieldreports.sources import FactSource, read_table

# ------------------------------------------------------------ selections

SPEC_FACETS_A = AttendanceFilter(
    region="ASIA", types=("Promoter",), date_from="2024-01-05", date_to="2024-01-20", user_id="1"
)
SPEC_FACETS_V = VisitFilter(region="EUROPE", tiers=("Tier-N",), date_from="1996-01-01", date_to="1996-06-30", user_id="1")

SPEC_ARRAYS = AttendanceFilter(zse="NATION_7", types=("",  "  "))
SPEC_REGION = AttendanceFilter(region="EUROPE")
SPEC_TYPES = AttendanceFilter(types=("PROMOTER", "", "  "))
SPEC_CHANNELS = AttendanceFilter(channels=(" AUTOMOBILE", "HOUSEHOLD"))
SPEC_ASE = AttendanceFilter(ase=" NATION_3-A1 ")
SPEC_ZSE = AttendanceFilter(zse="NATION_7")
SPEC_ATYPES = AttendanceFilter(atypes=("Present", "Half Day ", ""))
SPEC_DATES = AttendanceFilter(date_from="2024-01-10", date_to="2024-01-12")
SPEC_USER = AttendanceFilter(user_id=" 4 ")
SPEC_ALL_A = AttendanceFilter(
    region="AMERICA",
    types=("promoter", "Supervisor"),
    channels=("AUTOMOBILE", "BUILDING", "FURNITURE"),
    ase="All",
    zse=None,
    atypes=("Not Marked", "Leave", "Training", "Present"),
    date_from="2024-01-03",
    date_to="2024-01-27",
    user_id="1",
)

SPEC_TIER = VisitFilter(tiers=("Tier-R", " Tier-A "))
SPEC_TEXT_DATE = VisitFilter(date=" 15-Mar-97 ")
SPEC_DATE_RANGE = VisitFilter(date_from="1999-12-01", date_to="2000-01-31")
SPEC_VZSE = VisitFilter(zse=" NATION_5 ")
SPEC_VASE = VisitFilter(ase="Supplier#000000007 ")
SPEC_VUSER = VisitFilter(user_id="ho1")
SPEC_ALL_V = VisitFilter(
    region="AMERICA",
    ase="All",
    channels=("PROMO", "STANDARD", "ECONOMY"),
    tiers=("Tier-N", "Tier-R"),
    date_from="1996-01-01",
    date_to="1998-12-31",
    user_id="2",
)

SPEC_REGION_ASIA = AttendanceFilter(region="ASIA")
SPEC_EMPLOYEE = AttendanceFilter(user_id="12")
SPEC_SUMMARY = AttendanceFilter(user_id="7")


def _att(src: FactSource) -> DataFrame:
    return src.attendance()


def _vis(src: FactSource) -> DataFrame:
    return src.visits()


# ------------------------------------------------------------ dimension lists

def dim_regions(src):
    return FC.dimension_list(_att(src), "region", cells=src.cells("attendance"))


def dim_types(src):
    return FC.dimension_list(_att(src), "type", cells=src.cells("attendance"))


def dim_channels(src):
    return FC.dimension_list(_att(src), "channel", cells=src.cells("attendance"))


def dim_ases(src):
    return FC.dimension_list(_att(src), "ase", cells=src.cells("attendance"))


def dim_zses(src):
    return FC.dimension_list(_att(src), "zse", cells=src.cells("attendance"))


def dim_attendance_types(src):
    return FC.dimension_list(_att(src), "atype", cells=src.cells("attendance"))


def dim_zse_ase_pairs(src):
    return FC.zse_ase_pairs(_att(src), src.cells("attendance"))


# ------------------------------------------------------------ facets

def facets_attendance(src):
    return FC.facets_long(_att(src), AttendanceFilter(), cells=src.cells("attendance"))


def facets_attendance_filtered(src):
    return FC.facets_long(_att(src), SPEC_FACETS_A, cells=src.cells("attendance"))


def facets_attendance_exclude_self(src):
    return FC.facets_long(_att(src), SPEC_FACETS_A, exclude_self=True, cells=src.cells("attendance"))


def facets_visits(src):
    return FC.facets_long(_vis(src), VisitFilter(), cells=src.cells("visits"))


def facets_visits_filtered(src):
    return FC.facets_long(_vis(src), SPEC_FACETS_V, cells=src.cells("visits"))


def facets_visits_exclude_self(src):
    return FC.facets_long(_vis(src), SPEC_FACETS_V, exclude_self=True, cells=src.cells("visits"))


def facet_counts_wide(src):
    long = FC.facets_long(_att(src), SPEC_FACETS_A, cells=src.cells("attendance"))
    return FC.facet_sizes(long, [f.name for f in FC.ATTENDANCE_FACETS])


def facet_arrays(src):
    """The dimension facets under a filter as sorted arrays (an empty one where
    a facet has no option), as text."""
    names = [f.name for f in FC.ATTENDANCE_FACETS if f.slot is not None]
    wide = FC.facets_wide(FC.facets_long(_att(src), SPEC_ARRAYS, cells=src.cells("attendance")), names)
    return wide.select(*[F.concat(F.lit("["), F.array_join(n, ","), F.lit("]")).alias(n) for n in names])


# ------------------------------------------------------------ filters

def _by_type(src, spec):
    base = spec.apply(_att(src))
    return base.groupBy(F.col("atype_key").alias("attendance_type")).agg(F.count(F.lit(1)).cast("long").alias("cnt"))


def filter_region(src):
    return _by_type(src, SPEC_REGION)


def filter_types_ci(src):
    return _by_type(src, SPEC_TYPES)


def filter_channels(src):
    return _by_type(src, SPEC_CHANNELS)


def filter_ase(src):
    return _by_type(src, SPEC_ASE)


def filter_zse(src):
    return _by_type(src, SPEC_ZSE)


def filter_atypes(src):
    return _by_type(src, SPEC_ATYPES)


def filter_dates(src):
    return _by_type(src, SPEC_DATES)


def filter_user(src):
    return _by_type(src, SPEC_USER)


def filter_all_attendance(src):
    return _by_type(src, SPEC_ALL_A)


def _by_channel(src, spec):
    return W.vis_channel_volume(spec.apply(_vis(src)))


def visits_filter_tier(src):
    return _by_channel(src, SPEC_TIER)


def visits_filter_zse(src):
    return _by_channel(src, SPEC_VZSE)


def visits_filter_ase(src):
    return _by_channel(src, SPEC_VASE)


def visits_filter_text_date(src):
    return _by_channel(src, SPEC_TEXT_DATE)


def visits_filter_date_range(src):
    return _by_channel(src, SPEC_DATE_RANGE)


def visits_filter_user(src):
    return _by_channel(src, SPEC_VUSER)


def visits_filter_all(src):
    return _by_channel(src, SPEC_ALL_V)


# ------------------------------------------------------------ pivots

def _report(src, dashboard: str, widget_id: int, spec=None) -> DataFrame:
    """A finished report (both stages), through the widget dispatch."""
    if dashboard == "attendance":
        return registry.report(_att(src), spec or AttendanceFilter(), dashboard, widget_id, cells=src.cells("attendance"))
    return registry.report(_vis(src), spec or VisitFilter(), dashboard, widget_id, cells=src.cells("visits"))


def pivot_attendance_date(src):
    return _report(src, "attendance", 5)


def pivot_attendance_dense(src):
    """Dense grid: every type x every day of the fact, 0 where absent."""
    dense = PV.dense_grid(W.att_type_by_date(_att(src)), "attendance_type", "date")
    return PV.with_col_totals(dense, "date")


SPEC_MONTH = AttendanceFilter(date_from="2024-01-01", date_to="2024-01-31")


def pivot_attendance_wide(src):
    """Display form of the attendance pivot: one row per type, one column per
    day of the filter's range (0 where absent)."""
    days = [d.isoformat() for d in days_between(SPEC_MONTH.date_from, SPEC_MONTH.date_to)]
    return PV.to_wide(W.att_type_by_date(SPEC_MONTH.apply(_att(src))), "attendance_type", "date", days)


def crosstab_region(src):
    return _report(src, "attendance", 6)


def pivot_timing(src):
    return _report(src, "attendance", 7)


def pivot_salary(src):
    return _report(src, "attendance", 9)


def pivot_location_in(src):
    return _report(src, "field", 4)


def pivot_location_out(src):
    return _report(src, "field", 5)


def pivot_workhour(src):
    return _report(src, "field", 6)


# ------------------------------------------------------------ charts

def pie_share(src):
    return _report(src, "attendance", 2)


def visits_channel_share(src):
    return _report(src, "field", 1)


def visits_tier_bar(src):
    """Field bar widget: quantity per tier."""
    return _report(src, "field", 2)


def bar_trend(src):
    return _report(src, "attendance", 3)


def line_trend(src):
    return _report(src, "attendance", 4)


def kpi_cards(src):
    return _report(src, "attendance", 1)


def attendance_summary(src):
    """The day counts that the trend bar lists once an id is entered."""
    return registry.summary(_att(src), SPEC_SUMMARY, "attendance", 3, cells=src.cells("attendance"))


def employee_detail(src):
    return _report(src, "attendance", 8, SPEC_EMPLOYEE)


def employee_profile(src):
    return _report(src, "attendance", 15, SPEC_EMPLOYEE)


SPEC_DETAIL_V = VisitFilter(region="ASIA", channels=("PROMO", "SMALL"))


def visits_detail_table(src):
    """Field-style table widget: per-ASE visits and quantity as display text."""
    return _report(src, "field", 7, SPEC_DETAIL_V)


def top10_region_ase(src):
    return _report(src, "field", 3)


# ------------------------------------------------------------ fractional measures

def _money(column: str):
    return F.col(column).cast("decimal(18,2)")


def share_fractional(src):
    """Share of the revenue by return flag: shares of exact decimals."""
    lines = src.table("lineitem", ["l_returnflag", "l_extendedprice"])
    revenue = lines.groupBy("l_returnflag").agg(F.sum(_money("l_extendedprice")).alias("revenue"))
    return registry.render("attendance", "pie", revenue).withColumn("value", F.col("value").cast("double"))


def line_fractional(src):
    """Revenue and lines per shipping month: series of different types."""
    lines = src.table("lineitem", ["l_shipdate", "l_extendedprice"])
    months = lines.groupBy(F.trunc("l_shipdate", "month").alias("ship_date")).agg(
        F.sum(_money("l_extendedprice")).alias("revenue"), F.count(F.lit(1)).alias("lines")
    )
    return registry.render("attendance", "line", months).withColumn("value", F.col("value").cast("double"))


def top10_fractional(src):
    """Top ten balances per region; columns are found by their roles."""
    customer = src.table("customer", ["c_name", "c_nationkey", "c_acctbal"])
    nation = src.table("nation", ["n_nationkey", "n_regionkey"])
    region = src.table("region", ["r_regionkey", "r_name"])
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    frame = rows.select(F.col("r_name").alias("Region"), F.col("c_name").alias("ASE Name"), _money("c_acctbal").alias("Sales"))
    return registry.render("field", "top10_table", frame).withColumn("value", F.col("value").cast("double"))


def _as_doubles(report: DataFrame, *columns: str) -> DataFrame:
    return report.withColumns({c: F.col(c).cast("double") for c in columns})


def pivot_fractional(src):
    """Attendance pivot of thousands of revenue per priority and ordering month."""
    orders = src.table("orders", ["o_orderdate", "o_orderpriority", "o_totalprice"])
    cells = orders.groupBy(F.col("o_orderpriority").alias("attendance_type"), iso_day(F.trunc("o_orderdate", "month")).alias("date"))
    frame = cells.agg((F.sum(_money("o_totalprice")) / 1000).cast("decimal(28,5)").alias("cnt"))
    return _as_doubles(registry.render("attendance", "pivot", frame), "cnt", "col_total")


def pivot_salary_fractional(src):
    """Percent-of-day pivot over sums of balances, some of them negative and some NULL."""
    rows = src.table("customer", ["c_nationkey", "c_mktsegment", "c_acctbal"])
    cells = rows.groupBy(F.col("c_mktsegment").alias("impact"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("date"))
    frame = cells.agg(F.sum(F.when(F.col("c_acctbal") > 500, _money("c_acctbal"))).alias("cnt"))
    return _as_doubles(registry.render("attendance", "pivot_salary", frame), "cnt", "col_total")


def crosstab_fractional(src):
    """Region cross-tab of balances, with all totals."""
    customer = src.table("customer", ["c_nationkey", "c_mktsegment", "c_acctbal"])
    nation = src.table("nation", ["n_nationkey", "n_regionkey"])
    region = src.table("region", ["r_regionkey", "r_name"])
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    frame = rows.groupBy(F.col("c_mktsegment").alias("attendance_type"), F.col("r_name").alias("region")).agg(F.sum(_money("c_acctbal")).alias("cnt"))
    return _as_doubles(registry.render("attendance", "pivot_region", frame), "cnt")


def pivot_location_fractional(src):
    """Generic pivot of discounts (hundredths) per ship mode and shipping month."""
    lines = src.table("lineitem", ["l_shipdate", "l_linestatus", "l_discount"])
    cells = lines.groupBy(F.col("l_linestatus").alias("location"), iso_day(F.trunc("l_shipdate", "month")).alias("date"))
    return _as_doubles(registry.render("field", "pivot_location_in", cells.agg(F.sum(_money("l_discount")).alias("cnt"))), "cnt", "col_total")


# ------------------------------------------------------------ arrival order

def _events(src) -> DataFrame:
    return src.table("events", ["event_id", "ts", "user_id", "event_type", "value"])


def pivot_last_row(src):
    """Pivot of a frame in time order with a row for every event: a cell shows
    its last event's value, types that are no preset come as they arrive."""
    ordered = _events(src).orderBy("ts", "event_id")
    frame = ordered.select(iso_day(F.to_date("ts")).alias("date"), F.col("event_type").alias("attendance_type"), _money("value").alias("cnt"))
    return _as_doubles(registry.render("attendance", "pivot", frame), "cnt", "col_total")


def pivot_repeated_cells(src):
    """Pivot of a frame without an order: a repeated cell shows its largest value."""
    frame = _events(src).select(iso_day(F.to_date("ts")).alias("date"), F.col("event_type").alias("workhour"), _money("value").alias("cnt"))
    return _as_doubles(registry.render("field", "pivot_workhour", frame), "cnt", "col_total")


def _regional_customers(src) -> DataFrame:
    customer = src.table("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal"])
    nation = src.table("nation", ["n_nationkey", "n_regionkey"])
    region = src.table("region", ["r_regionkey", "r_name"])
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def top10_ascending(src):
    """Top-10 of a frame in ascending order: the first ten rows as returned."""
    rows = _regional_customers(src).orderBy("c_acctbal", "c_custkey")
    frame = rows.select(F.col("r_name").alias("region"), F.col("c_name").alias("ase"), _money("c_acctbal").alias("balance"))
    return _as_doubles(registry.render("field", "top10_table", frame), "value")


def top10_tied(src):
    """Top-10 of a frame without an order whose measures tie: ties go by name."""
    frame = _regional_customers(src).select(F.col("r_name").alias("region"), F.col("c_name").alias("ase"), F.floor(F.col("c_acctbal") / 2500).alias("step"))
    return registry.render("field", "top10_table", frame)


def stored_top10_latest(src):
    """Stored SQL with an ORDER BY of its own, shown as a top-10: the ten newest
    days of each region, whatever their quantity."""
    sql = (
        "SELECT region, date AS ase_day, count(*) AS visits, min(date_d) AS day FROM visit_fact WHERE 1=1 {date_filter} "
        "GROUP BY region, date ORDER BY day DESC, ase_day"
    )
    widgets = registry.widgets_from_catalog([_stored(41, sql) | {"chart_type": "top10_table"}], "visit_fact", "field")
    return registry.report(_vis(src), SPEC_STORED_SPAN, "field", 41, widgets)


def summary_fractional(src):
    """Balances by segment in thousands, as fractional day counts."""
    rows = src.table("customer", ["c_mktsegment", "c_acctbal"])
    days = rows.groupBy(F.col("c_mktsegment").alias("Attendance Type")).agg((F.sum(_money("c_acctbal")) / 1000).cast("decimal(28,6)").alias("Days"))
    return RP.attendance_summary(days).withColumn("days", F.col("days").cast("double"))


def dedupe_last_cell(src):
    """Last reading wins per (event type, day): the cell value of the latest
    event (by time, then id) of that type on that day."""
    ev = read_table(src.spark, src.sf_dir, "events", ["event_id", "ts", "event_type", "value"])
    cells = ev.select(
        F.col("event_type").alias("row_key"),
        iso_day(F.to_date("ts")).alias("col_key"),
        F.round(F.col("value") * 100).cast("long").alias("cnt"),
        PV.time_id_key("ts", "event_id").alias("seq"),
    )
    return PV.dedupe_last(cells, "row_key", "col_key", "seq")


def category_domain(src):
    seen = _att(src).select(normalise_attendance_type("attendance_type").alias("category")).distinct()
    return seen.select(
        "category",
        ordinal_of("category", ATTENDANCE_TYPE_ORDER).alias("ordinal"),
        ordinal_of("category", ATTENDANCE_TYPE_ORDER).isNotNull().cast("long").alias("known"),
    ).orderBy(F.coalesce(F.col("ordinal"), F.lit(UNKNOWN_RANK)), "category")


def cell_formats(src):
    """Display formats over every (region, day) of the fact: ISO key, axis
    label, table cell, pivot header and the export file name."""
    pairs = _att(src).select("region", "date_d").distinct()
    stamp = file_stamp(F.col("date_d").cast("timestamp_ntz"))
    region_part = F.coalesce(F.col("region"), F.lit(EXPORT_ALL_REGIONS))
    return pairs.select(
        F.col("region"),
        iso_day("date_d").alias("date"),
        axis_date("date_d").alias("axis"),
        cell_date("date_d").alias("cell"),
        pivot_header("date_d").alias("header"),
        underscored(F.concat(region_part, F.lit(EXPORT_INFIX), stamp)).alias("file_name"),
    )


def figure_formats(src):
    """Quantity per region with thousands separators."""
    agg = _vis(src).groupBy("region").agg(F.sum("qty").cast("long").alias("qty"))
    return agg.select("region", "qty", F.format_number("qty", 0).alias("qty_text"))


def profile_links(src):
    """Per employee: usable picture, image-link test and the avatar initial."""
    emp = _att(src).select("user_id", "employee_name", "profile_picture").distinct()
    pic = F.col("profile_picture")
    has_pic = usable_picture(pic)
    return emp.select(
        "user_id",
        F.coalesce(has_pic, F.lit(False)).cast("long").alias("picture_ok"),
        F.coalesce(is_image_url(pic), F.lit(False)).cast("long").alias("image_link"),
        first_letter("employee_name").alias("initial"),
    )


def sql_widget_channels(src):
    """A widget written as SQL text over the filtered fact, with a bound
    parameter (the catalog-SQL extension point, without text splicing)."""
    frame = registry.sql_frame(
        "SELECT channel_key AS channel, count(*) AS cnt, count(DISTINCT user_id) AS employees "
        "FROM {fact} WHERE atype_key <> :excluded GROUP BY channel_key",
        excluded="Not Marked",
    )
    return frame(SPEC_REGION_ASIA.apply(_att(src)))


# Stored widgets as the source application keeps them: SQL text naming the fact
# table, with filter slot tokens where their author wanted filters.
def _stored(widget_id: int, sql: str) -> dict:
    return {"id": widget_id, "widget_name": f"Stored {widget_id}", "chart_type": "table", "display_order": widget_id, "is_active": True, "sql_query": sql}


STORED_ATTENDANCE = (
    _stored(
        21,
        "SELECT region, trim(attendance_type) AS attendance_type, count(*) AS cnt "
        "FROM attendance_fact WHERE 1=1 {region_filter} {date_filter} GROUP BY region, trim(attendance_type)",
    ),
    _stored(
        22,
        "SELECT trim(attendance_type) AS attendance_type, count(*) AS cnt, (SELECT count(*) FROM attendance_fact) AS whole "
        "FROM attendance_fact WHERE 1=1 {region_filter} {type_filter} GROUP BY trim(attendance_type)",
    ),
    _stored(
        23,
        "WITH every AS (SELECT channel, count(*) AS n FROM attendance_fact GROUP BY channel), "
        "picked AS (SELECT f.channel, count(*) AS k FROM public.attendance_fact f WHERE 1=1 {channel_filter} {atype_filter} {date_filter} "
        "{user_filter} GROUP BY f.channel) "
        "SELECT trim(every.channel) AS channel, n, coalesce(k, 0) AS k FROM every LEFT JOIN picked ON every.channel = picked.channel",
    ),
    _stored(
        24,
        "SELECT region, count(*) AS cnt, 'attendance_fact {region_filter}' AS source FROM attendance_fact "
        "WHERE region <> 'attendance_fact' {zse_filter} {ase_filter} /* attendance_fact {zse_filter} */ GROUP BY region",
    ),
    _stored(
        26,
        "SELECT region, count(*) AS cnt FROM (SELECT region, type, attendance_date FROM attendance_fact) AS s "
        "WHERE 1=1 {date_filter} {type_filter} GROUP BY region",
    ),
    {"id": 25, "widget_name": "Broken", "chart_type": "pie", "display_order": 9, "is_active": True, "sql_query": "SELECT nothing FROM nowhere"},
)
STORED_VISITS = (
    _stored(
        31,
        "SELECT trim(tier) AS tier, count(*) AS cnt FROM visit_fact "
        "WHERE 1=1 {region_filter} {tier_filter} {channel_filter} {date_filter} {user_filter} GROUP BY trim(tier)",
    ),
)
STORED_VISITS += (
    _stored(
        32,
        "SELECT s.region, trim(s.channel) AS channel, count(*) AS cnt FROM (SELECT f.*, upper(tier) AS loud FROM visit_fact f) AS s "
        "WHERE 1=1 {date_filter} {tier_filter} {zse_filter} GROUP BY s.region, trim(s.channel)",
    ),
    _stored(
        33,
        "SELECT a.region, a.n AS all_visits, b.n AS picked FROM (SELECT region, count(*) AS n FROM visit_fact GROUP BY region) AS a "
        "JOIN (SELECT region, count(*) AS n FROM visit_fact WHERE 1=1 {date_filter} {channel_filter} GROUP BY region) AS b ON a.region = b.region",
    ),
)
SPEC_STORED = AttendanceFilter(types=("promoter",), date_from="2024-01-10", date_to="2024-01-20")
SPEC_STORED_SHARE = AttendanceFilter(region="ASIA", types=("Promoter ", "supervisor"), date_from="2024-01-10")
SPEC_STORED_LISTS = AttendanceFilter(channels=(" AUTOMOBILE", "BUILDING"), atypes=("Present", "Leave"), date_to="2024-01-20", user_id="1")
SPEC_STORED_PLAIN = AttendanceFilter(region="EUROPE", zse="NATION_7", ase="All")
SPEC_STORED_RANGE = AttendanceFilter(types=("promoter", "SUPERVISOR"), date_from="2024-01-10", date_to="2024-01-20")
SPEC_STORED_TEXT_DAY = VisitFilter(date=" 15-Mar-97", tiers=("Tier-N", "Tier-R", "Tier-A"))
SPEC_STORED_SPAN = VisitFilter(channels=("PROMO", "ECONOMY"), date_from="1995-03-01", date_to="1995-08-31")
SPEC_STORED_VISITS = VisitFilter(tiers=("Tier-N", "Tier-R"), date_from="1996-01-01", date_to="1997-06-30", user_id="2")


def _stored_data(src, widget_id: int, spec) -> DataFrame:
    widgets = registry.widgets_from_catalog(STORED_ATTENDANCE, "attendance_fact", "attendance")
    return registry.widget_data(_att(src), spec, "attendance", widget_id, widgets)


def stored_widget_region_mix(src):
    """Stored SQL without a type slot: the type selection is ignored while the
    date range applies."""
    return _stored_data(src, 21, SPEC_STORED)


def stored_widget_share(src):
    """Stored SQL that reads the fact twice: only one place has slots."""
    return _stored_data(src, 22, SPEC_STORED_SHARE)


def stored_widget_two_parts(src):
    """Stored SQL with list, date and id slots in one of two common table expressions."""
    return _stored_data(src, 23, SPEC_STORED_LISTS)


def stored_widget_literal(src):
    """Stored SQL with the table's name and a token inside texts and comments."""
    return _stored_data(src, 24, SPEC_STORED_PLAIN)


def _stored_visits(src, widget_id: int, spec) -> DataFrame:
    widgets = registry.widgets_from_catalog(STORED_VISITS, "visit_fact", "field")
    return registry.widget_data(_vis(src), spec, "field", widget_id, widgets)


def stored_widget_visits(src):
    """Stored SQL over the field-activity fact, text dates included."""
    return _stored_visits(src, 31, SPEC_STORED_VISITS)


def stored_widget_raw_subquery(src):
    """Stored SQL whose slots stand over a subquery of raw columns only."""
    return _stored_data(src, 26, SPEC_STORED_RANGE)


def stored_widget_text_day(src):
    """Stored SQL whose slots stand over a subquery of all columns, with an exact text date."""
    return _stored_visits(src, 32, SPEC_STORED_TEXT_DAY)


def stored_widget_joined(src):
    """Stored SQL that joins two readings of the fact, one of them with slots."""
    return _stored_visits(src, 33, SPEC_STORED_SPAN)


# ------------------------------------------------------------ pages

def _nth_page(df: DataFrame, order, size: int, n: int) -> DataFrame:
    """Page ``n``, reached by the tokens of those before it."""
    token = None
    for _ in range(n - 1):
        token = page(df, order, size, token).next
        if token is None:
            return df.limit(0)
    return page_frame(pruned(df, order, token), order, size, token)


def page_visit_rows(src):
    """The third page of visit rows, newest day and largest quantity first."""
    rows = _vis(src).select("date_d", "year", "region", F.col("ase_key").alias("ase"), F.col("channel_key").alias("channel"), F.col("qty").cast("long").alias("qty"))
    third = _nth_page(rows, (Key("date_d", True, "date_d"), Key("qty", True)), 500, 3)
    return third.select(iso_day("date_d").alias("day"), "region", "ase", "channel", "qty")


def page_employee_rows(src):
    """The second page of the employee table under an id search, as displayed."""
    w = registry.lookup("attendance", 8)
    frame = registry.widget_data(_att(src), SPEC_EMPLOYEE, "attendance", 8)
    return RP.table_cells(_nth_page(frame, w.pages_by, 20, 2), "attendance")


def page_ase_list(src):
    """The second page of the sorted ASE options."""
    return _nth_page(FC.dimension_list(_att(src), "ase", cells=src.cells("attendance")), (), 10, 2)


def payload_rows(src):
    """JSON rows of the region cross-tab widget result (row objects)."""
    from fieldreports.plans.sinks import payload_rows as _payload

    return _payload(W.att_type_by_region(_att(src)))


QUERIES: dict[str, Callable[[FactSource], DataFrame]] = {
    f.__name__: f
    for f in (
        dim_regions,
        dim_types,
        dim_channels,
        dim_ases,
        dim_zses,
        dim_attendance_types,
        dim_zse_ase_pairs,
        facets_attendance,
        facets_attendance_filtered,
        facets_attendance_exclude_self,
        facets_visits,
        facets_visits_filtered,
        facets_visits_exclude_self,
        facet_counts_wide,
        facet_arrays,
        filter_region,
        filter_types_ci,
        filter_channels,
        filter_ase,
        filter_zse,
        filter_atypes,
        filter_dates,
        filter_user,
        filter_all_attendance,
        visits_filter_tier,
        visits_filter_zse,
        visits_filter_ase,
        visits_filter_text_date,
        visits_filter_date_range,
        visits_filter_user,
        visits_filter_all,
        pivot_attendance_date,
        pivot_attendance_dense,
        pivot_attendance_wide,
        crosstab_region,
        pivot_timing,
        pivot_salary,
        pivot_location_in,
        pivot_location_out,
        pivot_workhour,
        pie_share,
        visits_channel_share,
        bar_trend,
        visits_tier_bar,
        line_trend,
        kpi_cards,
        attendance_summary,
        employee_detail,
        employee_profile,
        visits_detail_table,
        top10_region_ase,
        share_fractional,
        line_fractional,
        top10_fractional,
        summary_fractional,
        dedupe_last_cell,
        category_domain,
        cell_formats,
        figure_formats,
        profile_links,
        sql_widget_channels,
        stored_widget_region_mix,
        stored_widget_share,
        stored_widget_two_parts,
        stored_widget_literal,
        stored_widget_visits,
        stored_widget_raw_subquery,
        stored_widget_text_day,
        stored_widget_joined,
        pivot_fractional,
        pivot_salary_fractional,
        crosstab_fractional,
        pivot_location_fractional,
        pivot_last_row,
        pivot_repeated_cells,
        top10_ascending,
        top10_tied,
        stored_top10_latest,
        page_visit_rows,
        page_employee_rows,
        page_ase_list,
        payload_rows,
    )
}
