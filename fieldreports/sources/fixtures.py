"""The two fact tables the dashboards read, derived from the driver tables.

``attendance``: one row per employee and calendar day (roster x calendar),
left-joined to that day's events, so days without any event are ``Not Marked``.
``outlet_visits``: one row per line item with its supplier's geography.

Both are lazy plans.  The roster x calendar grain is produced without a cross
join: every employee explodes the list of days that occur (one scalar subquery;
a calendar has few thousand days, and a stray one adds one, not a range).
Dimension joins of ``attendance`` are left to the planner: the small sides
(nation, region, distinct days) are broadcast by Spark's own size check, larger
ones shuffle.  ``outlet_visits`` has many rows and two dimensions that grow, so it
sends a dimension of bounded size and hash-joins a larger one without sorting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldreports.functions.bands import workhour_band
from fieldreports.functions.constants import NOT_MARKED
from fieldreports.sources.tables import read_table

# Fixed values of the fixture: first event type of the day -> attendance type
# (alphabetical minimum of the day's event types; anything else is "Leave").
EVENT_TO_ATTENDANCE = (
    ("view", "Present "),
    ("click", "Gate Meeting"),
    ("signup", "Training"),
    ("purchase", "Half Day"),
)
OTHER_EVENT_ATTENDANCE = "Leave"
_KNOWN_EVENTS = tuple(sorted(e for e, _ in EVENT_TO_ATTENDANCE))
PICTURE_URL_PREFIX = "http://images.example.org/"
WORKHOUR_EDGES = (4, 6, 8)  # hours = quantity / 5
#: A dimension of at most so many rows (by its files' footers) is sent to all executors.
SENT_ROWS = 500_000


def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per employee and day: first event-type rank, first and last event time,
    number of events (one pass over ``events``)."""
    ev = read_table(spark, sf_dir, "events", ["user_id", "ts", "event_type"])
    # The day's alphabetically first event type decides its attendance type.
    # A text minimum forces a sort-based aggregate, so each event type is
    # mapped to an integer rank that preserves exactly that decision: known
    # type number j -> 2j, any other text between known j-1 and j -> 2j-1.
    # min(rank) is then a hash aggregate with map-side combine.
    et = F.col("event_type")
    below = sum((F.lit(k) < et).cast("int") for k in _KNOWN_EVENTS)
    rank = F.when(et.isin(list(_KNOWN_EVENTS)), below * 2).otherwise(below * 2 - 1)
    return (
        ev.select("user_id", "ts", F.to_date("ts").alias("d"), rank.alias("type_rank"))
        .groupBy("user_id", "d")
        .agg(
            F.min("type_rank").alias("first_rank"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.count(F.lit(1)).alias("n_events"),
        )
    )


def attendance(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """Raw attendance fact (dirty dimensions kept, as stored upstream).

    ``daily`` may be a written copy of :func:`daily_events`; the calendar and
    the roster are then read from it instead of from ``events``
    (ingest writes it once so ``events`` is scanned once).
    """
    if daily is None:
        daily = daily_events(spark, sf_dir)
    known = _KNOWN_EVENTS
    days = daily.select("d").distinct().agg(F.collect_list("d")).scalar()

    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    geo = _geography(spark, sf_dir)
    users = daily.select("user_id").distinct()
    roster = users.join(customer, users.user_id == customer.c_custkey).join(
        geo, customer.c_nationkey == geo.n_nationkey
    )

    uid = F.col("user_id")
    m3 = uid % 3
    roster = roster.select(
        "user_id",
        F.when(F.col("c_custkey") % 29 == 0, F.lit(None).cast("string")).otherwise(F.col("r_name")).alias("region"),
        F.when(uid % 17 == 0, F.lit(None).cast("string"))
        .when(uid % 19 == 0, F.lit("  "))
        .when(m3 == 0, F.lit(" Promoter "))
        .when(m3 == 1, F.lit("PROMOTER"))
        .otherwise(F.lit("Supervisor"))
        .alias("type"),
        F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ")).alias("channel"),
        F.concat(F.col("n_name"), F.lit(" ")).alias("zse"),
        F.concat(F.col("n_name"), F.lit("-A"), m3.cast("string")).alias("ase"),
        F.col("c_name").alias("employee_name"),
        F.concat(F.lit("E"), uid.cast("string")).alias("employee_id"),
        F.when(uid % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"),
        F.when(m3 == 0, F.lit("NA"))
        .when(m3 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(PICTURE_URL_PREFIX), uid.cast("string"), F.lit(".png")))
        .alias("profile_picture"),
    )

    grid = roster.withColumn("d", F.explode(days))
    joined = grid.join(daily, ["user_id", "d"], "left")

    fr = F.col("first_rank")
    label_of = dict(EVENT_TO_ATTENDANCE)
    atype = F.when(fr.isNull(), F.lit(NOT_MARKED))
    for j, event in enumerate(known):
        atype = atype.when(fr == 2 * j, F.lit(label_of[event]))
    atype = atype.otherwise(F.lit(OTHER_EVENT_ATTENDANCE))

    return joined.select(
        "user_id",
        "region",
        "type",
        "channel",
        "zse",
        "ase",
        atype.alias("attendance_type"),
        F.col("d").alias("attendance_date"),
        F.col("first_ts").alias("check_in"),
        F.when(F.col("n_events") > 1, F.col("last_ts")).alias("check_out"),
        "employee_name",
        "employee_id",
        "gender",
        "profile_picture",
    )


def _is_small(spark: SparkSession, sf_dir: str, name: str) -> bool:
    return read_table(spark, sf_dir, name).count() <= SENT_ROWS


def _joinable(dimension: DataFrame, small: bool) -> DataFrame:
    """A small dimension is sent; of a larger one each task holds its share, and
    the fact's rows stream past it: neither side is sorted, so nothing spills."""
    return F.broadcast(dimension) if small else dimension.hint("shuffle_hash")


def visit_stages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The field-activity fact as narrow rows and the step that widens them:
    ``outlet_visits`` is the second applied to the first.

    A writer moves the narrow rows, which have ``day`` and the keys and codes of a
    line item, and widens them where they have arrived: the second step moves no row.
    So it has the supplier's join only if the supplier is sent; else that join,
    which shuffles, belongs to the first step.
    """
    li = read_table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_type"])
    pk = F.col("l_partkey")
    channel = F.when(pk % 23 == 0, F.lit(None).cast("string")).when(pk % 31 == 0, F.lit("")).otherwise(F.concat(F.col("p_type"), F.lit(" ")))
    lines = li.withColumn("day", F.to_date("l_shipdate")).drop("l_shipdate")  # the text date has no time of day
    lines = lines.join(_joinable(part, _is_small(spark, sf_dir, "part")), pk == F.col("p_partkey"))
    lines = lines.select("l_suppkey", channel.alias("channel"), "l_quantity", "l_returnflag", "l_linestatus", "day")

    supplier = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    geo = _geography(spark, sf_dir)
    supplier = supplier.join(F.broadcast(geo), supplier.s_nationkey == geo.n_nationkey).drop("s_nationkey", "n_nationkey")
    sent = _is_small(spark, sf_dir, "supplier")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(_joinable(supplier, sent), F.col("l_suppkey") == F.col("s_suppkey"))

    if sent:
        return lines, lambda rows: _visit_texts(placed(rows))
    return placed(lines).drop("l_suppkey"), _visit_texts


def _visit_texts(v: DataFrame) -> DataFrame:
    return v.select(
        F.col("r_name").alias("region"),
        F.concat(F.col("n_name"), F.lit(" ")).alias("zse"),
        F.concat(F.lit(" "), F.col("s_name")).alias("ase"),
        "channel",
        F.concat(F.lit(" Tier-"), F.col("l_returnflag")).alias("tier"),
        visit_date("day").alias("date_txt"),
        F.concat(F.lit("HO"), F.col("s_suppkey").cast("string")).alias("ase_ho_id"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.col("l_linestatus").alias("location_in"),
        F.col("l_returnflag").alias("location_out"),
        workhour_band(F.col("l_quantity") / 5, WORKHOUR_EDGES).alias("workhour"),
    )


def visit_date(day) -> Column:
    """The text date of the field-activity fact."""
    return F.date_format(day, "dd-MMM-yy")


def outlet_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw field-activity fact, one row per line item (text dates, padded keys)."""
    rows, widened = visit_stages(spark, sf_dir)
    return widened(rows)
