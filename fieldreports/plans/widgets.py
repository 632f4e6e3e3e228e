"""Widget frames: what each dashboard widget computes from the filtered fact.

The dashboards keep each widget's SQL in a database table that is not
available; only the result contracts (column names and category labels the
second-stage reports read) are known.  These frames honour those contracts.
Each takes the already-filtered fact, or cells of it that have the columns it
reads (``sources.cells``), and returns a lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldreports.functions.bands import impact_band, normalise_attendance_type, timing_band
from fieldreports.functions.constants import NOT_MARKED
from fieldreports.functions.dates import iso_day
from fieldreports.sources.cells import ROWS, column_of, records, records_where

def _counted(base: DataFrame, out: str = "cnt", **keys: Column) -> DataFrame:
    """Rows of the fact by keys."""
    weight = [ROWS] if ROWS in base.columns else []
    keyed = base.select(*[k.alias(n) for n, k in keys.items()], *weight)
    return keyed.groupBy(*keys).agg(records(keyed).alias(out))


def _checked_in(base: DataFrame) -> Column:
    return (F.coalesce(F.sum("_n_check_in"), F.lit(0)) if ROWS in base.columns else F.count("check_in")).cast("long")


# ------------------------------------------------------------ attendance side


def att_key_figures(base: DataFrame) -> DataFrame:
    """One row of headline figures (kpi)."""
    atype = normalise_attendance_type("attendance_type")
    return base.agg(
        F.countDistinct("user_id").cast("long").alias("employees"),
        records(base).alias("records"),
        _checked_in(base).alias("checked_in"),
        records_where(base, atype == NOT_MARKED).alias("not_marked"),
    )


def att_mix(base: DataFrame) -> DataFrame:
    """Rows per attendance type (pie)."""
    return _counted(base, attendance_type=normalise_attendance_type("attendance_type"))


def att_trend(base: DataFrame) -> DataFrame:
    """Days per attendance type, named as the summary pills read them (bar)."""
    return _counted(base, "Days", **{"Attendance Type": normalise_attendance_type("attendance_type")})


def att_daily(base: DataFrame) -> DataFrame:
    """Per day: marked records, check-ins, all records (line)."""
    atype = normalise_attendance_type("attendance_type")
    return base.groupBy(F.col("date_d").alias("date")).agg(
        records_where(base, atype != NOT_MARKED).alias("marked"), _checked_in(base).alias("checked_in"), records(base).alias("records")
    )


def att_type_by_date(base: DataFrame) -> DataFrame:
    """``(date, attendance_type, cnt)`` (pivot)."""
    return _counted(base, date=iso_day("date_d"), attendance_type=normalise_attendance_type("attendance_type"))


def att_type_by_region(base: DataFrame) -> DataFrame:
    """``(region, attendance_type, cnt)`` (pivot_region)."""
    return _counted(base, region=F.col("region"), attendance_type=normalise_attendance_type("attendance_type"))


def att_timing_by_date(base: DataFrame) -> DataFrame:
    """``(date, timing, cnt)`` (pivot_timing)."""
    return _counted(base, date=iso_day("date_d"), timing=column_of(base, "timing", timing_band("check_in")))


def att_impact_by_date(base: DataFrame) -> DataFrame:
    """``(date, impact, cnt)`` (pivot_salary)."""
    return _counted(base, date=iso_day("date_d"), impact=column_of(base, "impact", impact_band("check_in", "check_out")))


def att_employee_rows(base: DataFrame) -> DataFrame:
    """Employee day rows with display names (table / profile source)."""
    return base.select(
        F.col("profile_picture").alias("Profile Picture"),
        F.col("employee_name").alias("Employee Name"),
        F.col("employee_id").alias("Employee ID"),
        F.col("user_id").cast("string").alias("User ID"),
        F.col("gender").alias("Gender"),
        F.col("region").alias("Region"),
        F.col("type_key").alias("Type"),
        F.col("ase_key").alias("ASE"),
        F.col("zse_key").alias("ZSE"),
        F.col("date_d").alias("Date"),
        normalise_attendance_type("attendance_type").alias("Attendance Type"),
        F.col("check_in").alias("Check In"),
        F.col("check_out").alias("Check Out"),
    )


def att_employees(base: DataFrame) -> DataFrame:
    """One employee, the newest day's values first (profile)."""
    return att_employee_rows(base).orderBy(F.col("Date").desc(), F.col("`User ID`").asc()).drop("Date", "Attendance Type", "Check In", "Check Out")


# ------------------------------------------------------------ field side


def vis_channel_mix(base: DataFrame) -> DataFrame:
    """``(channel, cnt)`` (pie)."""
    return _counted(base, channel=F.col("channel_key"))


def vis_channel_volume(base: DataFrame) -> DataFrame:
    """``(channel, cnt, qty)``: visits and quantity per channel."""
    return base.groupBy(F.col("channel_key").alias("channel")).agg(
        records(base).alias("cnt"), F.sum("qty").cast("long").alias("qty")
    )


def vis_tier_volume(base: DataFrame) -> DataFrame:
    """``(tier, qty)`` (bar)."""
    return base.groupBy(F.col("tier_key").alias("tier")).agg(F.sum("qty").cast("long").alias("qty"))


def vis_detail(base: DataFrame) -> DataFrame:
    """Per ASE: visits and quantity (table)."""
    return base.groupBy(
        "region", F.col("zse_key").alias("zse"), F.col("ase_key").alias("ase"), "ase_ho_id"
    ).agg(records(base).alias("visits"), F.sum("qty").cast("long").alias("qty"))


def vis_ase_volume(base: DataFrame) -> DataFrame:
    """``(region, ase, qty)``: rank measure per region and ASE (top10_table)."""
    return base.groupBy("region", F.col("ase_key").alias("ase")).agg(F.sum("qty").cast("long").alias("qty"))


def vis_category_by_date(base: DataFrame, category_col: str, name: str) -> DataFrame:
    """``(date, <name>, cnt)`` with the text date as the column key
    (pivot_location_in / pivot_location_out / pivot_workhour)."""
    return _counted(base, **{"date": F.col("date_key"), name: F.col(category_col)})
