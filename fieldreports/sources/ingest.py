"""Typed ingest: normalised key columns, year partitioning, readers/writers.

Predicates such as ``trim(channel) = 'X'`` cannot reach a Parquet scan.  So the
trimmed / lower-cased / parsed forms are computed once here as plain columns
(``*_key``, ``type_ci``, ``date_d``) next to the raw ones; filters and reports
use only those, and on a written table they push down as ``PushedFilters``.
Date ranges prune by directory (``year``) and, inside a year, by file: files
hold narrow ranges of days, so the min/max statistics of all others skip them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldreports.functions.dates import parse_dd_mon_yy


#: A task sorts about so many rows where their number is known beforehand.
ROWS_PER_TASK = 400_000


def year_key(d) -> "F.Column":
    """Calendar year as the integer partition key (NULL dates -> NULL partition)."""
    return F.year(d).cast("int")


def normalise_attendance(df: DataFrame) -> DataFrame:
    d = F.col("attendance_date").cast("date")
    return df.select(
        "*",
        F.trim("type").alias("type_key"),
        F.lower(F.trim("type")).alias("type_ci"),
        F.trim("channel").alias("channel_key"),
        F.trim("ase").alias("ase_key"),
        F.trim("zse").alias("zse_key"),
        F.trim("attendance_type").alias("atype_key"),
        d.alias("date_d"),
        F.col("user_id").cast("string").alias("user_txt"),
        year_key(d).alias("year"),
    )


def normalise_visits(df: DataFrame) -> DataFrame:
    date_key = F.trim("date_txt")
    d = visit_day("date_txt")
    return df.select(
        "*",
        F.trim("zse").alias("zse_key"),
        F.trim("ase").alias("ase_key"),
        F.trim("channel").alias("channel_key"),
        F.trim("tier").alias("tier_key"),
        date_key.alias("date_key"),
        d.alias("date_d"),
        year_key(d).alias("year"),
    )


def visit_day(date_txt) -> Column:
    return parse_dd_mon_yy(F.trim(date_txt))


def ranged(df: DataFrame, keys: Sequence[str | Column], n_rows: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of ``keys``: into the session's number of shuffle
    partitions, or more if ``n_rows`` rows would be too many a task to be sorted
    in memory."""
    n = -(-(n_rows or 0) // ROWS_PER_TASK)
    more = n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys) if more else df.repartitionByRange(*keys)


def write_fact(
    df: DataFrame,
    path: str,
    partition_col: str = "year",
    sort_col: str = "date_d",
    mode: str = "error",
    shuffle: bool = True,
    day: Column | None = None,
    widened: Callable[[DataFrame], DataFrame] | None = None,
    n_rows: int | None = None,
) -> str:
    """Write a normalised fact as Parquet by year, in files of narrow day ranges.

    With ``shuffle`` (default) rows are range-partitioned by (year, day, spread),
    ``spread`` a hash of the whole row: tasks get neighbouring days, and a hot day
    is split over several tasks instead of landing in one.  Reading the ranges
    costs a sampling pass over the input's last shuffle; the rows themselves are
    shuffled once, and AQE merges small neighbours.  For input that already
    arrives in time order (append-only facts), ``shuffle=False`` lets every scan
    task write its own files directly.

    With ``widened``, ``df`` has narrow rows: these are shuffled (``day`` gives
    their day), and ``widened``, which moves no row, makes the fact's columns of
    them in the tasks that write.  ``n_rows``: about how many rows there are.

    Each task sorts its rows by (year, day), so it writes one file at a time.
    Spark's commit protocol makes the write safe against lost executors (failed
    tasks are retried; only committed task output becomes visible).  The written
    table also cuts lineage.
    """
    spread = F.xxhash64(*[F.col(c) for c in df.columns])
    keys = [partition_col, sort_col] if day is None else [year_key(day), day]
    out = ranged(df, [*keys, spread], n_rows) if shuffle else df
    out = out if widened is None else widened(out)
    (
        out.sortWithinPartitions(partition_col, sort_col)
        .write.mode(mode)
        .option("maxRecordsPerFile", 20_000_000)
        .partitionBy(partition_col)
        .parquet(path)
    )
    return path


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower_bound: int,
    upper_bound: int,
    num_partitions: int,
    properties: dict | None = None,
) -> DataFrame:
    """Parallel JDBC scan of a fact table kept in a relational database.

    The URL and credentials are passed in by the caller; nothing is stored.
    ``partition_column`` splits the scan into ``num_partitions`` range reads.
    (Not exercised here: there is no database in this environment.)
    """
    return spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=lower_bound,
        upperBound=upper_bound,
        numPartitions=num_partitions,
        properties=properties or {},
    )

