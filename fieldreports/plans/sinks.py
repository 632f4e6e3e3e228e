"""Sinks: row-object payloads, export naming and report writers."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldreports.functions.constants import ALL, EXPORT_ALL_REGIONS, EXPORT_INFIX


def _check_unique(df: DataFrame) -> None:
    seen = set()
    for c in df.columns:
        if c in seen:
            raise ValueError(f"duplicate column name {c!r} in payload")
        seen.add(c)


def payload_columns(df: DataFrame) -> list[str]:
    """The ordered column list of the payload (schema only, no scan)."""
    _check_unique(df)
    return list(df.columns)


def json_of(schema: T.StructType) -> Column:
    """A row's JSON object, keys in column order, NULLs kept as ``null``.

    Dates are widened to timestamps first so they serialise as ISO date-times
    (``2024-01-05T00:00:00.000``), the form the dashboards parse.
    """
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return F.to_json(
        F.struct(*cols),
        {
            "ignoreNullFields": "false",
            "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
            "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
        },
    )


def payload_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row (:func:`json_of`)."""
    _check_unique(df)
    return df.select(json_of(df.schema).alias("json"))


@dataclass(frozen=True)
class Pages:
    """The rows of a result, page by page in the order of the frame.

    Nothing is limited: rows come from the executors one partition at a time
    while pages are read, and only the page at hand is kept here.
    """

    columns: list[str]
    frame: DataFrame
    size: int = 10_000

    def rows(self) -> Iterator[dict]:
        for line in payload_rows(self.frame).toLocalIterator():
            yield json.loads(line["json"])

    def __iter__(self) -> Iterator[list[dict]]:
        page: list[dict] = []
        for row in self.rows():
            page.append(row)
            if len(page) == self.size:
                yield page
                page = []
        if page:
            yield page


def pages(df: DataFrame, size: int = 10_000) -> Pages:
    """A result of any size (detail tables, id lists) as pages of row objects."""
    return Pages(payload_columns(df), df, size)


def payload(df: DataFrame) -> dict:
    """``{"columns": [...], "rows": [{...}, ...]}`` of a report, all its rows.

    For aggregated reports, whose rows are categories and days; results that
    grow with the fact are read with :func:`pages` or written.
    """
    return {"columns": payload_columns(df), "rows": list(pages(df).rows())}


def column_list(df: DataFrame, column: str) -> list:
    """One column of a sorted result as a Python list."""
    return [r[0] for r in df.select(column).toLocalIterator()]


def export_name(region: str | None, at: dt.datetime, ext: str) -> str:
    """``{region or All_Regions}_Dashboard_{d-Mon-yyyy_Hmm}.{ext}`` with
    whitespace runs turned into underscores.  The clock is an argument."""
    label = region if region and region != ALL else EXPORT_ALL_REGIONS
    stamp = f"{at.day}-{at.strftime('%b')}-{at.year}_{at.hour}{at.minute:02d}"
    return re.sub(r"\s+", "_", f"{label}{EXPORT_INFIX}{stamp}") + f".{ext}"


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> str:
    """Write a report result (parquet, csv with header, or json lines)."""
    w = df.write.mode(mode)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.option("header", "true").csv(path)
    elif fmt == "json":
        w.option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return path


def export_report(df: DataFrame, folder: str, region: str | None, at: dt.datetime, fmt: str = "csv", mode: str = "error") -> str:
    """Write a report below ``folder`` under its derived export name; returns the path."""
    return write_report(df, f"{folder.rstrip('/')}/{export_name(region, at, fmt)}", fmt, mode)
