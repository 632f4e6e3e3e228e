"""Date parsing and display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A two-digit year is read by the JVM formatter into 2000-2099.  The source
# database reads it into the century nearest 2020: 70-99 -> 1970-1999 and
# 00-69 -> 2000-2069.  Years parsed at or beyond this pivot move back 100 years.
CENTURY_PIVOT = 2070


def parse_dd_mon_yy(c: Column | str) -> Column:
    """Parse text such as ``05-Mar-97`` (or ``5-Mar-97``) to a date.

    Junk and blank text give NULL (the row then fails any range test).
    """
    d = F.try_to_date(F.col(c) if isinstance(c, str) else c, "d-MMM-yy")
    return F.when(F.year(d) >= CENTURY_PIVOT, F.add_months(d, -1200)).otherwise(d)


def iso_day(c: Column | str) -> Column:
    """``2024-01-05``: the canonical text form of a day key."""
    return F.date_format(c, "yyyy-MM-dd")


def pivot_header(c: Column | str) -> Column:
    """Pivot column header, e.g. ``05-Jan(Fri)``."""
    return F.date_format(c, "dd-MMM(EEE)")


def axis_date(c: Column | str) -> Column:
    """Chart axis label, e.g. ``5-Jan-24``."""
    return F.date_format(c, "d-MMM-yy")


def cell_date(c: Column | str) -> Column:
    """Table cell date, e.g. ``5-Jan-2024`` (time of day dropped)."""
    return F.date_format(c, "d-MMM-yyyy")


def file_stamp(c: Column | str) -> Column:
    """Export file-name time stamp, e.g. ``5-Jan-2024_930`` (hour unpadded)."""
    return F.date_format(c, "d-MMM-yyyy_Hmm")


def day_header(c: Column, kind: T.DataType) -> Column:
    """Pivot header of a day key: a date, a time or ISO text as its day; other
    text, which is no day, as it is."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return pivot_header(c)
    text = c.cast("string")
    return F.coalesce(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), pivot_header(F.try_to_timestamp(text))), text)
