"""Scalar column functions (all built-in Spark expressions, no UDFs)."""

from fieldreports.functions.bands import (  # noqa: F401
    impact_band,
    normalise_attendance_type,
    ordinal_of,
    timing_band,
    workhour_band,
    workhour_labels,
)
from fieldreports.functions.dates import (  # noqa: F401
    axis_date,
    cell_date,
    file_stamp,
    iso_day,
    parse_dd_mon_yy,
    pivot_header,
)
from fieldreports.functions.numeric import pct_int, pct_tenths  # noqa: F401
from fieldreports.functions.text import (  # noqa: F401
    contains_pattern,
    first_letter,
    is_image_url,
    underscored,
)
