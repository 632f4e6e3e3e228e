"""Fixed values that must equal the dashboards' own for identical results.

They are category labels and their display order, stated as text in natural
order.  Everything else in the package is computed.
"""

# Attendance categories, in display order.
ATTENDANCE_TYPE_ORDER = (
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

# Check-in timing bands, in display order.
TIMING_ORDER = ("Before 10 AM", "10 AM To 12 Noon", "12 Noon To 2 PM", "After 2 PM", "Not Check in")

# Salary-impact bands, in display order.
IMPACT_ORDER = ("4.5-9 Hrs (Half Day)", "9 Hrs (Full Day)", "No Check-Out (LOP)", "Not Check in")

# Our own label for a worked span under 4.5 hours (the dashboards have none);
# it is not in IMPACT_ORDER, so it sorts after the preset bands.
BELOW_HALF_DAY = "Below 4.5 Hrs"

# Single categories that rules refer to.
NOT_MARKED = "Not Marked"
NOT_CHECKED_IN = "Not Check in"
NO_CHECK_OUT = "No Check-Out (LOP)"

# Fixed value: the "disabled" sentinel for single-select filters.
ALL = "All"

# What counts as an image link in a table cell (either pattern,
# case-insensitive), and the stored text meaning "no profile picture".
IMAGE_URL_PATTERNS = (r"^https?://.+\.(jpg|jpeg|png|gif|webp)", r"s3[^/]*amazonaws\.com")
NO_PICTURE = "NA"
PICTURE_PREFIX = "http"

# Export file names are "<region or All_Regions>_Dashboard_<stamp>".
EXPORT_ALL_REGIONS = "All_Regions"
EXPORT_INFIX = "_Dashboard_"

# The attributes of a profile card, in display order, and the bar
# widget that shows day counts once an id is entered.
PROFILE_ATTRIBUTES = ("Employee ID", "User ID", "Gender", "Region", "Type", "ASE", "ZSE")
ATTENDANCE_TREND_WIDGET_ID = 3

# Rank given to categories outside a preset order (they sort last).
UNKNOWN_RANK = 1000
