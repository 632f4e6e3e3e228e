"""Text predicates and small display helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldreports.functions.constants import IMAGE_URL_PATTERNS, NO_PICTURE, PICTURE_PREFIX

_LIKE_SPECIALS = ("%", "_", "\\")


def contains_pattern(term: str) -> str:
    """ILIKE pattern for a substring search: ``%term%`` of the stripped term.

    ``%`` and ``_`` typed by the user stay live wildcards, as in the source
    database.  A backslash there escapes any character; Spark's matcher only
    accepts it before ``%``, ``_`` or another backslash, so a backslash before
    anything else is dropped, which keeps the same meaning (``\\b`` matches ``b``).
    """
    t = term.strip()
    out = []
    i = 0
    while i < len(t):
        ch = t[i]
        if ch == "\\" and i + 1 < len(t):
            nxt = t[i + 1]
            out.append(ch + nxt if nxt in _LIKE_SPECIALS else nxt)
            i += 2
            continue
        out.append(ch)
        i += 1
    return "%" + "".join(out) + "%"


def is_image_url(c: Column | str) -> Column:
    """True for an http(s) link to an image file or an object-store link."""
    col = F.col(c) if isinstance(c, str) else c
    first, *rest = [col.rlike("(?i)" + p) for p in IMAGE_URL_PATTERNS]
    for r in rest:
        first = first | r
    return first


def usable_picture(c: Column | str) -> Column:
    """A profile picture is shown when present, not the no-picture text and
    starting with http."""
    col = F.col(c) if isinstance(c, str) else c
    return col.isNotNull() & (col != NO_PICTURE) & col.startswith(PICTURE_PREFIX)


def underscored(c: Column | str) -> Column:
    """Each whitespace run becomes one underscore (export file names)."""
    return F.regexp_replace(c, r"\s+", "_")


def first_letter(c: Column | str, fallback: str = "?") -> Column:
    """First character of a name, ``?`` when the name is NULL or blank."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isNull() | (col == ""), F.lit(fallback)).otherwise(F.substring(col, 1, 1))
