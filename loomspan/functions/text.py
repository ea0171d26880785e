"""Text expressions with Unicode-aware white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode defines it, for Java's regular expressions.
_EDGE = r"^[\s\p{Z}\x{1C}-\x{1F}\x{85}]+|[\s\p{Z}\x{1C}-\x{1F}\x{85}]+$"


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(c, _EDGE, "")


def is_blank(c: Column) -> Column:
    """NULL, empty or only white space."""
    return F.coalesce(strip(c) == "", F.lit(True))


def norm_ref(c: Column) -> Column:
    """A reference as it is compared: lower case, stripped; NULL if blank."""
    return F.nullif(strip(F.lower(c)), F.lit(""))


def token_count(c: Column) -> Column:
    """Characters (code points) div 4."""
    return F.floor(F.length(c) / 4).cast("bigint")


def utc_month(epoch: Column) -> Column:
    """``YYYY-MM`` (UTC) of epoch seconds, whatever the session's time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int"))
    return F.date_format(day, "yyyy-MM")
