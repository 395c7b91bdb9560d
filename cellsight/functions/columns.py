"""Scalar column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timestamp layouts accepted by the flat (KPI) path, tried in this order (D-7).
FLAT_TIME_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def measure(c) -> Column:
    """A raw measure with null and NaN read as 0.0 (P1-P3, D-11)."""
    return F.coalesce(F.nanvl(_col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def total_usage(call="call_count", sms="sms_count", internet="internet_usage") -> Column:
    """Unweighted sum of the three measures."""
    return _col(call) + _col(sms) + _col(internet)


def parse_event_time(c) -> Column:
    """Timestamp from text in UTC; unparseable text gives null (P5).

    A UTC offset in the text is applied, so `00:30:00+01:00` is 23:30 of the
    day before. The session's time zone is UTC (see ``apply_defaults``).
    """
    return F.try_to_timestamp(_col(c)).cast("timestamp_ntz")


def parse_with_formats(c, formats=None) -> Column:
    """First format that parses wins; none gives null (D-7)."""
    text = F.trim(_col(c))
    tries = [F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
             for fmt in (formats or FLAT_TIME_FORMATS)]
    return F.coalesce(*tries)


def decimal_text(c, scale: int = 4) -> Column:
    """Text of a double rounded to ``scale`` places, formatted alike in Spark and SQL engines."""
    return _col(c).cast(f"decimal(18,{scale})").cast("string")


def surrogate_key(*parts) -> Column:
    """64-bit key from the text ``p1|p2|...``: first 60 bits of its MD5 (D-1).

    Non-negative, deterministic, and reproducible in any engine with md5.
    """
    text = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def numeric_text(c) -> Column:
    """Text as a double; anything but a plain number, NaN or infinity gives null (Q3).

    A type suffix (`1d`, `2f`), which a cast alone would accept, is no number.
    """
    text = F.trim(_col(c).cast("string"))
    return F.when(~text.rlike("[0-9.][dDfF]$"), text.try_cast("double"))


def weekday_name(c) -> Column:
    """English day name, e.g. ``Friday``."""
    return F.date_format(_col(c), "EEEE")
