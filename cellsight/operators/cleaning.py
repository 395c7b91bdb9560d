"""Cleaning of raw and flat usage records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.functions.columns import measure, numeric_text, parse_event_time, parse_with_formats
from cellsight.operators._util import require_columns, require_nonempty
from cellsight.schemas import FLAT_REQUIRED

MEASURES = ["call_count", "sms_count", "internet_usage"]


def clean_raw(raw: DataFrame) -> DataFrame:
    """Raw 8-column activity -> cleaned usage rows.

    call = callin + callout, sms = smsin + smsout, internet, each with null and
    NaN as 0.0; the text timestamp is parsed (unparseable -> row dropped), and
    rows without a grid are dropped. Country code is dropped, so rows of one
    cell and time stay separate rows.
    """
    ts = parse_event_time(F.col("datetime"))
    return (raw.where(F.col("CellID").isNotNull())
            .select(F.col("CellID").alias("grid_id"),
                    (measure("callin") + measure("callout")).alias("call_count"),
                    (measure("smsin") + measure("smsout")).alias("sms_count"),
                    measure("internet").alias("internet_usage"),
                    ts.alias("event_timestamp"))
            .where(F.col("event_timestamp").isNotNull())
            .withColumn("event_date", F.to_date("event_timestamp"))
            .withColumn("hour", F.hour("event_timestamp")))


def clean_flat_usage(flat: DataFrame, time_formats=None) -> DataFrame:
    """Flat 5-column layout -> the same cleaned usage rows as :func:`clean_raw`.

    The second input adapter of the ETL (SURVEY §1.2): headers normalised,
    measures coerced with null and NaN read as 0.0, the timestamp parsed with
    the format list (unparseable -> row dropped), rows without a grid dropped.
    Extra columns are not carried.
    """
    df = standardize_headers(flat)
    require_columns(df, FLAT_REQUIRED)
    num = {c: measure(numeric_text(c)) for c in MEASURES}
    return (df.where(F.col("grid_id").isNotNull())
            .select(F.col("grid_id").cast("string").alias("grid_id"),
                    num["call_count"].alias("call_count"),
                    num["sms_count"].alias("sms_count"),
                    num["internet_usage"].alias("internet_usage"),
                    parse_with_formats(F.col("timestamp"), time_formats).alias("event_timestamp"))
            .where(F.col("event_timestamp").isNotNull())
            .withColumn("event_date", F.to_date("event_timestamp"))
            .withColumn("hour", F.hour("event_timestamp")))


def activity_long(cleaned: DataFrame) -> DataFrame:
    """Wide -> long: three rows (call, sms, internet) per cleaned row, zeros kept."""
    ids = ["grid_id", "event_timestamp", "event_date", "hour"]
    wide = cleaned.select(*ids,
                          F.col("call_count").alias("call"),
                          F.col("sms_count").alias("sms"),
                          F.col("internet_usage").alias("internet"))
    return wide.unpivot(ids, ["call", "sms", "internet"], "activity_type", "activity_value")


def standardize_headers(df: DataFrame) -> DataFrame:
    """Trim and lower-case every column name (P10)."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def coerce_flat(df: DataFrame, time_formats=None) -> DataFrame:
    """Type the flat layout: timestamp parsed, measures numeric; failures -> null (Q3)."""
    out = df.withColumn("timestamp", parse_with_formats(F.col("timestamp"), time_formats))
    for c in MEASURES:
        out = out.withColumn(c, numeric_text(c))
    return out


def clean_flat(df: DataFrame, time_formats=None, check_nonempty: bool = False) -> DataFrame:
    """Flat usage text -> typed, filtered, de-duplicated rows with hour and day.

    Headers normalised (P10) and checked (Q4); types coerced (Q3); rows with a
    null or NaN in a required column dropped (F4), then rows with a negative
    measure (F5); ``hour`` (P7) and calendar ``day`` (P14) added; fully equal
    rows removed (D2). Extra input columns are kept.
    """
    out = standardize_headers(df)
    if check_nonempty:
        require_nonempty(out, "usage data")
    require_columns(out, FLAT_REQUIRED)
    out = coerce_flat(out, time_formats)
    out = out.na.drop(subset=FLAT_REQUIRED)
    out = out.where((F.col("call_count") >= 0) & (F.col("sms_count") >= 0)
                    & (F.col("internet_usage") >= 0))
    out = out.withColumn("hour", F.hour("timestamp")).withColumn("day", F.to_date("timestamp"))
    return out.distinct()
