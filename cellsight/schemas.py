"""Fixed schemas of the data model."""

from pyspark.sql.types import (DateType, DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType, TimestampNTZType)

# Raw activity CSV: columns bind by position, all nullable.
RAW_ACTIVITY = StructType([
    StructField("datetime", StringType(), True),
    StructField("CellID", StringType(), True),
    StructField("countrycode", StringType(), True),
    StructField("smsin", DoubleType(), True),
    StructField("smsout", DoubleType(), True),
    StructField("callin", DoubleType(), True),
    StructField("callout", DoubleType(), True),
    StructField("internet", DoubleType(), True),
])

REGION_MAPPING = StructType([
    StructField("grid_id", StringType(), True),
    StructField("region_name", StringType(), True),
    StructField("city", StringType(), True),
])

CLEANED_USAGE = StructType([
    StructField("grid_id", StringType(), False),
    StructField("call_count", DoubleType(), False),
    StructField("sms_count", DoubleType(), False),
    StructField("internet_usage", DoubleType(), False),
    StructField("event_timestamp", TimestampNTZType(), False),
    StructField("event_date", DateType(), True),
    StructField("hour", IntegerType(), True),
])

# The flat layout checked at the landing zone and used by the KPI path.
FLAT_REQUIRED = ["timestamp", "grid_id", "call_count", "sms_count", "internet_usage"]

DIM_TIME = StructType([
    StructField("time_id", LongType(), False),
    StructField("date", DateType(), False),
    StructField("hour", IntegerType(), False),
    StructField("day", IntegerType(), False),
    StructField("month", IntegerType(), False),
    StructField("weekday", StringType(), False),
])

DIM_REGION = StructType([
    StructField("region_id", LongType(), False),
    StructField("region_name", StringType(), False),
    StructField("city", StringType(), False),
])

FACT_USAGE = StructType([
    StructField("usage_id", LongType(), False),
    StructField("time_id", LongType(), False),
    StructField("region_id", LongType(), False),
    StructField("call_count", LongType(), False),
    StructField("sms_count", LongType(), False),
    StructField("internet_mb", DoubleType(), False),
])

FEATURE_COLUMNS = ["avg_usage", "growth_rate", "variability", "peak_ratio"]

RISK_LABELS = ["LOW", "MEDIUM", "HIGH"]
