"""Per-region features for the risk model.

All of it derives from the star's (date, hour, region) rollup, so the
lag window runs over one row per region and day: its partitions hold as
many rows as there are days, whatever the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsight.operators.reports import hourly_rows, region_matches
from cellsight.operators.star import Star


def usage_rows(star: Star, region: str | None = None) -> DataFrame:
    """Total usage at (region_name, city, date, hour) grain (S6 + P8)."""
    return hourly_rows(star, region).select(
        "region_name", "date", "hour", (F.col("calls") + F.col("sms") + F.col("internet_mb")).alias("total_usage"))


def daily_region_usage(rows: DataFrame) -> DataFrame:
    """Total usage by (region_name, date); null keys left out."""
    return (rows.where(F.col("region_name").isNotNull() & F.col("date").isNotNull())
            .groupBy("region_name", "date").agg(F.sum("total_usage").alias("total_usage")))


def with_growth(daily: DataFrame) -> DataFrame:
    """Previous present day's total (W1) and growth over it.

    growth = (t - prev) / prev when prev > 0, else 0.0 (first day included).
    """
    w = Window.partitionBy("region_name").orderBy("date")
    prev = F.lag("total_usage", 1).over(w)
    out = daily.withColumn("prev_usage", prev)
    growth = F.when(F.col("prev_usage") > 0,
                    (F.col("total_usage") - F.col("prev_usage")) / F.col("prev_usage")).otherwise(F.lit(0.0))
    return out.withColumn("growth_rate", growth)


def region_stats(growth: DataFrame) -> DataFrame:
    """Mean daily total, mean growth, sample std of daily totals (0 for one day)."""
    return growth.groupBy("region_name").agg(
        F.avg("total_usage").alias("avg_usage"),
        F.avg("growth_rate").alias("growth_rate"),
        F.coalesce(F.stddev_samp("total_usage"), F.lit(0.0)).alias("variability"))


def hour_region_usage(rows: DataFrame) -> DataFrame:
    """Total usage by (region_name, hour), present hours only."""
    return (rows.where(F.col("region_name").isNotNull() & F.col("hour").isNotNull())
            .groupBy("region_name", "hour").agg(F.sum("total_usage").alias("total_usage")))


def peak_ratio(hourly: DataFrame) -> DataFrame:
    """max / mean of hourly totals per region; 0 when the mean is not positive."""
    agg = hourly.groupBy("region_name").agg(F.max("total_usage").alias("_peak"),
                                            F.avg("total_usage").alias("_mean"))
    ratio = F.when(F.col("_mean") > 0, F.col("_peak") / F.col("_mean")).otherwise(F.lit(0.0))
    return agg.select("region_name", ratio.alias("peak_ratio"))


def build_features(star: Star, region: str | None = None) -> DataFrame:
    """region_name, avg_usage, growth_rate, variability, peak_ratio (M1; M1b with ``region``)."""
    rows = usage_rows(star, region)
    if region is not None:
        # Names equal up to case are one region, reported under the asked name.
        rows = rows.withColumn("region_name", F.lit(region))
    stats = region_stats(with_growth(daily_region_usage(rows)))
    ratio = peak_ratio(hour_region_usage(rows))
    out = stats.join(ratio, "region_name", "left")
    return out.select("region_name", "avg_usage", "growth_rate", "variability", "peak_ratio") \
        .fillna(0.0, subset=["avg_usage", "growth_rate", "variability", "peak_ratio"])


def region_features(star: Star, region: str) -> DataFrame:
    """Features of one region, named as the report expects."""
    return build_features(star, region).withColumnRenamed("region_name", "region")


def region_features_or_raise(star: Star, region: str) -> DataFrame:
    """:func:`region_features`, raising ``LookupError`` for an unknown region."""
    if star.dim_region.where(region_matches(region)).isEmpty():
        raise LookupError(f"Region '{region}' not found")
    return region_features(star, region)
