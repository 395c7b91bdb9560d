"""Usage rollups of the ETL and the KPI path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.functions.columns import numeric_text, total_usage


# ---- ETL summaries over cleaned rows (untruncated doubles) -------------------

def records_per_file(raw_with_lineage: DataFrame) -> DataFrame:
    """Raw rows per source file, before cleaning (A1)."""
    return (raw_with_lineage.groupBy("source_file").agg(F.count(F.lit(1)).alias("records"))
            .orderBy("source_file"))


def calls_per_hour(df: DataFrame, ordered: bool = True) -> DataFrame:
    """Sum of call_count by hour (A2)."""
    out = df.groupBy("hour").agg(F.sum("call_count").alias("total_calls"))
    return out.orderBy("hour") if ordered else out


def sms_per_region_day(df: DataFrame, ordered: bool = True) -> DataFrame:
    """Sum of sms_count by (event_date, grid_id) (A3)."""
    out = df.groupBy("event_date", "grid_id").agg(F.sum("sms_count").alias("total_sms"))
    return out.orderBy("event_date", "grid_id") if ordered else out


def internet_per_day(df: DataFrame, ordered: bool = True) -> DataFrame:
    """Sum of internet_usage by event_date (A4)."""
    out = df.groupBy("event_date").agg(F.sum("internet_usage").alias("total_internet_usage"))
    return out.orderBy("event_date") if ordered else out


def top_peak_hours(df: DataFrame, k: int = 5) -> DataFrame:
    """Hours with the largest total usage, ties by hour (A5, D-2)."""
    return (df.groupBy("hour").agg(F.sum(total_usage()).alias("total_usage"))
            .orderBy(F.desc("total_usage"), F.asc("hour")).limit(k))


def hourly_grid_base(df: DataFrame) -> DataFrame:
    """One pass at (event_date, hour, grid_id) grain from which A2-A5 all derive."""
    return df.groupBy("event_date", "hour", "grid_id").agg(
        F.sum("call_count").alias("call_count"),
        F.sum("sms_count").alias("sms_count"),
        F.sum("internet_usage").alias("internet_usage"))


def compute_summaries(df: DataFrame, shared_pass: bool = False,
                      ordered: bool = False) -> dict[str, DataFrame]:
    """The four ETL summary tables, as written by the ETL (K2).

    Not sorted by default: a global sort before a Parquet write costs a
    range shuffle and the file order is not kept on read anyway; readers
    sort (the per-summary functions sort by default). With ``shared_pass``
    the rows are first reduced to (date, hour, grid) grain, which the caller
    may persist so the four summaries read it instead of the full table.
    """
    src = hourly_grid_base(df) if shared_pass else df
    return {
        "calls_per_hour": calls_per_hour(src, ordered),
        "sms_per_region_day": sms_per_region_day(src, ordered),
        "internet_per_day": internet_per_day(src, ordered),
        "top_5_peak_hours": top_peak_hours(src, 5),
    }


# ---- KPI path over flat-cleaned rows -------------------------------------------

def daily_usage(df: DataFrame) -> DataFrame:
    """Totals by calendar day; rows without a day are left out."""
    return (df.where(F.col("day").isNotNull()).groupBy("day")
            .agg(F.sum("call_count").alias("total_calls"),
                 F.sum("sms_count").alias("total_sms"),
                 F.sum("internet_usage").alias("total_internet_usage"))
            .orderBy("day"))


def usage_per_region(df: DataFrame) -> DataFrame:
    """Totals by grid_id, largest internet first."""
    return (df.where(F.col("grid_id").isNotNull()).groupBy("grid_id")
            .agg(F.sum("call_count").alias("call_count"),
                 F.sum("sms_count").alias("sms_count"),
                 F.sum("internet_usage").alias("internet_usage"))
            .orderBy(F.desc("internet_usage"), F.asc("grid_id")))


def avg_usage_per_hour(df: DataFrame) -> DataFrame:
    """Mean of each measure over rows, by hour."""
    return (df.where(F.col("hour").isNotNull()).groupBy("hour")
            .agg(F.avg("call_count").alias("avg_calls"),
                 F.avg("sms_count").alias("avg_sms"),
                 F.avg("internet_usage").alias("avg_internet_usage"))
            .orderBy("hour"))


def peak_usage_hour(df: DataFrame) -> DataFrame:
    """The hour with the largest total usage, ties by hour."""
    top = (df.where(F.col("hour").isNotNull()).groupBy("hour")
           .agg(F.sum(total_usage()).alias("total_usage"))
           .orderBy(F.desc("total_usage"), F.asc("hour")).limit(1))
    return top.select(F.col("hour").alias("peak_usage_hour"), "total_usage")


def total_rows(df: DataFrame) -> DataFrame:
    """Row count of the cleaned table (A10)."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def compute_kpis(df: DataFrame) -> dict[str, DataFrame]:
    """The KPI bundle (A11): four frames over one (ideally persisted) input."""
    return {
        "total_rows": total_rows(df),
        "peak_usage_hour": peak_usage_hour(df),
        "usage_per_region": usage_per_region(df),
        "avg_usage_per_hour": avg_usage_per_hour(df),
    }


def grid_top_internet(df: DataFrame, k: int = 20) -> DataFrame:
    """Grids with the largest internet total on uncleaned rows.

    Numbers are coerced as in Q3 (non-numbers count as null); rows without
    a grid are left out.
    """
    inet = numeric_text("internet_usage")
    return (df.where(F.col("grid_id").isNotNull())
            .groupBy("grid_id").agg(F.coalesce(F.sum(inet), F.lit(0.0)).alias("internet_usage"))
            .orderBy(F.desc("internet_usage"), F.asc("grid_id")).limit(k))
