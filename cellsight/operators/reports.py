"""Usage reports over the star.

Each report is a DataFrame over the star's rollup by (date, hour, region),
which a load keeps for every day; no report but the joined rows themselves
(S6) scans the fact table. For a star without a rollup it is computed from the
fact table: summed per key, then joined to the dimensions. Whether a dimension
is broadcast is left to Spark, which goes by its size in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsight.operators._util import single_row
from cellsight.operators.star import Star


def region_matches(region: str) -> Column:
    """Case-insensitive match on region_name."""
    return F.lower(F.col("region_name")) == F.lower(F.lit(region))


def _dims(star: Star, region: str | None = None):
    dt = star.dim_time.select("time_id", "date", "hour")
    dr = star.dim_region.select("region_id", "region_name", "city")
    if region is not None:
        dr = dr.where(region_matches(region))
    return dt, dr


def region_ids(star: Star, region: str) -> list[int]:
    """Keys of the regions matching ``region`` (F6): the case variants of one name."""
    return [r["region_id"] for r in star.dim_region.where(region_matches(region)).select("region_id").collect()]


def region_fact(star: Star, region: str | None) -> DataFrame:
    """Fact rows of one region, as a literal key filter the Parquet scan can use
    to skip row groups; all fact rows when ``region`` is None."""
    if region is None:
        return star.fact
    return star.fact.where(F.col("region_id").isin(region_ids(star, region)))


def star_rows(star: Star, region: str | None = None) -> DataFrame:
    """Fact joined to both dimensions (J2, J3): region_name, city, date, hour, measures."""
    dt, dr = _dims(star, region)
    return (region_fact(star, region).join(dt, "time_id").join(dr, "region_id")
            .select("region_name", "city", "date", "hour", "call_count", "sms_count", "internet_mb"))


def hourly_rows(star: Star, region: str | None = None) -> DataFrame:
    """Sums and row counts by (date, hour, region_name, city): date, hour, region_name, city, calls, sms,
    internet_mb, n."""
    if star.hourly is not None:
        return star.hourly if region is None else star.hourly.where(region_matches(region))
    dt, dr = _dims(star, region)
    per_key = region_fact(star, region).groupBy("time_id", "region_id").agg(
        F.sum("call_count").alias("calls"), F.sum("sms_count").alias("sms"), F.sum("internet_mb").alias("internet_mb"),
        F.count(F.lit(1)).alias("n"))
    return (per_key.join(dt, "time_id").join(dr, "region_id")
            .select("date", "hour", "region_name", "city", "calls", "sms", "internet_mb", "n"))


def _usage() -> Column:
    return F.col("calls") + F.col("sms") + F.col("internet_mb")


def _totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum("calls"), F.lit(0)).cast("long").alias("total_calls"),
                    F.coalesce(F.sum("sms"), F.lit(0)).cast("long").alias("total_sms"),
                    F.coalesce(F.sum("internet_mb"), F.lit(0.0)).alias("total_internet_mb"))


def _top(rows: DataFrame, key: str, k: int | None) -> DataFrame:
    out = rows.groupBy(key).agg(F.sum(_usage()).alias("total_usage")).orderBy(F.desc("total_usage"), F.asc(key))
    return out.limit(k) if k else out


def summary_totals(star: Star) -> DataFrame:
    """Global totals, 0 on an empty fact table."""
    return _totals(hourly_rows(star))


def usage_by_hour(star: Star, k: int | None = None) -> DataFrame:
    """Total usage by hour, largest first, ties by hour."""
    return _top(hourly_rows(star), "hour", k)


def usage_by_region(star: Star, k: int | None = None) -> DataFrame:
    """Total usage by region name (cities of one name merge), largest first."""
    return _top(hourly_rows(star), "region_name", k)


def region_hourly(star: Star, region: str) -> DataFrame:
    """Sums by hour for one region, matched case-insensitively."""
    return (hourly_rows(star, region).groupBy("hour")
            .agg(F.sum("calls").cast("double").alias("calls"), F.sum("sms").cast("double").alias("sms"),
                 F.sum("internet_mb").alias("internet_mb"))
            .orderBy("hour"))


def region_trend(star: Star, region: str) -> DataFrame:
    """Means over fact rows by hour for one region."""
    return (hourly_rows(star, region).groupBy("hour")
            .agg(*[(F.sum(c).cast("double") / F.sum("n")).alias(c) for c in ("calls", "sms", "internet_mb")])
            .orderBy("hour"))


def region_hour_calls(star: Star, k: int = 10) -> DataFrame:
    """Calls by (region_name, hour), top ``k``, ties by region then hour."""
    return (hourly_rows(star).groupBy("region_name", "hour")
            .agg(F.sum("calls").cast("long").alias("total_calls"))
            .orderBy(F.desc("total_calls"), F.asc("region_name"), F.asc("hour"))
            .limit(k))


def _ordered_keys(top: DataFrame, key: str) -> Column:
    # The order is rebuilt from the values, never from a sorted frame.
    entries = F.sort_array(F.collect_list(F.struct((-F.col("total_usage")).alias("neg"),
                                                   F.col(key).alias("k"))))
    return F.transform(entries, lambda e: e["k"])


def hour_region_base(star: Star) -> DataFrame:
    """Sums by (hour, region_name). The shared first step of E1 and E3: every part reads this one aggregate,
    so Spark reuses its shuffle."""
    return hourly_rows(star).groupBy("hour", "region_name").agg(
        *[F.sum(c).alias(c) for c in ("calls", "sms", "internet_mb")])


def usage_summary(star: Star, k: int = 3) -> DataFrame:
    """One row: totals, top ``k`` hours, top ``k`` regions.

    All parts derive from one (hour, region) aggregate.
    """
    base = hour_region_base(star)
    hours, regions = _top(base, "hour", k), _top(base, "region_name", k)
    top_hours = hours.agg(_ordered_keys(hours, "hour").alias("top_peak_hours"))
    top_regions = regions.agg(_ordered_keys(regions, "region_name").alias("top_busiest_regions"))
    return single_row(_totals(base), top_hours, top_regions)


def region_usage(star: Star, region: str) -> DataFrame:
    """Hourly sums and hourly means for one region, tagged by ``kind``.

    Both kinds derive from one aggregate by hour. Empty when the region is
    unknown; :func:`region_usage_or_raise` turns that into ``LookupError``.
    """
    base = hourly_rows(star, region).groupBy("hour").agg(*[F.sum(c).alias(c) for c in ("n", "calls", "sms", "internet_mb")])

    def part(kind, per):
        return F.struct(F.lit(kind).alias("kind"), "hour", *[
            (F.col(c).cast("double") / per).alias(c) for c in ("calls", "sms", "internet_mb")])

    both = F.array(part("hourly_distribution", F.lit(1.0)), part("trend", F.col("n")))
    return base.select(F.explode(both).alias("x")).select("x.*")


def region_usage_or_raise(star: Star, region: str) -> DataFrame:
    out = region_usage(star, region)
    if out.isEmpty():
        raise LookupError(f"Region '{region}' not found")
    return out


def peak_traffic(star: Star, k: int = 5) -> DataFrame:
    """Top ``k`` hours and top ``k`` regions by total usage, tagged by ``kind``."""
    base = hour_region_base(star)
    hours = _top(base, "hour", k).select(
        F.lit("top_hours").alias("kind"), "hour", F.lit(None).cast("string").alias("region"), "total_usage")
    regions = _top(base, "region_name", k).select(
        F.lit("top_regions").alias("kind"), F.lit(None).cast("int").alias("hour"), F.col("region_name").alias("region"),
        "total_usage")
    return hours.unionByName(regions)
