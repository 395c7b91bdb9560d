"""Extensions X1-X7: named in the reference's design notes but not in its code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsight.operators.features import usage_rows
from cellsight.operators.reports import hourly_rows
from cellsight.operators.risk import score_batch
from cellsight.operators._util import single_row
from cellsight.operators.star import Star

SKETCH_K = 400  # size parameter of the day sketches


def hourly_series(star: Star) -> DataFrame:
    """Calls and internet by (region_name, date, hour); one row per present hour."""
    return hourly_rows(star).groupBy("region_name", "date", "hour").agg(
        F.sum("calls").cast("long").alias("calls"), F.sum("internet_mb").alias("internet_mb"))


def rolling_averages(star: Star, hours: int = 24) -> DataFrame:
    """Means of calls (X1) and internet use (X2) over a region's last ``hours`` present hours."""
    w = Window.partitionBy("region_name").orderBy("date", "hour").rowsBetween(1 - hours, 0)
    return hourly_series(star).select(
        "region_name", "date", "hour", F.avg("calls").over(w).alias("avg_call_count"),
        F.avg("internet_mb").over(w).alias("avg_internet_usage"))


def peak_hour_flags(star: Star, k: int = 3) -> DataFrame:
    """Usage by (region_name, hour) with ``peak_hour_flag``: among the region's ``k`` largest hours."""
    per = usage_rows(star).groupBy("region_name", "hour").agg(F.sum("total_usage").alias("total_usage"))
    w = Window.partitionBy("region_name").orderBy(F.desc("total_usage"), "hour")
    return per.withColumn("peak_hour_flag", F.row_number().over(w) <= k)


def with_weekend(dim_time: DataFrame) -> DataFrame:
    """The time dimension with ``is_weekend`` for Saturdays and Sundays."""
    return dim_time.withColumn("is_weekend", F.dayofweek("date").isin(1, 7))


def usage_between(cleaned: DataFrame, first: str, last: str) -> DataFrame:
    """Cleaned rows of the days ``first`` to ``last``, both included.

    Cleaned usage is stored by event_date, so only the folders of these days are read.
    """
    return cleaned.where(F.col("event_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def flag_high_risk(scored: DataFrame, threshold: float = 0.3, prob_col: str = "p_high",
                   label_col: str = "congestion_risk") -> DataFrame:
    """HIGH wherever its probability reaches ``threshold``, else the model's label.

    A threshold below one half trades precision of HIGH for recall.
    """
    return scored.withColumn(label_col, F.when(F.col(prob_col) >= threshold, F.lit("HIGH")).otherwise(F.col(label_col)))


def score_with_recall(model, features: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Batch scoring whose HIGH goes by the model's own probability of HIGH (X6): the columns of
    ``score_batch`` and ``p_high``."""
    return flag_high_risk(score_batch(model, features, with_p_high=True), threshold)


def day_sketches(rows: DataFrame, col: str, day_col: str, k: int = SKETCH_K) -> DataFrame:
    """(day, n, sketch): a mergeable quantile sketch (KLL) of a column per day, a few KB whatever a day holds.

    Null and NaN values take no part. Stored, it is all that later comparisons
    of any two periods read.
    """
    value = F.col(col).cast("double")
    return (rows.where(value.isNotNull() & ~F.isnan(value)).groupBy(F.col(day_col).cast("date").alias("day"))
            .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(value, k).alias("sketch")))


def sketch_drift(sketches: DataFrame, before: tuple[str, str], after: tuple[str, str], bins: int = 10,
                 k: int = SKETCH_K) -> DataFrame:
    """Population stability index between two periods (first and last day), from day sketches alone.

    One row: n_before, n_after, edges (the quantiles of the first period that
    cut it into ``bins`` equal parts, equal ones once) and psi, with half a row
    added to each bin. A share between edges is off by at most twice the
    sketches' rank error (about 1.33 % for k = 200, falling as 1/k).
    """
    def period(days: tuple[str, str], name: str) -> DataFrame:
        rows = sketches.where(F.col("day").between(F.lit(days[0]).cast("date"), F.lit(days[1]).cast("date")))
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"n_{name}"), F.kll_merge_agg_double("sketch", k).alias(f"{name}_sketch"))

    spark = sketches.sparkSession
    merged = single_row(period(before, "before"), period(after, "after")).where("n_before > 0 and n_after > 0")
    cuts = F.kll_sketch_get_quantile_double("before_sketch", F.array(*[F.lit(i / bins) for i in range(1, bins)]))
    found = merged.withColumn("edges", F.array_distinct(cuts)).collect()  # two sketches and their few edges, or no row
    result = "n_before long, n_after long, edges array<double>, psi double"
    if not found:
        return spark.createDataFrame([], result)
    edges = found[0]["edges"]
    row = spark.createDataFrame(found, "n_before long, before_sketch binary, n_after long, after_sketch binary, edges array<double>")

    def shares(name: str):
        below = F.kll_sketch_get_rank_double(f"{name}_sketch", F.array(*[F.lit(e) for e in edges]))
        n, bounds = F.col(f"n_{name}"), F.concat(F.array(F.lit(0.0)), below, F.array(F.lit(1.0)))
        return [((F.get(bounds, F.lit(i + 1)) - F.get(bounds, F.lit(i))) * n + 0.5) / (n + 0.5 * (len(edges) + 1))
                for i in range(len(edges) + 1)]

    psi = sum(((q - p) * F.log(q / p) for p, q in zip(shares("before"), shares("after"), strict=True)), F.lit(0.0))
    return row.select("n_before", "n_after", "edges", psi.alias("psi"))


def usage_drift(rows: DataFrame, col: str, period, edges: list[float]) -> DataFrame:
    """Population stability index of ``col`` between the rows where ``period`` is false and true.

    One row: n_before, n_after, psi. Values are counted between fixed
    ``edges``; half a row is added to each bin. :func:`sketch_drift` needs no
    edges and no second look at the rows.
    """
    bins = sum((F.when(F.col(col) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    counted = rows.groupBy(bins.alias("bin")).agg(F.count_if(~period).alias("a"), F.count_if(period).alias("b"))
    spark = rows.sparkSession
    every = spark.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    filled = every.join(counted, "bin", "left").fillna(0, ["a", "b"])
    n = len(edges) + 1
    total = filled.agg(F.sum("a").alias("n_before"), F.sum("b").alias("n_after"),
                       F.collect_list(F.struct("bin", "a", "b")).alias("bins"))
    pa = lambda x: (x["a"] + 0.5) / (F.col("n_before") + 0.5 * n)
    pb = lambda x: (x["b"] + 0.5) / (F.col("n_after") + 0.5 * n)
    psi = F.aggregate("bins", F.lit(0.0), lambda s, x: s + (pb(x) - pa(x)) * F.log(pb(x) / pa(x)))
    return total.select("n_before", "n_after", psi.alias("psi"))
