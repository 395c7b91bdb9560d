"""Writers (K1-K5) and the model reader."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from cellsight.operators.star import Star


def write_cleaned(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Cleaned rows as Parquet partitioned by event_date (K1).

    A rebalance hint on event_date groups each day's rows into few files;
    AQE splits a large day over several tasks instead of one task per day.
    """
    (df.hint("rebalance", "event_date")
     .write.mode(mode).partitionBy("event_date").parquet(path))


def write_summaries(summaries: dict[str, DataFrame], root: str, mode: str = "overwrite") -> dict[str, str]:
    """Each summary to ``<root>/<name>`` as Parquet (K2); returns the paths."""
    paths = {}
    for name, frame in summaries.items():
        paths[name] = f"{root}/{name}"
        frame.write.mode(mode).parquet(paths[name])
    return paths


def write_star(star: Star, root: str) -> None:
    """The star tables and the rollup in one folder each (K3): dimensions first, fact last.

    For tables that nobody reads yet; :func:`cellsight.plans.warehouse.load_star`
    refreshes tables in use. Facts with ids come in order of (region_id,
    time_id) within each task and are written as they come (sorting them again
    would spill most of the table), so Parquet row-group statistics let a
    one-region report skip the row groups of other regions.
    """
    star.dim_time.write.mode("overwrite").parquet(f"{root}/dim_time")
    star.dim_region.write.mode("overwrite").parquet(f"{root}/dim_region")
    if star.hourly is not None:
        star.hourly.write.mode("overwrite").parquet(f"{root}/hourly")
    star.fact.write.mode("overwrite").parquet(f"{root}/fact_usage")


def write_days(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows with a ``date`` as Parquet, a folder per day; a large day is written by several tasks."""
    (df.hint("rebalance", "date").sortWithinPartitions("date", *order)
     .write.mode("errorifexists").partitionBy("date").parquet(path))


def write_predictions(df: DataFrame, path: str) -> None:
    """Scored rows as CSV with a header line (K4); a folder of part files."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    """Persist the fitted pipeline, feature order and label names included (K5)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Read a pipeline saved by :func:`save_model`."""
    return PipelineModel.load(path)
