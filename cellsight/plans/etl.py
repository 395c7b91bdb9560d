"""Batch ETL: raw activity CSV -> cleaned, enriched Parquet + summaries (§3.1)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from cellsight.operators.cleaning import clean_raw
from cellsight.operators.enrich import enrich_region
from cellsight.operators.rollups import compute_summaries, hourly_grid_base, records_per_file
from cellsight.sinks import write_cleaned, write_summaries
from cellsight.sources.files import read_cleaned, read_raw_activity, read_region_mapping


def cleaned_usage(spark: SparkSession, raw_path, mapping: DataFrame | str | None) -> DataFrame:
    """Raw CSV -> cleaned rows -> region lookup, as one lazy plan."""
    lookup = read_region_mapping(spark, mapping) if isinstance(mapping, str) else mapping
    return enrich_region(clean_raw(read_raw_activity(spark, raw_path)), lookup)


def run_etl(spark: SparkSession, raw_path, mapping: DataFrame | str | None, out_dir: str) -> dict[str, str]:
    """Run the batch ETL and return the written paths.

    1. records per file (a scan that parses no columns);
    2. cleaned + enriched rows written partitioned by date (K1);
    3. the summaries computed from the written Parquet through one shared
       (date, hour, grid) aggregate, persisted while the four are written (K2).
    Each step reads stored data, so a lost executor only repeats its own step.
    """
    paths = {}
    per_file = records_per_file(read_raw_activity(spark, raw_path, with_lineage=True))
    paths["records_per_file"] = f"{out_dir}/summary/records_per_file"
    per_file.write.mode("overwrite").parquet(paths["records_per_file"])

    paths["cleaned_usage"] = f"{out_dir}/cleaned_usage"
    write_cleaned(cleaned_usage(spark, raw_path, mapping), paths["cleaned_usage"])

    stored = read_cleaned(spark, paths["cleaned_usage"])
    base = hourly_grid_base(stored).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        summaries = compute_summaries(base)
        paths.update(write_summaries(summaries, f"{out_dir}/summary"))
    finally:
        base.unpersist()
    return paths
