"""Corpus pipeline: quality, language, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``; the last returns where each piece of a
document is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellsight.llm import bestfit_packing, language_id, line_dedup, near_dedup, quality_resample
from cellsight.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; learned from ``labels``."""
    return quality_resample.keep_resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds."""
    return line_dedup.deduplicate(docs, length_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group alike in at least 80 % of their five-word shingles."""
    return near_dedup.keep_first(docs, words=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bin, bin length and offset of each piece of a document."""
    return bestfit_packing.pack_documents(docs)


STAGES = [("quality", quality), ("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
          ("packing", packing)]

# Importance resampling, kernel regression and packing have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
