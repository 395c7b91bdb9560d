"""Landing-zone ingest as one job: check files, route them, run the ETL on accepted ones.

The DAG's detect -> validate -> move -> ETL chain (SURVEY §3.4). Instead of
moving files, an append-only manifest records each file's status and target
name per run; names accepted by an earlier run are duplicates, so a second
run over the same landing folder loads nothing again.

Each run writes its rows to a folder of its own, named after the files it
takes, and its manifest entry afterwards. A run that died in between leaves
no entry: its rows are not read, and the next run overwrites or passes them.
:func:`compact_runs` later merges the folders of many runs into one; an entry
of its own, written last, puts the merged folder in the place of the others.

The listing, the checks and the manifest are DataFrames throughout. Spark's
readers take paths, so accepted ones pass the driver, ``PATHS_AT_ONCE`` at a
time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cellsight.operators.cleaning import clean_flat_usage
from cellsight.operators.enrich import enrich_region
from cellsight.operators.quality import check_files, ingest_status, route_files
from cellsight.session import materialize
from cellsight.sinks import write_cleaned
from cellsight.sources.files import read_flat_csv
from cellsight.sources.landing import list_landing

MANIFEST_SCHEMA = ("path string, file_name string, valid boolean, reason string, status string, "
                   "target_name string, columns array<string>, run_id string")
COMPACTIONS_SCHEMA = "run_id string, replaced string"
PATHS_AT_ONCE = 10_000


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table; no rows before it is first written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], schema)
        raise


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """All manifest entries so far; no rows before the first run."""
    return _read(spark, f"{out_dir}/manifest", MANIFEST_SCHEMA)


def current_runs(spark: SparkSession, out_dir: str) -> DataFrame:
    """(run_id) of the folders that hold the rows of all finished runs, each row in one of them."""
    done = read_manifest(spark, out_dir).where("status = 'accepted'").select("run_id")
    merged = _read(spark, f"{out_dir}/compactions", COMPACTIONS_SCHEMA)
    gone = merged.select(F.col("replaced").alias("run_id"))
    return done.unionByName(merged.select("run_id")).distinct().join(gone, "run_id", "left_anti")


def read_ingested(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """The cleaned rows of every finished run; None before there are any.

    The runs are a join with the folders' ``run_id``, which prunes folders when it runs.
    """
    runs = current_runs(spark, out_dir)
    if runs.isEmpty():
        return None
    return spark.read.parquet(f"{out_dir}/cleaned_usage").join(runs, "run_id", "left_semi").drop("run_id")


def _set_id(rows: DataFrame, col: str, prefix: str) -> str:
    """A name for the set of values of ``col``, whatever their order."""
    seen = rows.agg(F.count(F.lit(1)).alias("n"), *[
        F.coalesce(F.bit_xor(F.xxhash64(col, F.lit(seed))), F.lit(0)).alias(f"h{seed}") for seed in (1, 2)]).first()
    return f"{prefix}{seen['n']}-" + "".join(f"{seen[h] & (1 << 64) - 1:016x}" for h in ("h1", "h2"))


def _paths(accepted: DataFrame, columns: list[str]) -> Iterator[tuple[str, ...]]:
    """The paths of the files with one header, in bounded batches, written so that no character is a wildcard."""
    own = accepted.where(F.col("columns") == F.array(*[F.lit(c) for c in columns]))
    rows = own.select("path").orderBy("path").toLocalIterator()
    return batched((re.sub(r"([*?\[\]{}\\])", r"\\\1", r["path"]) for r in rows), PATHS_AT_ONCE)


def run_ingest(spark: SparkSession, landing_pattern: str, ingested_pattern: str | None,
               mapping: DataFrame | None, out_dir: str, quoted_newlines: bool = False) -> dict:
    """Validate and route the landing files, then clean and write the accepted ones.

    Files already ingested are those that an earlier run accepted and, if
    given, those listed by ``ingested_pattern`` (both by name). Every file is
    read by its own header; files of one header are read together. Adds to
    ``<out_dir>/manifest`` and ``<out_dir>/cleaned_usage``; returns this run's
    status counts.
    """
    seen = read_manifest(spark, out_dir).where("status = 'accepted'").select("file_name")
    if ingested_pattern:
        seen = seen.unionByName(list_landing(spark, ingested_pattern).select("file_name"))
    listing = materialize(list_landing(spark, landing_pattern), "landing-files")
    routed = materialize(route_files(check_files(listing), seen), "routed-files")
    accepted = routed.where("status = 'accepted'")
    run_id, mode = _set_id(accepted, "path", "r"), "overwrite"
    for header in accepted.select("columns").distinct().orderBy("columns").collect():  # one row per layout of files
        for paths in _paths(accepted, header["columns"]):
            flat = read_flat_csv(spark, list(paths), header["columns"], quoted_newlines)
            write_cleaned(enrich_region(clean_flat_usage(flat), mapping), f"{out_dir}/cleaned_usage/run_id={run_id}", mode)
            mode = "append"
    routed.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(f"{out_dir}/manifest")
    return {r["status"]: r["files"] for r in ingest_status(routed).collect()}


def compact_runs(spark: SparkSession, out_dir: str) -> str | None:
    """Merge the folders of all runs so far into one with few files per day; returns its run id, None if there is one already.

    Readers see the old folders until the last step, an entry that names the
    merged folder and what it replaces. Replaced folders stay for readers that
    have begun; :func:`remove_replaced` deletes them.
    """
    runs = materialize(current_runs(spark, out_dir), "runs")
    if runs.count() < 2:
        return None
    merged = _set_id(runs, "run_id", "c")
    write_cleaned(read_ingested(spark, out_dir), f"{out_dir}/cleaned_usage/run_id={merged}")
    entry = runs.select(F.lit(merged).alias("run_id"), F.col("run_id").alias("replaced"))
    entry.coalesce(1).write.mode("append").parquet(f"{out_dir}/compactions")
    return merged


def remove_replaced(spark: SparkSession, out_dir: str) -> int:
    """Delete the folders that compactions have replaced; for times without readers. Returns their number."""
    path, conf, n = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for r in _read(spark, f"{out_dir}/compactions", COMPACTIONS_SCHEMA).select("replaced").toLocalIterator():
        folder = path(f"{out_dir}/cleaned_usage/run_id={r['replaced']}")
        n += bool(folder.getFileSystem(conf).delete(folder, True))
    return n
