"""File sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from cellsight.operators.star import Star
from cellsight.schemas import RAW_ACTIVITY, REGION_MAPPING
from cellsight.sinks import snapshots


def read_raw_activity(spark: SparkSession, path: str | list[str], check_header: bool = False,
                      with_lineage: bool = False) -> DataFrame:
    """Raw activity CSV with header line and the fixed 8-column schema.

    Columns bind by position (the header names are not checked) unless
    ``check_header`` asks Spark to verify them (D-10). Unparseable numbers and
    missing trailing fields read as null. ``path`` may be a glob or a list of
    paths (D-9). ``with_lineage`` adds ``source_file`` (S8).
    """
    df = (spark.read.schema(RAW_ACTIVITY)
          .option("header", True)
          .option("enforceSchema", not check_header)
          .option("mode", "PERMISSIVE")
          .csv(path))
    return with_source_file(df) if with_lineage else df


def with_source_file(df: DataFrame) -> DataFrame:
    """Attach the full path of the file each row came from."""
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def read_region_mapping(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Grid-to-region lookup CSV (S2); ``None`` path means no lookup (S3)."""
    if path is None:
        return None
    return spark.read.schema(REGION_MAPPING).option("header", True).csv(path)


def read_flat_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None,
                  quoted_newlines: bool = False) -> DataFrame:
    """Flat usage CSV, every column as text; types are fixed later.

    Files read together must share one header; ``columns`` gives it, in the
    files' own order, and is otherwise taken from one of them. With
    ``quoted_newlines`` a quoted field may hold line breaks; each file is then
    read by one task, because only its start shows where records begin.
    """
    reader = spark.read.option("header", True).option("multiLine", quoted_newlines)
    if columns is None:
        return reader.option("inferSchema", False).csv(path)
    return reader.schema(StructType([StructField(c, StringType()) for c in columns])).csv(path)


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """Date-partitioned cleaned Parquet (S5); filters on event_date prune folders.

    A missing path raises ``FileNotFoundError``.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"cleaned usage not found: {path}") from exc
        raise


def read_star(spark: SparkSession, root: str, between: tuple[str, str] | None = None) -> Star:
    """The star below ``root`` (S6): its current version as :func:`cellsight.plans.warehouse.load_star` published
    it, or the plain folders of :func:`cellsight.sinks.write_star`.

    The version is looked up once; what is returned stays the same while others
    load. ``between`` (first and last day) reads only those days' folders of a
    published star.
    """
    content = snapshots.current(spark, root)
    if content is not None:
        return star_version(spark, root, content, between)
    try:
        hourly = spark.read.parquet(f"{root}/hourly")
    except AnalysisException:
        hourly = None
    return Star(dim_time=spark.read.parquet(f"{root}/dim_time"), dim_region=spark.read.parquet(f"{root}/dim_region"),
                fact=spark.read.parquet(f"{root}/fact_usage"), hourly=hourly)


STAR_TABLES = {
    "dim_time": "time_id long, date date, hour int, day int, month int, weekday string",
    "region_days": "date date, region_id long, region_name string, city string",
    "hourly": "date date, hour int, region_name string, city string, calls decimal(38,0), sms decimal(38,0), internet_mb double, n long",
    "fact_usage": "usage_id long, time_id long, region_id long, call_count long, sms_count long, internet_mb double, date date",
}


def star_version(spark: SparkSession, root: str, content: dict, between: tuple[str, str] | None = None) -> Star:
    """The star of a version: ``content["days"]`` says which load holds each day's folders, ``content["loads"]``
    how many days each load wrote."""
    days = {d: x for d, x in content["days"].items() if between is None or between[0] <= d <= between[1]}
    read = {name: read_days(spark, f"{root}/{name}", name, days, content["loads"]) for name in STAR_TABLES}
    regions = read["region_days"].select("region_id", "region_name", "city").distinct()
    return Star(read["dim_time"], regions, read["fact_usage"].drop("date"), read["hourly"])


def read_days(spark: SparkSession, folder: str, name: str, days: dict[str, str], loads: dict[str, int]) -> DataFrame:
    """The folders of the given days, each from its load; a load whose days are all read is one path."""
    per_load: dict[str, list[str]] = {}
    for day, load in days.items():
        per_load.setdefault(load, []).append(day)
    paths = []
    for load, own in per_load.items():
        whole = len(own) == loads[load]
        paths += [f"{folder}/load={load}"] if whole else [f"{folder}/load={load}/date={day}" for day in sorted(own)]
    schema = STAR_TABLES[name]
    if not paths:
        return spark.createDataFrame([], schema)
    order = [c.split()[0] for c in schema.split(", ")]
    return spark.read.schema(f"{schema}, load string").option("basePath", folder).parquet(*paths).select(*order)
