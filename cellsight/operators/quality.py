"""Landing-file checks and data-quality profiles.

File validation reads the header and the first ``sample_rows`` records of
every file and no more; the checks on them are column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsight.functions.ranking import column_percentiles
from cellsight.operators._util import single_row
from cellsight.operators.cleaning import MEASURES, coerce_flat, standardize_headers
from cellsight.schemas import FLAT_REQUIRED
from cellsight.session import materialize
from cellsight.sources.landing import list_landing, read_heads

# Fixed text values read as missing in a sampled field (the pandas defaults).
NULL_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def sample_files(files: DataFrame, sample_rows: int = 200) -> DataFrame:
    """(uri, line_no, fields): header (line_no 0) and first ``sample_rows`` records of each file of a listing.

    Files are read no further than that. Blank lines are skipped; a quoted
    field may hold line breaks. A file that cannot be read gives no rows.
    """
    return read_heads(files, sample_rows + 1)


def validate_files(spark: SparkSession, pattern: str, sample_rows: int = 200,
                   required=FLAT_REQUIRED) -> DataFrame:
    """The checks of :func:`check_files` on the files matching ``pattern`` (Q1)."""
    return check_files(materialize(list_landing(spark, pattern), "landing-files"), sample_rows, required)


def check_files(listing: DataFrame, sample_rows: int = 200, required=FLAT_REQUIRED) -> DataFrame:
    """One row per file of a listing: path, file_name, valid, reason, columns (Q1).

    Valid iff the header (trimmed, lower-cased, D-12) holds every required
    column and no sampled row has a missing value in one of them. A file
    with no lines (zero bytes) or that is no CSV text is invalid; a
    header-only file is valid; a sampled row with more fields than the header
    is a parse error.
    ``columns`` is the file's own header, in its order.
    """
    files = listing.select("path", "file_name", "uri")
    sample = materialize(sample_files(listing, sample_rows), "landing-sample")
    header = sample.where(F.col("line_no") == 0).select(
        "uri", F.transform("fields", lambda x: F.lower(F.trim(x))).alias("header"))
    rows = sample.where(F.col("line_no") > 0)
    markers = F.array(*[F.lit(m) for m in NULL_MARKERS])

    joined = rows.join(header, "uri")
    missing_any = F.lit(False)
    for name in required:
        pos = F.array_position(F.col("header"), F.lit(name)).cast("int")
        value = F.when((pos > 0) & (pos <= F.size("fields")), F.try_element_at(F.col("fields"), pos))
        missing_any = missing_any | value.isNull() | F.array_contains(markers, value)
    per_file = joined.groupBy("uri").agg(
        F.max(missing_any.cast("int")).alias("_nulls"),
        F.max((F.size("fields") > F.size("header")).cast("int")).alias("_wide"))

    has_cols = F.forall(F.array(*[F.lit(c) for c in required]),
                        lambda c: F.array_contains(F.col("header"), c))
    out = (files.join(header, "uri", "left").join(per_file, "uri", "left")
           .withColumn("reason", F.when(F.col("header").isNull(), "unreadable or empty file")
                       .when(~has_cols, "missing required columns")
                       .when(F.coalesce(F.col("_wide"), F.lit(0)) == 1, "row wider than header")
                       .when(F.coalesce(F.col("_nulls"), F.lit(0)) == 1, "null in required column")))
    return out.select("path", "file_name", F.col("reason").isNull().alias("valid"), "reason",
                      F.col("header").alias("columns"))


def route_files(validation: DataFrame, ingested_names: DataFrame) -> DataFrame:
    """Decide each file's fate (Q2): accepted, duplicate or rejected.

    A valid file whose name is already ingested is a duplicate and goes to
    the rejected area as ``duplicate_<name>``; invalid files are rejected.
    ``ingested_names`` has a ``file_name`` column (e.g. a listing of the raw area).
    """
    seen = ingested_names.select("file_name").distinct().withColumn("_seen", F.lit(True))
    out = validation.join(seen, "file_name", "left")
    status = (F.when(~F.col("valid"), "rejected")
              .when(F.col("_seen"), "duplicate").otherwise("accepted"))
    target = (F.when(status == "duplicate", F.concat(F.lit("duplicate_"), F.col("file_name")))
              .otherwise(F.col("file_name")))
    kept = ["columns"] if "columns" in validation.columns else []
    return out.select("path", "file_name", "valid", "reason", status.alias("status"),
                      target.alias("target_name"), *kept)


def ingest_status(routed: DataFrame) -> DataFrame:
    """Number of files per status."""
    return routed.groupBy("status").agg(F.count(F.lit(1)).alias("files")).orderBy("status")


def quality_profile(df: DataFrame, time_formats=None) -> DataFrame:
    """One row: rows, missing_timestamps, negatives per measure, duplicate_rows (Q6).

    Counted on the flat text layout after header normalisation: timestamps
    that do not parse, measures negative after numeric coercion, and rows
    beyond the first of each group of equal rows (timestamp and measures
    typed, so `3` and `3.0` are equal; null equals null).
    """
    typed = coerce_flat(standardize_headers(df), time_formats)
    counts = typed.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("timestamp").isNull()).alias("missing_timestamps"),
        *[F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in MEASURES])
    groups = typed.groupBy(*typed.columns).agg(F.count(F.lit(1)).alias("_n"))
    dups = groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
    return single_row(counts, dups)


def profile_columns(df: DataFrame) -> DataFrame:
    """Long-form describe of every column.

    column, dtype, count, nulls, and for numbers mean, std, min, 25%, 50%,
    75%, max (exact); for other types unique, top, freq (top ties by value).
    One aggregation gives the counts and moments of all columns, a selection
    by digits the quartiles of all numeric ones (at most four scans), and one
    count of values the distinct and most frequent values of the others. The
    input is neither written nor sorted; an input that is costly to compute
    should be stored before.
    """
    spark = df.sparkSession
    numeric_types = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    numeric = [n for n, t in df.dtypes if t in numeric_types or t.startswith("decimal")]
    other = [n for n in df.columns if n not in numeric]
    aggs = []
    for i, (name, _) in enumerate(df.dtypes):
        c = F.col(name)
        aggs += [F.count(c).alias(f"c{i}"), F.count_if(c.isNull()).alias(f"n{i}")]
        if name in numeric:
            x = c.cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                     F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    totals = df.agg(*aggs).first()
    quartiles = column_percentiles(df, numeric, [0.25, 0.5, 0.75]) if numeric else {}
    texts = {}
    if other:
        # Counted as they are; only distinct values become text (maps, which have no order, before).
        types = dict(df.dtypes)
        value = lambda c: F.col(c).cast("string") if "map<" in types[c] or types[c] == "variant" else F.col(c)
        counted = reduce(DataFrame.unionByName, [
            df.where(F.col(c).isNotNull()).groupBy(value(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(c).alias("c"), F.col("v").cast("string").alias("v"), "n") for c in other])
        best = counted.groupBy("c").agg(F.count(F.lit(1)).alias("u"),
                                        F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("t"))
        texts = {r["c"]: (r["u"], r["t"]["v"], -r["t"]["n"]) for r in best.collect()}
    rows = []
    for i, (name, dtype) in enumerate(df.dtypes):
        row = {"column": name, "dtype": dtype, "count": totals[f"c{i}"], "nulls": totals[f"n{i}"]}
        if name in numeric:
            q25, q50, q75 = quartiles[name]
            row.update(mean=totals[f"m{i}"], std=totals[f"s{i}"], min=totals[f"lo{i}"], p25=q25, p50=q50,
                       p75=q75, max=totals[f"hi{i}"])
        else:
            row.update(zip(("unique", "top", "freq"), texts.get(name, (0, None, None)), strict=True))
        rows.append(row)
    keys = ["column", "dtype", "count", "nulls", "mean", "std", "min", "p25", "p50", "p75", "max",
            "unique", "top", "freq"]
    schema = ("column string, dtype string, count long, nulls long, mean double, std double, "
              "min double, p25 double, p50 double, p75 double, max double, unique long, top string, freq long")
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], schema)
