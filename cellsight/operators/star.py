"""Star schema build (T1-T4) and its constraint checks (Q7-Q9).

Keys are computed in place from row content (D-1), so the fact table needs
no join to its dimensions. ``usage_id`` must be unique although equal rows
are common, so equal rows are numbered. Numbering is done on counts:
rows are first reduced to (content, count) with map-side combining, then
each count is expanded back into numbered rows; a very large group of
copies is cut into chunks that are expanded by different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellsight.functions.columns import surrogate_key, weekday_name
from cellsight.session import materialize

# Rows of one group of equal facts expanded by a single task.
FACT_CHUNK_ROWS = 1_000_000

# Usage rows that travel together, and shuffled bytes that one task counts: their table of counts is several
# times as large in memory, and must fit there.
_BLOCK_BITS = 10
COUNT_BYTES = 16 << 20

_MAX_LONG = float(1 << 63)

# Columns that define a fact row's content, before keys are computed.
CONTENT = ["date", "hour", "region_name", "city", "call_count", "sms_count", "internet_mb"]


class Star(NamedTuple):
    """The three star tables, and the rollup that reports read instead of the fact table, if there is one."""
    dim_time: DataFrame
    dim_region: DataFrame
    fact: DataFrame
    hourly: DataFrame | None = None


def prepare_usage(cleaned: DataFrame) -> DataFrame:
    """Warehouse form of cleaned rows (F3, P11, P7, P12/D-4).

    Counts are truncated toward zero per row before any sum (P11, D-8) and
    kept in 64 bits; beyond them they stop at the largest 64-bit number;
    hour is recomputed from the timestamp; a missing or null region falls
    back to the grid id and a missing or null city to ``Unknown`` (D-4).
    """
    df = cleaned.where(F.col("event_timestamp").isNotNull() & F.col("event_date").isNotNull()
                       & F.col("grid_id").isNotNull())
    grid = F.col("grid_id").cast("string")
    region = F.coalesce(F.col("region_name"), grid) if "region_name" in df.columns else grid
    city = F.coalesce(F.col("city"), F.lit("Unknown")) if "city" in df.columns else F.lit("Unknown")

    def count(c):
        x = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        return (F.when(x >= _MAX_LONG, F.lit((1 << 63) - 1)).when(x <= -_MAX_LONG, F.lit(-(1 << 63) + 1))
                .otherwise(x.try_cast("bigint")))

    return df.select(
        F.col("event_date").cast("date").alias("date"),
        F.hour("event_timestamp").alias("hour"),
        region.alias("region_name"),
        city.alias("city"),
        count("call_count").alias("call_count"),
        count("sms_count").alias("sms_count"),
        F.coalesce(F.nanvl(F.col("internet_usage").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("internet_mb"))


def usage_counts(usage: DataFrame) -> DataFrame:
    """The star's base: one row per distinct fact content with its row count ``n``.

    Combined before the shuffle, so a group of a billion equal rows leaves each
    task as one row. A task of the scan may hold more different rows than fit
    its memory, and would spill them; so blocks of rows are first dealt out
    evenly, whatever they hold. All three star tables derive from this table.
    """
    block = F.shiftright(F.monotonically_increasing_id(), _BLOCK_BITS)
    dealt = usage.withColumn("_block", block).repartition("_block").drop("_block")
    return dealt.groupBy(*CONTENT).agg(F.count(F.lit(1)).alias("n"))


@contextmanager
def small_counts(spark: SparkSession) -> Iterator[None]:
    """Tasks of about ``COUNT_BYTES`` at most while :func:`usage_counts` is written."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(COUNT_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def time_key():
    return surrogate_key("date", "hour")


def region_key():
    return surrogate_key("region_name", "city")


def dim_time(base: DataFrame) -> DataFrame:
    """One row per (date, hour) present, with calendar attributes."""
    return (base.select("date", "hour").distinct()
            .select(time_key().alias("time_id"), "date", "hour",
                    F.dayofmonth("date").alias("day"),
                    F.month("date").alias("month"),
                    weekday_name("date").alias("weekday")))


def dim_region(base: DataFrame) -> DataFrame:
    """One row per (region_name, city) present."""
    return base.select("region_name", "city").distinct() \
        .select(region_key().alias("region_id"), "region_name", "city")


def hourly_usage(base: DataFrame) -> DataFrame:
    """Sums and row counts by (date, hour, region_name, city), the grain of the reports, from :func:`usage_counts`."""
    rows = F.col("n")
    # Counts may be as large as 64 bits hold, their sums larger.
    total = lambda c: F.sum(F.col(c).cast("decimal(19,0)") * rows.cast("decimal(18,0)")).cast("decimal(38,0)")
    return base.groupBy("date", "hour", "region_name", "city").agg(
        total("call_count").alias("calls"), total("sms_count").alias("sms"),
        F.sum(F.col("internet_mb") * rows).alias("internet_mb"), F.sum(rows).alias("n"))


def fact_measures(usage: DataFrame) -> DataFrame:
    """Fact rows with keys but without ``usage_id``, one per usage row."""
    return usage.select(time_key().alias("time_id"), region_key().alias("region_id"),
                        "call_count", "sms_count", "internet_mb")


def fact_usage(base: DataFrame, chunk_rows: int = FACT_CHUNK_ROWS, with_date: bool = False) -> DataFrame:
    """Fact rows with a ``usage_id`` (T3, D-1), from :func:`usage_counts`.

    usage_id = key(time_id|region_id|call|sms|internet to 4 places|n), where n
    numbers rows equal on that text 1, 2, ... in order of the exact internet
    value. Rows equal on every fact column are interchangeable, so the table
    is fully determined by the data and reproducible in SQL. The key has 60
    bits; rows of different content that share one are told apart by
    :func:`resolve_key_collisions` when the star is loaded.

    Each count expands into its rows; a count above ``chunk_rows`` is cut into
    chunks expanded by separate tasks. Counts are sorted before they expand, so
    the rows of every task come in order of (region_id, time_id) and nobody
    has to sort them. ``with_date`` keeps the day, which
    ``time_id`` implies, as a column: rows of a day depend on that day alone.
    """
    day = ["date"] if with_date else []
    keyed = base.select(*day, time_key().alias("time_id"), region_key().alias("region_id"), "call_count",
                        "sms_count", "internet_mb", _internet_text().alias("_inet"),
                        "n")
    # The window sorts by these columns: its counts stay in that order.
    group = [*day, "region_id", "time_id", "call_count", "sms_count", "_inet"]
    before = Window.partitionBy(*group).orderBy("internet_mb").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.withColumn("_off", F.coalesce(F.sum("n").over(before), F.lit(0)))

    cols = [*group, "internet_mb"]
    small = counts.where(F.col("n") <= chunk_rows).select(
        *cols, F.explode(F.sequence(F.col("_off") + 1, F.col("_off") + F.col("n"))).alias("_ord"))
    # The chunk table is tiny, so the partition count is given explicitly:
    # AQE would otherwise coalesce it into one partition, i.e. one task.
    spread = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = (counts.where(F.col("n") > chunk_rows)
              .select(*cols, "_off", "n",
                      F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk_rows))).alias("_k"))
              .repartition(spread, *cols, "_k").sortWithinPartitions("region_id", "time_id"))
    first = F.col("_off") + F.col("_k") * chunk_rows + 1
    last = F.col("_off") + F.least(F.col("n"), (F.col("_k") + 1) * chunk_rows)
    large = chunks.select(*cols, F.explode(F.sequence(first, last)).alias("_ord"))

    numbered = small.unionByName(large)
    usage_id = surrogate_key("time_id", "region_id", "call_count", "sms_count", "_inet", "_ord")
    return numbered.select(usage_id.alias("usage_id"), "time_id", "region_id", "call_count", "sms_count",
                           "internet_mb", *day)


def _internet_text():
    """Internet usage to 4 places as text; values too large for a decimal keep the double's own text."""
    x = F.col("internet_mb")
    return F.coalesce(x.try_cast("decimal(38,4)").cast("string"), x.cast("string"))


def resolve_key_collisions(fact: DataFrame) -> DataFrame:
    """Give rows that share a ``usage_id`` different ids, by bits 60-62, which the key leaves free.

    The first row by content keeps its id, the next ones get it with 1, 2, ...
    in those bits; all other ids stay. Only the rows of shared ids are sorted.
    """
    content = ["time_id", "region_id", "call_count", "sms_count", "internet_mb"]
    shared = fact.groupBy("usage_id").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1).select("usage_id")
    shared = materialize(shared, "star-shared-ids")
    rest = fact.join(shared, "usage_id", "left_anti")
    order = Window.partitionBy("usage_id").orderBy(*content)
    told = (fact.join(shared, "usage_id", "left_semi")
            .withColumn("_n", F.row_number().over(order) - 1)
            .withColumn("usage_id", F.col("usage_id") + F.col("_n").cast("bigint") * F.lit(1 << 60)).drop("_n"))
    return rest.unionByName(told)


def build_star(cleaned: DataFrame, with_usage_id: bool = True, reliable_base: bool = False) -> Star:
    """Dimensions and fact from cleaned (optionally enriched) rows.

    ``reliable_base`` writes the base count table to the session's
    checkpoint folder (one pass over ``cleaned``, then three cheap reads);
    otherwise each table recomputes it. ``with_usage_id=False`` gives fact
    rows without the numbering, for callers that only read measures.
    """
    usage = prepare_usage(cleaned)
    base = usage_counts(usage)
    if reliable_base:
        with small_counts(cleaned.sparkSession):
            base = materialize(base, "star-base")
    fact = fact_usage(base) if with_usage_id else fact_measures(usage)
    return Star(dim_time(base), dim_region(base), fact, hourly_usage(base))


# ---- constraint checks (Q7-Q9) ------------------------------------------------

def _nulls(df: DataFrame):
    return sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)).cast("long")


def _check(name: str, target: str, violations):
    return F.struct(F.lit(name).alias("check_name"), F.lit(target).alias("target"),
                    violations.cast("long").alias("violations"))


def _keyed_checks(df: DataFrame, key: str, table: str) -> DataFrame:
    """Primary key (Q7) and nulls (Q9) of a table from one pass grouped by its key."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c"), _nulls(df).alias("_n"))
    found = per_key.agg(F.count_if(F.col("_c") > 1).alias("dup"), F.coalesce(F.sum("_n"), F.lit(0)).alias("nulls"))
    return found.select(F.explode(F.array(_check("primary_key", f"{table}.{key}", F.col("dup")),
                                          _check("not_null", table, F.col("nulls")))).alias("x")).select("x.*")


def star_checks(star: Star) -> DataFrame:
    """One row per constraint: (check_name, target, violations); all zero when valid.

    Primary keys unique (Q7), fact keys present in the dimensions (Q8),
    no nulls in any star column (Q9). The fact table is read twice: grouped
    by its key, and joined to the keys of both dimensions.
    """
    times = star.dim_time.select("time_id").distinct().withColumn("_t", F.lit(True))
    regions = star.dim_region.select("region_id").distinct().withColumn("_r", F.lit(True))
    known = star.fact.select("time_id", "region_id").join(times, "time_id", "left").join(regions, "region_id", "left")
    orphans = known.agg(F.count_if(F.col("_t").isNull()).alias("t"), F.count_if(F.col("_r").isNull()).alias("r"))
    foreign = orphans.select(F.explode(F.array(
        _check("foreign_key", "fact_usage.time_id", F.col("t")),
        _check("foreign_key", "fact_usage.region_id", F.col("r")))).alias("x")).select("x.*")
    return (_keyed_checks(star.dim_time, "time_id", "dim_time")
            .unionByName(_keyed_checks(star.dim_region, "region_id", "dim_region"))
            .unionByName(_keyed_checks(star.fact, "usage_id", "fact_usage")).unionByName(foreign))


def assert_star_valid(star: Star) -> None:
    """Raise ``ValueError`` listing every violated constraint."""
    bad = [r for r in star_checks(star).collect() if r["violations"]]
    if bad:
        raise ValueError("star constraints violated: "
                         + ", ".join(f"{r['check_name']} {r['target']} ({r['violations']})" for r in bad))
