"""Warehouse load: cleaned Parquet -> checked star tables (T4, K3), whole or day by day.

Every row of the star belongs to one day and depends on that day's cleaned
rows alone, its id included, so a load may rebuild only the days that changed
and leaves the same star as a full one. Tables are written by day into folders
of this load; a version (:mod:`cellsight.sinks.snapshots`) lists for each day
the load that holds it. It is published after the checks, in one step.

The one thing that days share are ids that happen to be equal (the key has 60
bits). Days with such a row are found by a join on the ids and are rebuilt
along with the changed ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsight.operators._util import require_nonempty
from cellsight.operators.star import (Star, assert_star_valid, dim_time, fact_usage, hourly_usage, prepare_usage,
                                      region_key, resolve_key_collisions, small_counts, usage_counts)
from cellsight.session import materialize
from cellsight.sinks import snapshots, write_days
from cellsight.sources.files import STAR_TABLES, read_cleaned, read_days, star_version


def _key() -> Column:
    """The id without the bits that tell equal keys apart."""
    return F.col("usage_id").bitwiseAND(F.lit((1 << 60) - 1)).alias("key")


def _build(spark: SparkSession, cleaned: DataFrame, star_dir: str, old: dict, days: set[str] | None) -> dict:
    """Write the given days (all, if None) into a load of their own; returns the version they make with the
    other days of ``old``."""
    changed = cleaned if days is None else cleaned.where(F.col("event_date").cast("string").isin(sorted(days)))
    with small_counts(spark):
        base = materialize(usage_counts(prepare_usage(changed)), "star-base")
    fact = materialize(fact_usage(base, with_date=True), "star-fact")
    kept = {d: x for d, x in old["days"].items() if days is not None and d not in days}
    if kept:
        # A kept day that shares a key with a row that comes or goes is built anew with it.
        folder, loads = f"{star_dir}/fact_usage", old["loads"]
        gone = {d: x for d, x in old["days"].items() if d in days}
        moved = fact.select(_key()).unionByName(read_days(spark, folder, "fact_usage", gone, loads).select(_key()))
        shared = read_days(spark, folder, "fact_usage", kept, loads).select("date", _key()).join(moved, "key", "left_semi")
        also = {str(r["date"]) for r in shared.select("date").distinct().collect()}
        if also:
            return _build(spark, cleaned, star_dir, old, days | also)
    load = uuid.uuid4().hex[:16]
    regions = base.select("date", "region_name", "city").distinct()
    write_days(dim_time(base), f"{star_dir}/dim_time/load={load}", ["hour"])
    write_days(regions.withColumn("region_id", region_key()), f"{star_dir}/region_days/load={load}", ["region_id"])
    write_days(hourly_usage(base), f"{star_dir}/hourly/load={load}", ["region_name", "hour"])
    write_days(resolve_key_collisions(fact), f"{star_dir}/fact_usage/load={load}", ["region_id", "time_id"])
    written = [str(r["date"]) for r in base.select("date").distinct().collect()]  # one row per day
    now = kept | dict.fromkeys(written, load)
    sizes = {x: n for x, n in old["loads"].items() if x in now.values()} | ({load: len(written)} if written else {})
    return {"days": now, "loads": sizes, "load": load}


def load_star(spark: SparkSession, cleaned_path: str, star_dir: str, days: Iterable[str] | None = None) -> dict[str, int]:
    """Build, write, check and publish the star; returns row counts per table.

    ``days`` (as ``2024-01-31``) are those whose cleaned rows have changed,
    come or gone; without them, or when there is no star yet, all days are
    loaded. The constraints (Q7-Q9) are checked on what was written, before it
    is published: a violation raises ``ValueError``. Until then, and if the
    load dies at any point, readers see the star as it was.
    """
    cleaned = read_cleaned(spark, cleaned_path)
    require_nonempty(cleaned, "processed dataset")
    old = snapshots.current(spark, star_dir)
    chosen = set(map(str, days)) if days is not None and old is not None else None
    content = _build(spark, cleaned, star_dir, old or {"days": {}, "loads": {}}, chosen)
    star = star_version(spark, star_dir, content)
    new = {d: x for d, x in content["days"].items() if x == content["load"]}
    rows = read_days(spark, f"{star_dir}/fact_usage", "fact_usage", new, content["loads"]).drop("date")
    assert_star_valid(Star(star.dim_time, star.dim_region, rows))
    snapshots.publish(spark, star_dir, content)
    return {"dim_time": star.dim_time.count(), "dim_region": star.dim_region.count(), "fact_usage": star.fact.count()}


def remove_old_loads(spark: SparkSession, star_dir: str) -> int:
    """Delete the folders of loads that the current version does not use; for times without readers or loads."""
    content, path = snapshots.current(spark, star_dir), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs, n = path(star_dir).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0
    for table in STAR_TABLES if content else ():
        for status in fs.listStatus(path(f"{star_dir}/{table}")):
            if status.getPath().getName().removeprefix("load=") not in content["loads"]:
                n += bool(fs.delete(status.getPath(), True))
    return n
