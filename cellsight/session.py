"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: wall-clock hours/dates in UTC (H1), runtime
# re-planning, and skew splitting for joins and rebalanced writes.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def create_session(app_name: str = "cellsight", master: str | None = None,
                   shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster, leave ``master`` and ``shuffle_partitions`` unset and let the
    submit configuration decide; tests pass ``local[*]`` and a small count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_defaults(spark: SparkSession) -> None:
    """Pin the settings the semantics depend on in an existing session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Read from the session; only when nothing is configured (local runs and
    tests) a fresh temporary folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(intermediate tables are written there)")
        conf_dir = tempfile.mkdtemp(prefix="cellsight-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return (sc.getCheckpointDir() or conf_dir).rstrip("/")


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the checkpoint root for intermediate tables."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables made so far; call it once results are written. Returns their number.

    Results are lazy and may still read them, so nothing is deleted before.
    """
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _SCRATCH:
        path = hpath(_SCRATCH.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def materialize(df, name: str):
    """Write ``df`` as Parquet below the checkpoint root and return it read back.

    Cuts the lineage like ``checkpoint()`` but stores columnar, typed files
    in one pass; the table survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
