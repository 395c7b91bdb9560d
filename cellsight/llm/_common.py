"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the word and line contracts: [\x20\x09-\x0D]. Python's
# bytes.split()/strip() without arguments use exactly these six bytes.


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str = "doc_id", modulus: int = 5):
    """crc32 of the id's text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


class HashCache(dict):
    """Word -> 64-bit hash, computed once per distinct word; emptied when it grows past ``limit``."""

    def __init__(self, fn: Callable, limit: int = 500_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.fn(word)
        return value

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays (wraps around by design)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def small_batches(batches: Iterable[pa.RecordBatch], max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``max_bytes`` (one long row stays whole)."""
    for batch in batches:
        rows = batch.num_rows
        if rows == 0:
            continue
        step = max(1, int(rows * max_bytes / max(batch.nbytes, 1)))
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now.

    It does so once the driver has collected their plans, which may otherwise
    be long after their results were written, and disks fill up meanwhile.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """At most ``rows`` rows in a record batch while wide rows (packed blocks, sets) are written."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
