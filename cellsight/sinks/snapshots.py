"""Versions of a set of tables, published by one small file.

Data files are only ever added, in folders that no reader knows yet. A version
becomes current when a numbered pointer file that lists its folders is
complete; readers take the highest complete number, once, and see either the
whole old version or the whole new one. Nothing is renamed or overwritten, so
this also holds on object stores; a second writer that took the same number
fails.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

_END = "\nend\n"
KEPT_POINTERS = 20


def _folder(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_versions")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, root: str) -> list:
    """Paths of the pointer files, newest first."""
    path, fs = _folder(spark, root)
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return sorted((p for p in names if p.getName().isdigit()), key=lambda p: -int(p.getName()))


def current(spark: SparkSession, root: str) -> dict | None:
    """What the current version consists of; None before the first one."""
    _, fs = _folder(spark, root)
    for pointer in _pointers(spark, root):
        stream = fs.open(pointer)
        text = bytes(stream.readAllBytes()).decode("utf-8")
        stream.close()
        if text.endswith(_END):  # a writer that died leaves an incomplete file
            return json.loads(text[:-len(_END)])
    return None


def publish(spark: SparkSession, root: str, content: dict) -> int:
    """Make ``content`` the current version; returns its number."""
    path, fs = _folder(spark, root)
    known = _pointers(spark, root)
    number = int(known[0].getName()) + 1 if known else 1
    stream = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{number:012d}"), False)
    stream.write(bytearray((json.dumps(content) + _END).encode("utf-8")))
    stream.close()
    for old in known[KEPT_POINTERS:]:
        fs.delete(old, False)
    return number
