"""Line deduplication over levelled sorted runs of line hashes.

Documents are taken in batches of ascending ids. Each batch's line keys are
merge-joined with the runs written so far: keys found there belong to an
earlier (smaller) document, the rest (the merge anti-join) form the batch's
own sorted run on level 0. When a level holds ``FANOUT`` runs they are merged
into one sorted run of the next level. Only 128-bit hashes and ids take part;
texts move once, when the lines to drop meet their documents.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z in lower
case. Keys of at least 10 code points found in two documents or more keep
their lines in the smallest id only; all other lines stay.

Defined results: null or empty text is one empty line, which stays; a null
id sorts last and rows with a null id are one document; rows sharing an id
are one document for the count and are each rewritten; a line repeated
inside the only document that holds it stays; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsight.llm._common import fresh, small_batches, texts_of
from cellsight.session import materialize

BATCHES = 4                # batches of ascending ids in a full run
FANOUT = 2                 # runs of a level that are merged into one of the next
MIN_KEY = 10               # code points of the shortest key that counts
SPACE = " \t\n\x0b\x0c\r"
NULL_ID = (1 << 63) - 1    # stands for a null id

_KEY = ["h1", "h2"]


def _key_hash(line: str) -> int | None:
    """128-bit hash of a line's key; None if the key is too short to count."""
    key = line.strip(SPACE)
    if len(key) < MIN_KEY:
        return None
    return xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass").lower())


def _halves(h: int) -> tuple[int, int]:
    """The hash as two signed 64-bit numbers."""
    high, low = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    return high - (high >> 63 << 64), low - (low >> 63 << 64)


def line_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, h1, h2): the distinct keys of every row's whole text."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            doc, h1, h2 = [], [], []
            for d, text in zip(texts_of(batch, "doc"), texts_of(batch, "body"), strict=True):
                keys = {k for k in map(_key_hash, (text or "").split("\n")) if k is not None}
                doc += [d] * len(keys)
                for k in keys:
                    a, b = _halves(k)
                    h1.append(a)
                    h2.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, h1, h2)], ["doc", *_KEY])

    return rows.mapInArrow(run, "doc long, h1 long, h2 long")


class LineRuns:
    """Sorted runs of (h1, h2, owner), in levels; each key stands in one run."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def _all(self) -> DataFrame:
        out = self.spark.createDataFrame([], "h1 long, h2 long, owner long")
        for run in (r for level in self.levels for r in level):
            out = out.unionByName(run)
        return out

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in one batch of (doc, h1, h2), later than all before it; returns its shared keys with their owners."""
        own = lines.groupBy(*_KEY).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        before = self._all().select(*_KEY, "owner")
        merged = own.hint("merge").join(before, _KEY, "left")
        merged = materialize(merged.sortWithinPartitions(*_KEY), "line-batch")
        self._push(0, merged.where(F.col("owner").isNull()).select(*_KEY, F.col("first").alias("owner")))
        shared = F.col("owner").isNotNull() | (F.col("first") < F.col("last"))
        return merged.where(shared).select(*_KEY, F.coalesce("owner", "first").alias("owner"))

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            whole = merged[0]
            for other in merged[1:]:
                whole = whole.unionByName(other)
            whole = whole.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
            self._push(level + 1, materialize(whole, f"line-run-{level + 1}"))


def drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(doc, keys): for each document that loses lines, the hashes of their keys."""
    keys = line_keys(docs, id_col, text_col)
    cuts = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / batches for i in range(1, batches)])).first()[0]
    batch = F.lit(0)
    for cut in cuts or []:
        batch = batch + (F.col("doc") > F.lit(cut)).cast("int")
    lines = materialize(keys.withColumn("batch", batch), "line-keys")
    runs, shared = LineRuns(docs.sparkSession), None
    for i in range(batches):
        found = runs.add(lines.where(F.col("batch") == i).select("doc", *_KEY)).withColumn("batch", F.lit(i))
        shared = found if shared is None else shared.unionByName(found)
    # A key of very many documents is one row of ``shared``; its lines may be split between tasks.
    lost = lines.join(shared, ["batch", *_KEY]).where(F.col("doc") > F.col("owner"))
    return lost.groupBy("doc").agg(F.collect_set(F.struct(*_KEY)).alias("keys"))


def _keep(text: str | None, lost: list | None) -> tuple[str, int, int]:
    """The text without its lost lines, its lines before, and how many went."""
    lines = (text or "").split("\n")
    if not lost:
        return text or "", len(lines), 0
    gone = {(k["h1"], k["h2"]) for k in lost}
    kept = [x for x in lines if (h := _key_hash(x)) is None or _halves(h) not in gone]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _with_drops(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    lost, key = fresh(docs, "lost_keys"), fresh(docs, "lost_doc")
    found = drops(docs, id_col, text_col).select(F.col("doc").alias(key), F.col("keys").alias(lost))
    same = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)) == F.col(key)
    return docs.join(found, same, "left").drop(key), lost


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    joined, lost = _with_drops(rows, "doc_id", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            kept = [_keep(t, k) for t, k in zip(texts_of(batch, "body"), texts_of(batch, lost), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.int64()),
                 pa.array([sha256(k[0].encode("utf-8", "surrogatepass")).hexdigest() for k in kept], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                length_col: str | None = None) -> DataFrame:
    """``docs`` with the repeated lines gone from the text (and ``length_col``, if named, counted anew)."""
    joined, lost = _with_drops(docs, id_col, text_col)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            pairs = list(zip(texts_of(batch, text_col), texts_of(batch, lost), strict=True))
            new = [_keep(t, k)[0] if k else t for t, k in pairs]
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            cols[text_col] = pa.array(new, pa.string())
            if length_col:
                old = texts_of(batch, length_col)
                kind = cols[length_col].type
                cols[length_col] = pa.array([len(n) if k else o for n, o, (_, k) in zip(new, old, pairs, strict=True)], kind)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return joined.mapInArrow(run, docs.schema)
