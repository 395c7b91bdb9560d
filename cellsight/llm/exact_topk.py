"""Exact top-k by a vector-approximation file.

Each component is quantised to one of 64 cells per dimension and block, and
the cells are stored once, beside the exact vectors. For a query, the cells
alone give an upper bound of every vector's inner product (a lower bound of
its distance from the best); exact vectors are read only where that bound
reaches the k-th score found so far. A task starts with those of the best
bounds. It scans its blocks for a group of queries, whose k-th scores pass
from block to block; the tasks' best results are merged.

Bounds are products in single precision with room for their rounding; scores
are whole numbers and exact.

Defined results: rows with a null id, or with a null, empty or non-finite
vector, take no part; rows sharing an id count once, with the smallest of
their vectors; only vectors of equal length are compared; ties go to the
smaller id; a query with fewer candidates returns all of them; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.llm._common import arrow_rows, release_shuffles
from cellsight.llm._vectors import Found, best, block_count, gathered, query_groups, shared, valid_vectors
from cellsight.session import materialize

CELL_BITS = 6
SHARD_ROWS = 4096          # vectors in a block
QUERY_ROWS = 512           # queries that meet a block at once,
COLUMNS = 512              # and vectors of it: their products stay in a core's cache
TASK_BLOCKS = 64           # blocks that one task scans, fewer while there are too few tasks
SCALE = 256                # components become floor(SCALE * x)
FIRST_READ = 32            # exact vectors read at the start
READ_PAIRS = 1 << 16       # exact vectors read at once

FILE_SCHEMA = "dim int, ids binary, low binary, width binary, cells binary, kind string, exact binary"


class ApproximationFile:
    """Cells of one block, with bounds on inner products."""

    def __init__(self, vectors: np.ndarray, bits: int = CELL_BITS):
        self.low = vectors.min(axis=0).astype(np.float64)
        cells = 1 << bits
        self.width = np.maximum((vectors.max(axis=0) - self.low) / cells, 1e-12)
        self.cells = np.minimum((vectors - self.low) / self.width, cells - 1).astype(np.uint8)
        self._open()

    @classmethod
    def stored(cls, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> ApproximationFile:
        self = cls.__new__(cls)
        self.low, self.width, self.cells = low, width, cells
        self._open()
        return self

    def _open(self) -> None:
        self.top = self.cells.max(axis=0, initial=0).astype(np.float64)
        # Single precision holds every cell; doubles are for entries whose products would leave its range.
        self.kind = np.float32 if np.abs(self.low).max() < 1e15 and self.width.max() < 1e15 else np.float64
        self.steps = self.cells.astype(self.kind)

    def asked(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The queries as they are multiplied with cells, and what makes each one's products upper bounds."""
        kind = self.kind if np.abs(queries).max(initial=0) < 1e15 else np.float64
        size = np.abs(queries)
        middle = self.low + self.width / 2
        half = size @ (self.width / 2)
        most = size @ (self.top * self.width)
        # Room for the rounding of the product and of the doubles themselves.
        rounding = (queries.shape[1] + 8) * float(np.finfo(kind).eps) * most
        reach = size @ np.abs(middle) + most + half
        return (queries * self.width).astype(kind), queries @ middle + half + rounding + 1e-9 * reach + 1e-6

    def upper_bounds(self, queries: np.ndarray) -> np.ndarray:
        """No inner product with a vector exceeds its entry; one row per query."""
        part, rest = self.asked(queries)
        return part @ self.steps.T + rest[:, None]


def scan(file: ApproximationFile, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
         found: Found) -> None:
    """Add each query's best vectors of one block, at a cost of ~score; vectors and queries are integers."""
    # Whole numbers below 2^53 are exact in doubles.
    reach = float(np.abs(vectors).max()) * float(np.abs(queries).max()) * vectors.shape[1]
    n = len(ids)

    def read(rows: np.ndarray, cols: np.ndarray) -> None:
        other = ids[cols] != query_ids[first + rows]
        rows, cols = rows[other], cols[other]
        if len(rows) * 16 > len(tile) * n and reach < 1 << 53:
            whole = tile.astype(np.float64) @ vectors.T.astype(np.float64)
            found.add(first + rows, ids[cols], ~whole[rows, cols].astype(np.int64))
            return
        for at in range(0, len(rows), READ_PAIRS):
            r, c = rows[at:at + READ_PAIRS], cols[at:at + READ_PAIRS]
            scores = np.einsum("ij,ij->i", tile[r].astype(np.int64), vectors[c].astype(np.int64))
            found.add(first + r, ids[c], ~scores)

    def limits() -> np.ndarray:
        """Rounded down, so no bound that reaches the k-th score is lost; what has been read is -inf."""
        score = -1 - found.most(first, first + len(tile)).astype(np.float64)
        x = (score - rest).astype(asked.dtype)
        return np.maximum(np.nextafter(x, x.dtype.type(-np.inf)), np.finfo(x.dtype).min)

    for first in range(0, len(queries), QUERY_ROWS):
        tile = queries[first:first + QUERY_ROWS]
        asked, rest = file.asked(tile.astype(np.float64))
        limit, near = limits(), []
        for at in range(0, n, COLUMNS):
            part = asked @ file.steps[at:at + COLUMNS].T
            new = np.flatnonzero(found.count[first:first + len(tile)] < found.k) if at == 0 else ()
            if len(new) and part.shape[1] >= FIRST_READ:
                # The best bound of each of so many groups.
                size = part.shape[1] // FIRST_READ
                cols = part[new, :FIRST_READ * size].reshape(len(new), FIRST_READ, size).argmax(axis=2)
                cols += np.arange(0, FIRST_READ * size, size)
                read(np.repeat(new, FIRST_READ), cols.ravel())
                part[new[:, None], cols] = -np.inf
                limit = limits()
            rows = np.flatnonzero(part.max(axis=1) >= limit)
            if len(rows):
                r, c = np.divmod(np.flatnonzero(part[rows] >= limit[rows, None]), part.shape[1])
                near.append((rows[r], at + c))
        if near:
            read(*map(np.concatenate, zip(*near, strict=True)))


def approximated(vectors: DataFrame, shard_rows: int, tasks: int) -> DataFrame:
    """The stored vector-approximation file of (vec_id, v): blocks of cells and exact vectors, dealt by a hash of the id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, table, v in gathered(batches, shard_rows):
            file = ApproximationFile(v)
            exact = v.astype(next(t for t in (np.int16, np.int32, np.int64) if (v == v.astype(t)).all()))
            yield pa.RecordBatch.from_pylist([{
                "dim": dim, "ids": table["vec_id"].to_numpy().tobytes(), "low": file.low.tobytes(),
                "width": file.width.tobytes(), "cells": file.cells.tobytes(), "kind": exact.dtype.name,
                "exact": exact.tobytes()}], pa.schema([
                    ("dim", pa.int32()), ("ids", pa.binary()), ("low", pa.binary()), ("width", pa.binary()),
                    ("cells", pa.binary()), ("kind", pa.string()), ("exact", pa.binary())]))

    with arrow_rows(vectors.sparkSession, SHARD_ROWS):
        return materialize(vectors.repartition(tasks, "vec_id").mapInArrow(run, FILE_SCHEMA), "topk-file")


def top_k(table: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query row."""
    spark = table.sparkSession
    vectors = valid_vectors(table, id_col, vec_col).withColumn(
        "v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")))
    vectors = materialize(vectors, "topk-vectors")
    shards = block_count(vectors.count(), shard_rows)
    tasks = max(block_count(shards, TASK_BLOCKS), min(shards, 4 * spark.sparkContext.defaultParallelism))
    file = approximated(vectors, shard_rows, tasks)
    queries = materialize(vectors.where(F.pmod("vec_id", F.lit(query_every)) == 0), "topk-queries")
    release_shuffles(spark)

    def scans(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, found = sent.value, {dim: Found(len(ids), k, np.int64) for dim, (ids, _) in sent.value.items()}
            for row in (row for batch in batches for row in batch.to_pylist()):
                dim = row["dim"]
                if dim in asked:
                    cells = ApproximationFile.stored(np.frombuffer(row["low"]), np.frombuffer(row["width"]),
                                                     np.frombuffer(row["cells"], np.uint8).reshape(-1, dim))
                    scan(cells, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["exact"], row["kind"]).reshape(-1, dim),
                         *asked[dim], found[dim])
            for dim, x in found.items():
                for batch in x.results(asked[dim][0]):
                    yield batch.set_column(2, "score", pa.array(~batch.column(2).to_numpy()))
        return run

    parts = []
    with arrow_rows(spark, 4):
        for group in query_groups(queries):
            with shared(table, group) as sent:
                parts.append(materialize(file.mapInArrow(scans(sent), "query_id long, vec_id long, score long"), "topk-found"))
    return best(reduce(DataFrame.union, parts), k, [F.col("score").desc(), F.col("vec_id")])
