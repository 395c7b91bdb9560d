"""Embedding whitening with MLlib's BlockMatrix.

The centred rows stand in blocks of ``BLOCK_ROWS`` rows. Their scatter matrix
is the product of the transposed block matrix with itself; the products are
spread over tasks of ``TASK_BLOCKS`` blocks and only sums of dimension x
dimension travel on. Its eigenvectors are found on the driver (one matrix of
dimension x dimension), and a second block multiplication projects the rows.
There the blocks are arranged in a square grid, and the whitening matrix
stands on the diagonal of the right side: block products are the same, and
Spark's grid partitioner deals a square out evenly, a tall column not.

Components are numbered by falling eigenvalue. A component whose eigenvalue is
rounding only (at most dimension x 2^-52 x the largest) has no whitened
values: null.

Defined results: vectors that are null or hold null or non-finite entries take
no part, nor do those with an entry whose scaled value leaves 62 bits; every
other row is a row of its own, also under a null or shared id; vectors of
different lengths are whitened apart, each length over its own rows; a vector
without entries has no component and so no row; one single row or equal rows
have no variance and null values; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, LongType, StructField, StructType

from cellsight.llm._common import arrow_rows, release_shuffles
from cellsight.session import materialize

SCALE, SHIFT = 64, 1_000_000   # an entry c counts as floor(SCALE * c) + SHIFT
COMPONENTS = 32
BLOCK_ROWS = 4096              # rows of a block
TASK_BLOCKS = 16               # blocks whose products one task adds up
_EXACT = 1 << 62


@dataclass
class Whitening:
    """What was fitted on ``n`` rows of one length: exact sums, and per component the projection and its share."""
    n: int
    sums: np.ndarray            # Python integers
    projection: np.ndarray      # dimension x components, already over the root of the eigenvalue
    usable: np.ndarray          # components with an eigenvalue above rounding
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in doubles, rounded once: n*x - S is exact."""
        return (self.offsets(x) / self.n).astype(float)

    def offsets(self, x: np.ndarray) -> np.ndarray:
        return x.astype(object) * self.n - self.sums


def scaled(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, dim, x, seq): usable rows with their scaled entries, numbered upwards within each part of the table."""
    rows = table.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    most = F.lit(float(_EXACT // SCALE))
    # Null, NaN and infinite entries all fail the comparison or make it null.
    usable = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < most), F.lit(False)))
    x = F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT))
    found = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & usable)
    return materialize(found.select("id", F.size("v").alias("dim"), x.alias("x"),
                                    F.monotonically_increasing_id().alias("seq")), "white-rows")


def exact_sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Per length of vector: the number of rows and the exact sum of each dimension."""
    entries = rows.select("dim", F.posexplode("x").alias("place", "x"))
    # Halves of 32 bits, so that no sum leaves 64.
    found = entries.groupBy("dim", "place").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.shiftright("x", 32)).alias("high"),
        F.sum(F.col("x").bitwiseAND(F.lit((1 << 32) - 1))).alias("low"))
    out: dict = {}
    for r in found.collect():  # one row per dimension
        _, s = out.setdefault(r["dim"], (r["n"], np.zeros(r["dim"], object)))
        s[r["place"]] = (r["high"] << 32) + r["low"]
    return out


def packed(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, members): rows numbered from 0 on without gaps, ``block_rows`` of them in a block."""
    part = F.shiftright("seq", 33).alias("part")
    before, starts = 0, []
    for r in rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # one row per part
        starts.append((r["part"], before))
        before += r["n"]
    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, start long"))
    in_part = F.row_number().over(Window.partitionBy("part").orderBy("seq")) - 1
    numbered = (rows.select("id", "x", "seq", part).withColumn("in_part", in_part).join(first, "part")
                .withColumn("row", F.col("start") + F.col("in_part")))
    blocks = numbered.groupBy(F.expr(f"row div {block_rows}").alias("block"))
    return materialize(blocks.agg(F.sort_array(F.collect_list(F.struct("row", "id", "x"))).alias("members")), "white-blocks")


def _rows(column: pa.ListArray, row: int, field: str) -> tuple[pa.StructArray, np.ndarray]:
    members = column.slice(row, 1).flatten()
    return members, members.field(field).flatten().to_numpy(zero_copy_only=False).reshape(len(members), -1)


def block_matrix(blocks: DataFrame, model: Whitening, block_rows: int, count: int, across: int = 1) -> BlockMatrix:
    """The centred rows as a block matrix, ``across`` blocks side by side; a row that the last block lacks is zero."""
    width = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = np.zeros((block_rows, width))
                found = model.centred(_rows(batch.column(1), row, "x")[1])
                x[:len(found)] = found
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([x.ravel(order="F")])], ["block", "x"])

    cells = blocks.mapInArrow(run, "block long, x array<double>").rdd.map(
        lambda r: ((r["block"] // across, r["block"] % across), DenseMatrix(block_rows, width, r["x"])))
    return BlockMatrix(cells, block_rows, width, math.ceil(count / across) * block_rows, across * width)


@contextmanager
def kept(matrix: BlockMatrix) -> Iterator[BlockMatrix]:
    """Its blocks, which a product reads several times, stay in memory or on disk; a lost one is made again."""
    yield matrix.persist(StorageLevel.MEMORY_AND_DISK)
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)


def product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left x right. The inner dimension is dealt to ``splits`` tasks, as multiply(other, splits) does in Scala."""
    model = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(model, left.rowsPerBlock, right.colsPerBlock)


def fit(blocks: DataFrame, n: int, sums: np.ndarray, components: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> Whitening:
    """Eigenvectors of the covariance of all rows in ``blocks``, whose scatter is a product of block matrices."""
    width, count = len(sums), math.ceil(n / block_rows)
    model = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0, bool), np.zeros(0))
    with kept(block_matrix(blocks, model, block_rows, count)) as x:
        scatter = product(x.transpose(), x, math.ceil(count / TASK_BLOCKS)).toLocalMatrix().toArray()
    cov = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    model.usable = values > max(float(values[0]), 0.0) * width * np.finfo(float).eps
    model.projection = vectors / np.sqrt(np.where(model.usable, values, 1.0))
    total = float(np.trace(cov))
    model.explained = np.maximum(values, 0.0) / total if total > 0 else np.zeros(len(values))
    return model


def project(blocks: DataFrame, model: Whitening, id_type, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n, deviation, whitened) of every row, from the centred rows times the projection."""
    spark, count = blocks.sparkSession, math.ceil(model.n / block_rows)
    across = math.ceil(math.sqrt(count))
    width, k = model.projection.shape
    flat = model.projection.ravel(order="F")
    # A grid of blocks times the projection on the diagonal: each block meets the projection once.
    diagonal = spark.sparkContext.range(across, numSlices=math.ceil(count / TASK_BLOCKS)).map(
        lambda g: ((g, g), DenseMatrix(width, k, flat)))
    schema = StructType([StructField("id", id_type), StructField("n", LongType()), StructField("deviation", DecimalType(38, 0)),
                         StructField("whitened", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                members, ints = _rows(batch.column(0), row, "x")
                values = batch.column(1).slice(row, 1).field("values").flatten()
                white = values.to_numpy(zero_copy_only=False).reshape(k, block_rows).T[:len(members)]
                rows = [[v if ok else None for v, ok in zip(r, model.usable, strict=True)] for r in white.tolist()]
                far = (model.offsets(ints) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [members.field("id"), pa.array([model.n] * len(rows), pa.int64()),
                     pa.array([Decimal(v) if v < 10 ** 38 else None for v in far], pa.decimal128(38, 0)),
                     pa.array(rows, pa.list_(pa.float64()))], ["id", "n", "deviation", "whitened"])

    with kept(block_matrix(blocks, model, block_rows, count, across)) as x:
        y = product(x, BlockMatrix(diagonal, width, k, across * width, across * k))
        found = callMLlibFunc("getMatrixBlocks", y._java_matrix_wrapper._java_model)
        found = found.select((F.col("_1._1") * across + F.col("_1._2")).alias("block"), F.col("_2").alias("y"))
        met = blocks.join(found, "block").select("members", "y")
        return materialize(met.mapInArrow(run, schema), "white-found")


def identity_error(white: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity; None without usable components."""
    k = int(model.usable.sum())
    if not k:
        return None
    usable = model.usable

    def added(what, size: int) -> np.ndarray:
        """The sum of ``what`` over all rows: one row of partial sums per task, then per place."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, usable]
                out += what(y)
            yield pa.RecordBatch.from_arrays([pa.array([out])], ["s"])

        parts = white.select("whitened").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("place", "v"))
        found = {r["place"]: r["v"] for r in parts.groupBy("place").agg(F.sum("v").alias("v")).collect()}
        return np.array([found[i] for i in range(size)])

    mean = added(lambda y: y.sum(axis=0), k) / model.n
    cov = added(lambda y: ((y - mean).T @ (y - mean)).ravel(), k * k).reshape(k, k) / model.n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS,
           block_rows: int = BLOCK_ROWS) -> list[tuple[Whitening, DataFrame]]:
    """The fit and the rows (id, n, deviation, whitened) of every length of vector."""
    rows = scaled(table, id_col, vec_col)
    out = []
    with arrow_rows(table.sparkSession, 4):  # a row is a block
        for dim, (n, sums) in sorted(exact_sums(rows).items()):
            blocks = packed(rows.where(F.col("dim") == dim), block_rows)
            model = fit(blocks, n, sums, components, block_rows)
            out.append((model, project(blocks, model, table.schema[id_col].dataType, block_rows)))
            release_shuffles(table.sparkSession)
    return out


def whitened_by_component(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per vector and component.

    A deviation that leaves 64 bits is null.
    """
    found = []
    for model, white in whiten(table, id_col, vec_col, **options):
        error = F.lit(identity_error(white, model)).cast("double")
        shares = F.array(*[F.lit(float(v)) for v in model.explained])
        rows = white.select("id", "n", "deviation", F.posexplode("whitened").alias("place", "whitened"))
        found.append(rows.select(
            F.col("id").alias("vec_id"), (F.col("place") + 1).cast("int").alias("component"), "n",
            F.expr("try_cast(deviation as long)").alias("deviation"),
            "whitened", F.element_at(shares, F.col("place") + 1).alias("explained"), error.alias("identity_error")))
    return reduce(DataFrame.unionByName, found) if found else _none(table, id_col)


def _none(table: DataFrame, id_col: str) -> DataFrame:
    return table.where("false").select(
        F.col(id_col).alias("vec_id"), *(F.lit(None).cast(t).alias(c) for c, t in (
            ("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"),
            ("identity_error", "double"))))
