"""Approximate nearest neighbours: one hierarchical small-world graph per shard.

Vectors are spread over shards of bounded size by a hash of their id. Every
shard is a graph of layers: a vector's top layer is drawn from a hash of its
id, each layer links a vector to a diverse choice of its nearest
predecessors, and links run both ways. The graph is stored as flat neighbour
arrays, one row per shard, in a Parquet table. A group of queries walks the
graphs of all shards (greedily down the layers, with a beam on the lowest) and
each task's best results are merged. The queries of a block walk together: a
vector that one of them comes to is read once and compared with all of them.

Equal vectors stand in the graph once; the 11 smallest ids of each are kept
beside it, which is all that a list of 10 neighbours can show.

Defined results: rows with a null id, or with a null, empty, zero or
non-finite vector, take no part; rows sharing an id count once, with the
smallest of their vectors; only vectors of equal length are compared; ties
go to the smaller id; a query with fewer candidates returns all it finds; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsight.llm._common import arrow_rows, mix64, release_shuffles
from cellsight.llm._vectors import Found, best, block_count, entries, gathered, query_groups, shared, valid_vectors
from cellsight.session import materialize

LINKS = 16                 # links of a vector on the upper layers; twice as many on the lowest
BUILD_WIDTH = 64           # nearest predecessors among which links are chosen
SEARCH_WIDTH = 128         # beam on the lowest layer
SHARD_ROWS = 4096          # distinct vectors in a shard
QUERY_ROWS = 512           # queries in a block
OPENED = 4                 # nodes of a beam that are opened in one step
STEP_ROWS = 128            # vectors that look for their predecessors at once
STEP_NODES = 1024          # vectors that are read at once
READ_PAIRS = 1 << 16       # differences taken at once

INDEX_SCHEMA = ("dim int, kind string, vectors binary, copies binary, counts binary, nodes array<binary>, "
                "links array<binary>")


def _lowest(near: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``width`` lowest columns, lowest first (-1 where an entry is infinite), and the highest of their entries."""
    rows, n = near.shape
    low = None
    if n >= 8 * width:
        # As many columns as are wanted lie at or below the limit: the lowest of each of some groups of columns.
        size = n // (4 * width)
        groups = near[:, :4 * width * size].reshape(rows, 4 * width, size).min(axis=2)
        limit = np.partition(groups, width - 1, axis=1)[:, width - 1]
        r, c = np.divmod(np.flatnonzero((near <= limit[:, None]) & (near < np.inf)), n)
        count = np.bincount(r, minlength=rows)
        if count.max() <= 16 * width:  # else there are many ties
            place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            order, low = np.full((rows, count.max()), -1), np.full((rows, count.max()), np.inf, near.dtype)
            order[r, place], low[r, place] = c, near[r, c]
    if low is None:
        order = np.argpartition(near, width - 1, axis=1)[:, :width] if n > width else np.tile(np.arange(n), (rows, 1))
        low = np.take_along_axis(near, order, 1)
    by = np.argsort(low, axis=1, kind="stable")[:, :width]
    order, low = np.take_along_axis(order, by, 1), np.take_along_axis(low, by, 1)
    order = np.where(low < np.inf, order, -1)
    high = np.where(order >= 0, low, -np.inf).max(axis=1, initial=-np.inf)
    return np.pad(order, ((0, 0), (0, width - order.shape[1])), constant_values=-1), high


def _predecessors(v: np.ndarray, width: int) -> np.ndarray:
    """Per vector its ``width`` nearest predecessors, nearest first; -1 where there are fewer."""
    n = len(v)
    sq = np.einsum("ij,ij->i", v, v)
    found = np.full((n, width), -1)
    for start in range(1, n, STEP_ROWS):
        rows = np.arange(start, min(start + STEP_ROWS, n))
        later = rows[:, None] <= np.arange(start, rows[-1] + 1)
        near = (-2 * v[rows]) @ v[:rows[-1] + 1].T
        near += sq[:rows[-1] + 1]
        near[:, start:][later] = np.inf
        found[rows], high = _lowest(near, width)
        # Where neighbours are so near that rounding could change their order.
        close = np.flatnonzero(high + sq[rows] < 1e-4 * sq[rows])
        if len(close) and v.dtype == np.float32:
            x, y = v[rows[close]].astype(np.float64), v[:rows[-1] + 1].astype(np.float64)
            near = (x * x).sum(1)[:, None] - 2 * x @ y.T + np.einsum("ij,ij->i", y, y)
            near[:, start:][later[close]] = np.inf
            found[rows[close]] = _lowest(near, width)[0]
    return found


def _diverse(own: np.ndarray, near: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Per node, of its candidates (-1: none) in the order of distance, those closer to it than to any chosen before; then the rest."""
    off = v[near] - v[own][:, None]
    dist = np.einsum("ijk,ijk->ij", off, off)
    dist[near < 0] = np.inf
    order = np.argsort(dist, axis=1, kind="stable")
    near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
    off = off[np.arange(len(own))[:, None], order]
    between = dist[:, :, None] + dist[:, None, :] - 2 * (off @ off.transpose(0, 2, 1))
    shut, chosen = near < 0, np.zeros(near.shape, bool)
    count = np.zeros(len(own), np.int64)
    for c in range(near.shape[1]):
        chosen[:, c] = ~shut[:, c] & (count < most)
        count += chosen[:, c]
        shut |= chosen[:, c, None] & (between[:, c] <= dist)
        if c >= most and (count == most).all():
            break
    kept = np.argsort(2 * (near < 0) - 1 * chosen, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(near, kept, 1)


def _linked(v: np.ndarray, links: int, most: int, width: int) -> np.ndarray:
    """Neighbours (-1: free) of each node of a layer: a choice of its predecessors, and of the nodes that chose it."""
    n = len(v)
    near = _predecessors(v, width)
    own = np.full((n, most), -1)
    for at in range(0, n, STEP_ROWS):
        chosen = _diverse(np.arange(at, min(at + STEP_ROWS, n)), near[at:at + STEP_ROWS], v, links)
        own[at:at + STEP_ROWS, :chosen.shape[1]] = chosen
    # Links back come in the order of their nodes; a list that grows too long is cut to the diverse again.
    source, slot = np.nonzero(own >= 0)
    target = own[source, slot]
    source = source[np.argsort(target, kind="stable")]
    count = np.bincount(target, minlength=n)
    start = np.cumsum(count) - count
    taken = np.zeros(n, np.int64)
    rows = np.flatnonzero(count)
    while len(rows):
        at = taken[rows, None] + np.arange(most)
        more = at < count[rows, None]
        back = np.where(more, source[np.where(more, start[rows, None] + at, 0)], -1)
        every = np.concatenate([own[rows], back], axis=1)
        fits = (every >= 0).sum(axis=1) <= most
        packed = np.argsort(every[fits] < 0, axis=1, kind="stable")[:, :most]
        own[rows[fits]] = np.take_along_axis(every[fits], packed, 1)
        long = np.flatnonzero(~fits)
        for part in np.split(long, range(STEP_ROWS, len(long), STEP_ROWS)):
            own[rows[part]] = _diverse(rows[part], every[part], v, most)
        taken[rows] += most
        rows = rows[taken[rows] < count[rows]]
    return own


def build(ids: np.ndarray, vectors: np.ndarray, links: int = LINKS,
          width: int = BUILD_WIDTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Nodes of each layer (lowest first) and their neighbours, flat, -1 where a slot is free."""
    with np.errstate(over="ignore"):
        u = (mix64(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64)
    level = np.minimum((-np.log((u + 1) / float(1 << 53)) / np.log(links)).astype(np.int64), 16)
    nodes_of, flat_of = [], []
    for layer in range(int(level.max(initial=0)) + 1):
        nodes = np.flatnonzero(level >= layer)
        flat = _linked(vectors[nodes], links, links * (2 if layer == 0 else 1), width)
        nodes_of.append(nodes.astype(np.int32))
        flat_of.append(np.where(flat >= 0, nodes[flat], -1).astype(np.int32))
    return nodes_of, flat_of


class Walk:
    """A block of queries in one shard's vectors.

    The queries walk together: a vector that one of them comes to is read once
    and compared with all of them, in products of blocks.
    """

    def __init__(self, vectors: np.ndarray, queries: np.ndarray):
        self.vectors, self.queries = vectors, queries
        size, q_size = (np.einsum("ij,ij->i", x, x)[:, None] for x in (vectors, queries))
        # So that one product gives squared distances.
        self.stored = np.hstack([vectors, size, np.ones_like(size)])
        self.asked = np.hstack([-2 * queries, np.ones_like(q_size), q_size])
        self.close = q_size[:, 0] / 40
        self.read = 0

    def distances(self, nodes: np.ndarray) -> np.ndarray:
        d = self.asked @ self.stored[nodes].T
        self.read += len(nodes)
        # Where little is left of the two sizes, rounding shows: these are taken from the differences.
        rows = np.flatnonzero(d.min(axis=1) < self.close)
        r, c = np.nonzero(d[rows] < self.close[rows, None])
        for at in range(0, len(r), READ_PAIRS):
            i, j = rows[r[at:at + READ_PAIRS]], c[at:at + READ_PAIRS]
            off = self.vectors[nodes[j]] - self.queries[i]
            d[i, j] = np.einsum("ij,ij->i", off, off)
        return d

    def layer(self, links: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query its ``width`` nearest of the nodes come to (n and inf where there are fewer).

        ``links`` has a row for each vector and a last one; n stands for free slots. A node is open while it has
        neighbours that were not read; each step opens the nearest of every query's beam.
        """
        nq, n = len(self.queries), len(self.vectors)
        beam, dist = np.full((nq, width), n, np.int32), np.full((nq, width), np.inf, self.vectors.dtype)
        seen, is_open, every = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.arange(nq)
        seen[n] = True
        new = np.unique(starts)
        while len(new):
            seen[new] = True
            for at in range(0, len(new), STEP_NODES):
                self._merge(beam, dist, new[at:at + STEP_NODES])
            is_open[beam] = True
            inside = np.flatnonzero(is_open)
            is_open[inside] = ~seen[links[inside]].all(axis=1)
            left = np.where(is_open[beam], dist, np.inf)
            is_open[inside] = False
            reached = np.zeros(n + 1, bool)
            for _ in range(min(OPENED, width)):
                j = left.argmin(axis=1)
                some = left[every, j] < np.inf
                reached[links[np.unique(beam[every, j][some])]] = True
                left[every, j] = np.inf
            new = np.flatnonzero(reached & ~seen)
        return beam, dist

    def _merge(self, beam: np.ndarray, dist: np.ndarray, new: np.ndarray) -> None:
        width, d = beam.shape[1], self.distances(new)
        worst = dist.max(axis=1)
        if not (worst < np.inf).all():  # the first nodes
            keep_d, keep = np.hstack([dist, d]), np.hstack([beam, np.broadcast_to(new.astype(np.int32), d.shape)])
            rows = slice(None)
        else:
            near = np.flatnonzero(d < worst[:, None])
            if not len(near):
                return
            r = near // len(new)
            count = np.bincount(r, minlength=len(d))
            rows, wide = np.flatnonzero(count), count.max()
            # Each row's entries one after the other in a row of their own.
            place = np.arange(len(r)) + np.repeat((np.cumsum(count > 0) - 1) * wide - np.cumsum(count) + count, count)
            more = np.full((len(rows), wide), len(self.vectors), np.int32)
            more_d = np.full(more.shape, np.inf, dist.dtype)
            more.ravel()[place], more_d.ravel()[place] = new[near - r * len(new)], d.ravel()[near]
            keep_d, keep = np.hstack([dist[rows], more_d]), np.hstack([beam[rows], more])
        best = np.argpartition(keep_d, width - 1, axis=1)[:, :width]
        beam[rows], dist[rows] = np.take_along_axis(keep, best, 1), np.take_along_axis(keep_d, best, 1)


def walk(vectors: np.ndarray, nodes: list[np.ndarray], flat: list[np.ndarray], queries: np.ndarray,
         width: int = SEARCH_WIDTH) -> tuple[np.ndarray, np.ndarray, int]:
    """For each query the nodes of its final beam and their squared distances, nearest first (-1 and inf where it is
    not full), and the number of vectors that were read.
    """
    n, block = len(vectors), Walk(vectors, queries)
    at = np.full(len(queries), nodes[-1][0])
    for layer in range(len(nodes) - 1, -1, -1):  # greedily to the nearest node of the layer, with a beam on the lowest
        links = np.full((n + 1, flat[layer].shape[1]), n, np.int32)
        links[nodes[layer]] = np.where(flat[layer] < 0, n, flat[layer])
        beam, dist = block.layer(links, at, 1 if layer else min(width, n))
        at = beam[:, 0]
    order = np.argsort(dist, axis=1, kind="stable")
    beam, dist = np.take_along_axis(beam, order, 1), np.take_along_axis(dist, order, 1)
    return np.where(dist < np.inf, beam, -1), dist, block.read


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, copies: int = 11) -> DataFrame:
    """The stored graphs of (vec_id, v), one row per shard."""
    # The hash comes first, so that sorts seldom compare vectors; -0.0 and 0.0 are equal.
    alike = vectors.withColumn("hash", F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0))))
    first = Window.partitionBy("hash", "v").orderBy("vec_id")
    distinct = (alike.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= copies).groupBy("hash", "v")
                .agg(F.min("vec_id").alias("vec_id"), F.sort_array(F.collect_list("vec_id")).alias("copies")).drop("hash"))
    distinct = materialize(distinct, "ann-vectors")
    release_shuffles(vectors.sparkSession)
    shards = block_count(distinct.count(), shard_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, table, v in gathered(batches):
            v = _narrow(v)
            nodes, flat = build(table["vec_id"].to_numpy(), v)
            copied = table["copies"].combine_chunks()
            yield pa.RecordBatch.from_pylist([{
                "dim": dim, "kind": v.dtype.name, "vectors": v.tobytes(),
                "copies": entries(table["copies"]).astype(np.int64).tobytes(),
                "counts": copied.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32).tobytes(),
                "nodes": [x.tobytes() for x in nodes], "links": [x.tobytes() for x in flat]}], pa.schema([
                    ("dim", pa.int32()), ("kind", pa.string()), ("vectors", pa.binary()), ("copies", pa.binary()),
                    ("counts", pa.binary()), ("nodes", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))]))

    with arrow_rows(vectors.sparkSession, 4096):
        return materialize(distinct.repartition(shards, "vec_id").mapInArrow(run, INDEX_SCHEMA), "ann-index")


def _narrow(v: np.ndarray) -> np.ndarray:
    """Vectors in single precision if that holds every entry and square."""
    size = np.abs(v)
    fits = size.max() < 1e15 and size.max() > 1e-10 and (v == v.astype(np.float32)).all()
    return v.astype(np.float32 if fits else np.float64)


def nearest(table: DataFrame, k: int = 10, query_every: int = 100, id_col: str = "vec_id",
            vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row, by Euclidean distance."""
    spark = table.sparkSession
    vectors = materialize(valid_vectors(table, id_col, vec_col, drop_zero=True), "ann-valid")
    queries = materialize(vectors.where(F.pmod("vec_id", F.lit(query_every)) == 0), "ann-queries")
    release_shuffles(spark)
    index = build_index(vectors, shard_rows, copies=k + 1)
    release_shuffles(spark)

    def walks(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, found = sent.value, {dim: Found(len(ids), k, np.float64) for dim, (ids, _) in sent.value.items()}
            for row in (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                if row["dim"] in asked:
                    search(row, *asked[row["dim"]], k, found[row["dim"]])
            for dim, x in found.items():
                yield from x.results(asked[dim][0])
        return run

    parts = []
    with arrow_rows(spark, 1):
        for group in query_groups(queries):
            with shared(table, group) as sent:
                parts.append(materialize(index.mapInArrow(walks(sent), "query_id long, vec_id long, score double"), "ann-found"))
    return best(reduce(DataFrame.union, parts), k, [F.col("score"), F.col("vec_id")])


def search(shard: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, found: Found) -> None:
    """Add each query's nearest of one stored graph, with their copies."""
    v = np.frombuffer(shard["vectors"], shard["kind"]).reshape(-1, shard["dim"])
    nodes = [np.frombuffer(x, np.int32) for x in shard["nodes"]]
    flat = [np.frombuffer(x, np.int32).reshape(len(m), -1) for x, m in zip(shard["links"], nodes, strict=True)]
    copies, counts = np.frombuffer(shard["copies"], np.int64), np.frombuffer(shard["counts"], np.int32).astype(np.int64)
    start = np.cumsum(counts) - counts
    for first in range(0, len(queries), QUERY_ROWS):
        q = queries[first:first + QUERY_ROWS]
        beam, _, _ = walk(v, nodes, flat, q.astype(v.dtype))
        # The query itself may be the nearest node; a few more, as the walk's distances are rounded.
        beam = beam[:, :2 * (k + 1)]
        r, c = np.nonzero(beam >= 0)
        hit = beam[r, c]
        score = np.sqrt(((v[hit].astype(np.float64) - q[r]) ** 2).sum(1))
        at = np.repeat(np.arange(len(hit)), counts[hit])
        place = np.arange(len(at)) - np.repeat(np.cumsum(counts[hit]) - counts[hit], counts[hit])
        ids = copies[start[hit][at] + place]
        other = ids != query_ids[first + r[at]]
        found.add(first + r[at][other], ids[other], score[at][other])
