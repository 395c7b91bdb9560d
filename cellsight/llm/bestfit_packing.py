"""Best-fit packing of documents into sequences of several permitted lengths.

A document longer than the largest length is cut into pieces of that length
and a rest. Pieces are spread by a hash over groups of bounded size; each
group is packed on its own, longest piece first: a piece goes into the open
bin with the least room that still fits, and where none fits a bin is opened.
Its length is the one with the least cost per token, given what is still to
come: the piece and, up to the room beside it, the remaining pieces short
enough for that room. A sequence costs its length, padding included, an
attention part that grows with the square of the length, and a fixed part, so
short pieces fill short sequences and only long pieces open long ones. At the
end each bin is downsized to the smallest permitted length that holds its
contents.

Defined results: a document without words (null or blank text) has one row
of 0 tokens and no bin; pieces of equal length are taken in order of id and
piece; repeated rows are packed as often as they occur; an empty table gives
an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.llm._common import small_batches, texts_of
from cellsight.session import materialize

LENGTHS = (512, 1024, 2048, 4096, 8192)   # permitted sequence lengths, in tokens
BIN_COST = 16.0            # fixed cost of a sequence, in tokens
ATTENTION = 16_384         # length at which the attention part costs as much as the tokens
GROUP_PIECES = 16_384      # pieces packed together


def word_count(text: str | None) -> int:
    """Words [^\\x20\\x09-\\x0D]+ of a whole text."""
    return len(text.encode("utf-8", "surrogatepass").split()) if text else 0


def sequence_cost(length: int) -> float:
    """Cost of a sequence of a permitted length, in tokens, however full it is."""
    return BIN_COST + length + length * length / ATTENTION


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost=sequence_cost) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each size, and the final length of each bin; ``sizes`` must descend.

    Bins of all lengths are opened jointly. Where one length for all bins comes out cheaper after downsizing
    (long pieces of much the same size), that is taken, so no single length is ever better.
    """
    lengths = sorted(lengths)
    plans = [lengths, *([c] for c in lengths if not len(sizes) or c >= sizes[0])]
    found = [_pack(sizes, opened, lengths, cost) for opened in plans]
    return min(found, key=lambda plan: sum(map(cost, plan[2])))


def _pack(sizes: Sequence[int], opened: list[int], lengths: list[int], cost) -> tuple[np.ndarray, np.ndarray, list[int]]:
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    used: list[int] = []
    size_of: list[int] = []
    room: list[tuple[int, int]] = []      # (room left, bin), sorted
    rising = -np.asarray(sizes, np.int64)
    after = np.concatenate([np.cumsum(-rising[::-1])[::-1], [0]])   # tokens from each place on

    def cost_per_token(at: int, length: int) -> tuple[float, int]:
        beside = length - sizes[at]
        come = after[max(at + 1, int(np.searchsorted(rising, -beside, "left")))]
        fill = sizes[at] + min(beside, int(come))
        return cost(lengths[bisect_left(lengths, fill)]) / fill, length

    for i, size in enumerate(sizes):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            b = room.pop(at)[1]
        else:
            b = len(used)
            used.append(0)
            size_of.append(min(cost_per_token(i, c) for c in opened if c >= size)[1])
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if used[b] < size_of[b]:
            insort(room, (size_of[b] - used[b], b))
    return bins, offsets, [lengths[bisect_left(lengths, u)] for u in used]


def pieces(docs: DataFrame, id_col: str, text_col: str, longest: int) -> DataFrame:
    """(doc_id, n_tokens, piece, start, length) of every row; piece -1 for a document without tokens."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([word_count(t) for t in texts_of(batch, "body")], pa.int64())],
                ["doc_id", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_tokens long")
    last = F.ceil(F.col("n_tokens") / F.lit(longest)).cast("int") - 1
    cut = counted.withColumn("piece", F.explode(F.when(F.col("n_tokens") > 0, F.sequence(F.lit(0), last))
                                                .otherwise(F.array(F.lit(-1)))))
    start = F.greatest(F.col("piece"), F.lit(0)).cast("long") * longest
    return cut.withColumn("start", start).withColumn("length", F.least(F.col("n_tokens") - F.col("start"), F.lit(longest)))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   lengths: Sequence[int] = LENGTHS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, bin_length, bin_offset): where each piece of each row goes."""
    found = pieces(docs, id_col, text_col, max(lengths)).withColumn("row", F.monotonically_increasing_id())
    found = materialize(found, "packing-pieces")
    real = found.where("piece >= 0")
    groups = max(1, -(-real.count() // group_pieces))
    grouped = real.select("doc_id", "piece", "start", "length", "row",
                          F.pmod(F.xxhash64("row"), F.lit(groups)).alias("pack_group"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        bins, offsets, final = pack(table["length"].to_pylist(), lengths)
        first = table["pack_group"][0].as_py() << 32
        return pa.table({"doc_id": table["doc_id"], "piece": table["piece"], "start": table["start"],
                         "n_tokens": table["length"], "bin_id": pa.array(bins + first),
                         "bin_length": pa.array(np.array(final, np.int32)[bins]), "bin_offset": pa.array(offsets)})

    kind = found.schema["doc_id"].dataType.simpleString()
    packed = grouped.groupBy("pack_group").applyInArrow(
        run, f"doc_id {kind}, piece int, start long, n_tokens long, bin_id long, bin_length int, bin_offset long")
    empty = found.where("piece < 0").select(
        "doc_id", F.lit(0).alias("piece"), "start", F.lit(0).cast("long").alias("n_tokens"),
        F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("bin_length"),
        F.lit(None).cast("long").alias("bin_offset"))
    return packed.unionByName(empty)
