"""Near-duplicate documents by SimHash fingerprints and deletion-variant signatures.

A document's word shingles, repeats included, are hashed with XXH64 (seed 42,
which is also Spark's ``xxhash64`` of the same text); a bit of the 64-bit
fingerprint is set if it is set in more than half of the hashes.

Two fingerprints that differ in at most two bits differ in at most one bit in
one of two segments of 32 bits. So every distinct fingerprint is indexed, per
segment, under the whole segment and under the segment with each one bit made
a wildcard. Fingerprints with an equal segment meet under the first key; those
whose segment differs in one bit meet under exactly one wildcard key, where
only members with that bit clear are paired with members that have it set.
Every pair is verified on all 64 bits.

A key that very many fingerprints share would make pairs with the square of
their number. Members of keys above ``CROWD`` are linked another, equally
exact way: each is listed under itself and its 64 one-bit neighbours. Two
fingerprints within two bits have such a neighbour in common, a list holds at
most 65 fingerprints, and all of a list are within two bits of each other, so
a star per list keeps every component.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other; fewer words than a shingle are one shingle; every row
has its own fingerprint, also rows that share an id; ids may be of any type
that has an order; null ids are ignored when a component's smallest id is
taken, which is null only if all its ids are; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cellsight.llm._common import release_shuffles, small_batches, texts_of
from cellsight.llm.near_dedup import components
from cellsight.session import materialize

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2               # differing bits of linked fingerprints
SEGMENT_BITS = 32          # two segments: at most one bit differs in one of them
CROWD = 64                 # fingerprints under a key that are still paired directly
_CHUNK = 1 << 18           # shingles whose bits are counted at a time


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The whole text's 64-bit SimHash, unsigned."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    n = min(words, len(tokens))
    stops = ends[n - 1:].tolist()
    starts = np.concatenate([[0], ends[:len(tokens) - n] + 1]).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(stops), _CHUNK):
        spans = zip(starts[at:at + _CHUNK], stops[at:at + _CHUNK], strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(stops), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc, fp) of every row; the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = np.array([fingerprint(t, words) for t in texts_of(batch, "body")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc", "fp"])

    schema = StructType([StructField("doc", docs.schema[id_col].dataType), StructField("fp", LongType())])
    return rows.mapInArrow(run, schema)


def variants(distinct: DataFrame) -> DataFrame:
    """(key, bit, fp): each segment whole (bit null) and with each of its bits as a wildcard.

    A key holds the segment's number, the wildcard's place and the other bits;
    ``bit`` is what stands under the wildcard.
    """
    def of(segment: int):
        part = F.shiftrightunsigned("fp", segment * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
        # 6 bits for the place (32: none) and one for the segment stand above the 32 of the segment.
        head = segment << 6

        def wild(place):
            mask = F.expr("shiftleft(1L, place)")
            return F.struct(
                (part.bitwiseAND(F.bitwise_not(mask)) + (place + F.lit(head)).cast("long") * F.lit(1 << SEGMENT_BITS)).alias("key"),
                (part.bitwiseAND(mask) != 0).alias("bit"))
        return part, head, wild

    out = None
    for segment in (0, 1):
        part, head, wild = of(segment)
        whole = distinct.select((part + F.lit((head + SEGMENT_BITS) << SEGMENT_BITS)).alias("key"),
                                F.lit(None).cast("boolean").alias("bit"), "fp")
        places = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1))).alias("place"))
        some = places.select(wild(F.col("place")).alias("v"), "fp").select("v.key", "v.bit", "fp")
        out = whole.unionByName(some) if out is None else out.unionByName(whole).unionByName(some)
    return out


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints within ``MAX_BITS``: every such pair under keys of
    at most ``crowd`` fingerprints, and stars that connect the same components under the others."""
    index = variants(distinct)
    keys = (index.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("bit").alias("low"), F.max("bit").alias("high"))
            .where((F.col("size") > 1) & F.coalesce(F.col("low") != F.col("high"), F.lit(True)))
            .select("key", (F.col("size") > crowd).alias("crowded")))
    keys = materialize(keys, "simhash-keys")
    members = materialize(index.join(keys, "key"), "simhash-members")
    release_shuffles(distinct.sparkSession)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    few = members.where(~F.col("crowded"))
    a, b = (few.select("key", F.col("bit").alias(f"{x}_bit"), F.col("fp").alias(x)) for x in "ab")
    apart = F.when(F.col("a_bit").isNull(), F.col("a") < F.col("b")).otherwise(F.col("a_bit") < F.col("b_bit"))
    pairs = a.join(b, "key").where(apart & near).select("a", "b")
    return materialize(pairs.unionByName(_stars(members.where("crowded").select("fp").distinct())), "simhash-links")


def _stars(many: DataFrame) -> DataFrame:
    """Edges to the smallest of all fingerprints that share a fingerprint at most one bit away."""
    at = F.explode(F.sequence(F.lit(0), F.lit(64))).alias("place")
    listed = many.select("fp", at).select(
        "fp", F.when(F.col("place") == 64, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, place % 64)"))).alias("ball"))
    centres = listed.groupBy("ball").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top").select("ball", "a")
    return listed.join(centres, "ball").where("fp <> a").select("a", F.col("fp").alias("b"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
            crowd: int = CROWD) -> DataFrame:
    """(doc, fp, component) of every row: the smallest id among the documents its fingerprint reaches."""
    rows = materialize(fingerprints(docs, id_col, text_col, words), "simhash-prints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc").alias("first")), "simhash-distinct")
    labels = components(links(distinct.select("fp"), crowd))
    comps = distinct.withColumn("label", F.col("fp")) if labels is None else (
        distinct.join(labels.withColumnRenamed("v", "fp"), "fp", "left")
        .select("fp", "first", F.coalesce("label", "fp").alias("label")))
    heads = comps.groupBy("label").agg(F.min("first").alias("component"))
    comps = materialize(comps.join(heads, "label").select("fp", "component"), "simhash-comps")
    release_shuffles(docs.sparkSession)
    return rows.join(comps, "fp").select("doc", "fp", "component")


def components_by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the fingerprint as 16 lowercase hex digits."""
    found = classes(docs, id_col, text_col, **options)
    return found.select(F.col("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))
