"""Phrase collocations from count streams in prefix and suffix order.

Counts of all phrases of one to four words that occur often enough are kept as
a stream, as in external language-model estimation. Every phrase is cut after
each of its words. Sorted by the words before the cut (prefix order), the cuts
run in step with the counts and take over the count of their left part; sorted
by the words after it (suffix order), that of their right part: two merge
joins, no table of counts is held or hashed. The cuts before the last and after
the first word are also the extensions of a shorter phrase to the right and to
the left; their largest count is merged back into the stream.

Phrases below ``MIN_COUNT`` need not be counted exactly, and most phrases of a
corpus are that rare. They are left out length by length without ever
building a set of them in one place: tasks send the sorted hashes of the
phrases they hold to hash ranges (as many as the text is long), where they are
added up; each range marks the hashes that reach ``MIN_COUNT`` in its slice of
a bit map of 2^``FILTER_BITS`` bits in all, whatever the size of the corpus. A
phrase is only sent if the two shorter phrases in it were marked. A wrong mark
(two hashes on one bit) costs a row that is dropped by its exact count later;
a frequent phrase is always marked, so the result is exact. Phrases as words
are counted once, after the marks of the shorter lengths are known; the longest
have none of their own.

Words are split as the contract says: A-Z in lower case, pieces cut at
``[.,;:!?\\x0A-\\x0D]``, words at space and tab. Phrases stay within pieces.

Defined results: a null lang is ``und``; null, empty or blank texts have no
words; rows are counted as they come, also repeated ones or ones that share an
id; phrases are compared by their bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsight.llm._common import HashCache, mix64, release_shuffles, small_batches, texts_of
from cellsight.session import materialize

MIN_COUNT = 30
WORDS = 4                  # words of the longest phrase
SHARE = 80                 # per cent of a phrase's count that makes a longer one replace it
TOP = 2000                 # phrases of a language
SCALE = 2_000_000
FILTER_BITS = 26           # 2^26 bits (8 MB) mark the frequent phrases of one length
RANGE_BYTES = 32 << 20     # text whose phrases share a hash range
BATCH_BYTES = 4 << 20      # text whose phrases are sorted together in a task (one long text stays whole)
CACHED_WORDS = 200_000
_CUT = b"\xff"             # stands for a piece's end: no UTF-8 text holds this byte
_SEPARATORS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _CUT * 10)


def tokens_of(text: str | None) -> list[bytes]:
    """The words of a whole text and a ``_CUT`` after each piece."""
    low = (text or "").encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS)
    # What is left of white space is what separates words.
    return (low + _CUT).replace(_CUT, b" " + _CUT + b" ").split()


def _word_hash(word: bytes) -> int:
    return 0 if word == _CUT else xxhash.xxh3_64_intdigest(word) or 1


class _Words:
    """The words of a batch of (lang, text) rows, one after the other."""

    def __init__(self, batch: pa.RecordBatch, cache: HashCache):
        langs = texts_of(batch, "lang")
        self.langs = list(dict.fromkeys(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        self.tokens, sizes = [], []
        for text in texts_of(batch, "body"):
            found = tokens_of(text)
            self.tokens += found
            sizes.append(len(found))
        self.lang = np.repeat(np.fromiter((number[x] for x in langs), np.int64, len(langs)), sizes)
        self.hashes = cache.array(self.tokens)
        self.salt = cache.array([b"\xff" + x.encode("utf-8", "surrogatepass") for x in self.langs])[self.lang]

    def phrases(self, marks: dict[int, np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, whether one starts here, its hash) of phrases that are marked or, of lengths without
        marks, whose two shorter phrases are."""
        one = mix64(self.hashes + self.salt)
        h, here = one, self.hashes != 0
        for words in range(1, longest + 1):
            if words > 1:
                here = here[:-1] & here[1:]
                h = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[words - 1:])
            if words in marks:
                bit = h[here] >> np.uint64(64 - FILTER_BITS)
                here = here.copy()
                here[here] = marks[words][bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
            yield words, here, h


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("body"))


def hash_runs(rows: DataFrame, lengths: list[int], marks, range_bits: int) -> DataFrame:
    """(words, range, hashes, counts): each batch's phrases as sorted 32-bit hashes within their range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, known = HashCache(_word_hash, CACHED_WORDS), _received(marks)
        with np.errstate(over="ignore"):
            for batch in small_batches(batches, BATCH_BYTES):
                for words, here, h in _Words(batch, cache).phrases(known, max(lengths)):
                    if words not in lengths:
                        continue
                    found, counts = np.unique(h[here] >> np.uint64(32 - range_bits), return_counts=True)
                    low, counts = found.astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
                    ranges, first = np.unique(found >> np.uint64(32), return_index=True)
                    ends = [*first[1:], len(found)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words] * len(ranges), pa.int32()), pa.array(ranges.astype(np.int64)),
                         pa.array([low[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()),
                         pa.array([counts[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())],
                        ["words", "range", "hashes", "counts"])

    return rows.mapInArrow(run, "words int, range long, hashes binary, counts binary")


def mark_frequent(runs: DataFrame, range_bits: int, least: int) -> dict[int, np.ndarray]:
    """Per length the bit map of the hashes that occur ``least`` times."""
    size = 1 << (FILTER_BITS - range_bits)

    def merge(table: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("hashes")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("counts")])
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        often = hashes[first][np.add.reduceat(counts[order].astype(np.int64), first) >= least]
        bits = np.zeros(size, bool)
        bits[often >> np.uint32(32 - FILTER_BITS + range_bits)] = True
        return pa.table({"words": table.column("words").slice(0, 1), "range": table.column("range").slice(0, 1),
                         "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    found = runs.groupBy("words", "range").applyInArrow(merge, "words int, range long, bits binary")
    marks: dict[int, np.ndarray] = {}
    for r in found.toLocalIterator():  # 2^FILTER_BITS bits per length in all
        bits = marks.setdefault(r["words"], np.zeros((1 << FILTER_BITS) // 8, np.uint8))
        at = r["range"] * (size // 8)
        bits[at:at + size // 8] = np.frombuffer(r["bits"], np.uint8)
    return marks


def _sent(docs: DataFrame, marks: dict[int, np.ndarray]):
    """The bit maps, mostly zeros, packed for the tasks."""
    return docs.sparkSession.sparkContext.broadcast({n: zlib.compress(bits.tobytes(), 1) for n, bits in marks.items()})


def _received(marks) -> dict[int, np.ndarray]:
    return {n: np.frombuffer(zlib.decompress(bits), np.uint8) for n, bits in marks.value.items()}


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT,
                  longest: int = WORDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, words, phrase, f) of every phrase that occurs ``least`` times; words 0 has the number of all words."""
    rows = _texts(docs, lang_col, text_col)
    size = rows.select(F.sum(F.octet_length("body"))).first()[0] or 0
    # A bit map's slice has whole bytes, hence at most FILTER_BITS - 3.
    range_bits = min(FILTER_BITS - 3, max(2, math.ceil(math.log2(max(size / range_bytes, 1)))))
    marks: dict[int, np.ndarray] = {}
    for lengths in [[1, 2], *([n] for n in range(3, longest))]:
        shared = _sent(docs, marks)
        marks = marks | mark_frequent(hash_runs(rows, lengths, shared, range_bits), range_bits, least)
        shared.unpersist()
        release_shuffles(docs.sparkSession)
    none = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    shared = _sent(docs, {n: marks.get(n, none) for n in range(1, max(longest, 3))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, known = HashCache(_word_hash, CACHED_WORDS), _received(shared)
        with np.errstate(over="ignore"):
            for batch in small_batches(batches, BATCH_BYTES):
                words = _Words(batch, cache)
                number: dict = {}
                ids = np.fromiter((number.setdefault(t, len(number)) for t in words.tokens), np.int64, len(words.tokens))
                total = np.bincount(words.lang[words.hashes != 0], minlength=len(words.langs))
                yield _counted(words.langs, 0, [b""] * len(words.langs), total)
                for n, here, _ in words.phrases(known, longest):
                    at = np.flatnonzero(here)
                    key = words.lang[at]
                    for k in range(n):  # numbers of the phrases so far, extended by the next word's
                        key = np.unique(key * len(number) + ids[at + k], return_inverse=True)[1]
                    _, first, counts = np.unique(key, return_index=True, return_counts=True)
                    at = at[first]
                    yield _counted([words.langs[x] for x in words.lang[at]], n,
                                   [b" ".join(words.tokens[a:a + n]) for a in at.tolist()], counts)

    runs = rows.mapInArrow(run, "lang string, words int, phrase string, c long")
    counts = runs.groupBy("lang", "words", "phrase").agg(F.sum("c").alias("f"))
    counts = materialize(counts.where((F.col("f") >= least) | (F.col("words") == 0)), "phrase-counts")
    shared.unpersist()
    release_shuffles(docs.sparkSession)
    return counts


def _counted(langs: list[str], words: int, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array([words] * len(phrases), pa.int32()), pa.array(phrases, pa.string()),
         pa.array(counts.astype(np.int64))], ["lang", "words", "phrase", "c"])


def candidates(counts: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, score, replaced) of every phrase of two words or more in ``counts``.

    A longer phrase that replaces one by ``share`` has a count above it, and so has every phrase between
    the two: it is enough to look at extensions by one word.
    """
    counts = counts.where("words > 0")
    cut = (counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
           .withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)")))
    cut = materialize(cut, "phrase-cuts")
    prefixes = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    suffixes = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    held = cut.hint("merge").join(prefixes, ["lang", "left"]).hint("merge").join(suffixes, ["lang", "right"])
    # Decimals: products may pass 64 bits.
    score = F.expr(f"(cast({SCALE} as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    lowest = held.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    longer = (cut.where("k = words - 1").select("lang", F.col("left").alias("phrase"), "a")
              .unionByName(cut.where("k = 1").select("lang", F.col("right").alias("phrase"), "a"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("most")))
    replaced = F.expr(f"100 * cast(most as decimal(19, 0)) >= {share} * cast(a as decimal(19, 0))")
    return lowest.hint("merge").join(longer, ["lang", "phrase"], "left").select(
        "lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("m.score").alias("score"),
        F.coalesce(replaced, F.lit(False)).alias("replaced"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP, share: int = SHARE,
                 **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases."""
    counts = phrase_counts(docs, lang_col, text_col, **options)
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = candidates(counts, share).where(~F.col("replaced")).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
