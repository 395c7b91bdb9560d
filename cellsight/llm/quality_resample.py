"""Quality classifier by importance resampling (hashed n-gram generative models).

Two bag-of-n-gram models over the same hashed buckets are fitted: one on the
target (labelled good documents, a bounded documented sample) and one on the
raw corpus (every document). A document's log importance weight is the sum
over its unigrams and bigrams of log(p_target / p_raw). The documents kept
are the Gumbel top-k of the weights: the k largest of weight + Gumbel noise,
which samples k documents without replacement in proportion to their weight.

``k`` is the number of documents whose weight per n-gram exceeds the cut that
best separates the two label values on the labelled sample.

Defined results: null or empty text has no n-grams, weight 0.0; a null id
draws the noise of the empty text; repeated rows get equal scores and are
kept or dropped together (ties at the k-th score are all kept); with no
target document or no rejected label the cut is 0.0; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.llm._common import HashCache, mix64, small_batches, texts_of
from cellsight.session import materialize

BUCKETS = 1 << 16          # hashed n-gram buckets
LABEL_SAMPLE = 20_000      # at most about this many labelled rows of each class are learned from
SMOOTHING = 0.5            # added to every bucket of both models
NOISE_SCALE = 1.0          # scale of the Gumbel noise

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SAME = np.uint64(0x5BD1E995)  # bigram of a token that repeats the one before it


@dataclass(frozen=True)
class ResamplingModel:
    """Log ratios of the two models per bucket, and the cut on the mean log ratio."""

    log_ratio: np.ndarray
    cut: float

    @property
    def buckets(self) -> int:
        return len(self.log_ratio)


def _token_hash(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) * 0x9E3779B1 & 0xFFFFFFFFFFFFFFFF


def ngram_buckets(text: str | None, cache: HashCache, buckets: int) -> np.ndarray:
    """Bucket of every unigram and bigram of one whole text."""
    h = cache.array(_TOKEN.findall(text.lower())) if text else np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        pairs[h[:-1] == h[1:]] = _SAME
        return (mix64(np.concatenate([h, pairs])) % np.uint64(buckets)).astype(np.int64)


def _sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` rows of each class, picked by a hash of the id (all, when there are fewer)."""
    sizes = {r["good"]: r["n"] for r in labelled.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.lit(False)
    for good, n in sizes.items():
        keep = F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n))
        parts = parts | ((F.col("good") == F.lit(good)) & keep)
    return labelled.where(parts)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        buckets: int = BUCKETS, sample: int = LABEL_SAMPLE) -> ResamplingModel:
    """Count hashed n-grams of the target sample and of all documents, and calibrate the cut.

    ``labels`` holds (doc_id, quality); quality 1 is the target. One aggregate
    of at most ``buckets`` rows reaches the driver.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
             .groupBy(F.col("doc_id").alias("label_id")).agg((F.min("quality") > 0).alias("good")))
    # Bounded by 2 * sample rows, so it may be sent to every executor.
    known = F.broadcast(materialize(_sampled(known, sample), "quality-labels"))
    rows = (docs.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("body"))
            .join(known, F.col("doc_key") == F.col("label_id"), "left").select("body", "good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, total = HashCache(_token_hash), np.zeros((2, buckets), np.int64)
        for batch in small_batches(batches, 2 << 20):
            grams = [ngram_buckets(t, cache, buckets) for t in texts_of(batch, "body")]
            target = [g for g, good in zip(grams, texts_of(batch, "good"), strict=True) if good]
            for k, part in ((0, grams), (1, target)):
                if part:
                    total[k] += np.bincount(np.concatenate(part), minlength=buckets)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32), "raw": total[0][used],
                                          "target": total[1][used]})

    sums = (rows.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket")
            .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect())
    counts = np.zeros((2, buckets))
    for r in sums:
        counts[:, r["bucket"]] = r["raw"], r["target"]
    p = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * buckets)
    ratio = np.log(p[1] / p[0]) if counts[1].any() else np.zeros(buckets)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache(_token_hash)
        for batch in small_batches(batches):
            means = [_weight(t, cache, ratio)[1] for t in texts_of(batch, "body")]
            yield pa.RecordBatch.from_pydict({"mean": pa.array(means, pa.float64()),
                                              "good": pa.array(texts_of(batch, "good"), pa.bool_())})

    seen = rows.where(F.col("good").isNotNull()).mapInArrow(weigh, "mean double, good boolean")
    # A histogram of fixed size instead of the documents' own weights.
    bins = (seen.groupBy(F.floor(F.least(F.greatest(F.col("mean"), F.lit(-8.0)), F.lit(8.0)) * 200).alias("bin"))
            .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect())
    return ResamplingModel(ratio, _best_cut(sorted((r["bin"], r["good"], r["bad"]) for r in bins)))


def _best_cut(bins: list[tuple[int, int, int]]) -> float:
    """The cut with the largest difference of the two classes' rates above it.

    Between two bins no document lies, so every cut there is equally good:
    the middle is taken.
    """
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not good or not bad:
        return 0.0
    below_good = below_bad = 0
    best, cut, last = -2.0, 0.0, bins[0][0]
    for b, g, x in bins:
        gain = below_bad / bad - below_good / good
        if gain > best + 1e-12:
            best, cut = gain, (last + b) / 2
        below_good, below_bad, last = below_good + g, below_bad + x, b + 1
    return cut / 200


def _weight(text: str | None, cache: HashCache, ratio: np.ndarray) -> tuple[float, float]:
    b = ngram_buckets(text, cache, len(ratio))
    total = float(ratio[b].sum())
    return total, total / len(b) if len(b) else 0.0


def _gumbel(ids: pa.Array, seed: int, scale: float) -> np.ndarray:
    """Gumbel noise drawn from a hash of the id, so that a retried task draws the same."""
    keys = np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids.to_pylist()], np.uint64)
    with np.errstate(over="ignore"):
        h = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return -np.log(-np.log(u)) * scale


def _scores(batch: pa.RecordBatch, id_col: str, text_col: str, model: ResamplingModel, cache: HashCache,
            seed: int, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of n-grams, weight counted from the cut, and weight plus noise, of each row."""
    grams = [ngram_buckets(t, cache, model.buckets) for t in texts_of(batch, text_col)]
    n = np.array([len(g) for g in grams], np.int64)
    weight = np.array([model.log_ratio[g].sum() for g in grams], np.float64) - model.cut * n
    noise = _gumbel(batch.column(batch.schema.get_field_index(id_col)), seed, scale)
    return n, weight, weight + noise


def score(docs: DataFrame, model: ResamplingModel, id_col: str = "doc_id", text_col: str = "text",
          seed: int = 1, scale: float = NOISE_SCALE) -> DataFrame:
    """(doc_id, n_ngrams, log_weight, score, key) of every row; ``key`` sorts like ``score``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache(_token_hash)
        for batch in small_batches(batches):
            n, weight, noisy = _scores(batch, "doc_id", "body", model, cache, seed, scale)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(weight), pa.array(noisy), pa.array(double_to_key(noisy))],
                ["doc_id", "n_ngrams", "log_weight", "score", "key"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_ngrams long, log_weight double, score double, key long")


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             seed: int = 1) -> tuple[DataFrame, ResamplingModel, float | None]:
    """Scores with ``kept``, the model, and the k-th largest score (None: nothing is kept)."""
    model = fit(docs, labels, id_col, text_col)
    scored = materialize(score(docs, model, id_col, text_col, seed), "quality-scores")
    k = scored.where(F.col("log_weight") >= 0).count()
    kth = kth_largest(scored, k)
    kept = F.lit(False) if kth is None else F.col("score") >= F.lit(kth)
    return scored.drop("key").withColumn("kept", kept), model, kth


def keep_resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   seed: int = 1) -> DataFrame:
    """The rows of ``docs`` that the resampling keeps, with all their columns.

    The text is scored again instead of being joined with the stored scores:
    scores are a function of the row, and the text need not be shuffled.
    """
    _, model, kth = resample(docs, labels, id_col, text_col, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache(_token_hash)
        for batch in small_batches(batches):
            if kth is not None:
                *_, noisy = _scores(batch, id_col, text_col, model, cache, seed, NOISE_SCALE)
                yield batch.filter(pa.array(noisy >= kth))

    return docs.mapInArrow(run, docs.schema)


def kth_largest(scored: DataFrame, k: int) -> float | None:
    """The k-th largest score, found by counting 16 bits of ``key`` at a time.

    Four aggregates of at most 65,536 rows each; no sort and no window over
    the whole table.
    """
    if k < 1:
        return None
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        rows = scored if shift == 48 else scored.where(F.shiftrightunsigned("key", shift + 16) == prefix)
        digits = (rows.groupBy(F.shiftrightunsigned("key", shift).bitwiseAND(0xFFFF).alias("digit"))
                  .agg(F.count(F.lit(1)).alias("n")).collect())
        for r in sorted(digits, key=lambda r: -r["digit"]):
            if left <= r["n"]:
                prefix = (prefix << 16) | r["digit"]
                break
            left -= r["n"]
        else:
            return None
    return key_to_double(prefix)


def double_to_key(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys (as int64 bit patterns) in the order of the doubles."""
    b = (np.asarray(x, np.float64) + 0.0).view(np.uint64)
    neg = (b >> np.uint64(63)).astype(bool)
    return np.where(neg, ~b, b | np.uint64(1 << 63)).view(np.int64)


def key_to_double(key: int) -> float:
    b = np.array([key], np.uint64)
    b = np.where(b >> np.uint64(63) == 1, b & np.uint64((1 << 63) - 1), ~b)
    return float(b.view(np.float64)[0])
