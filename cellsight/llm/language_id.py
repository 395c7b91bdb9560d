"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (of 1 to 3
characters, "blended spectrum") present in both, over the root of the product
of their numbers of n-grams. A Nyström map with m landmark texts turns it
into m features, on which one-versus-rest kernel ridge regression is solved
in closed form. Scoring is batched: an (rows x n-grams) presence matrix times
the landmarks' presence matrix, times one (m x languages) weight matrix.

Learned from a bounded, hash-picked sample of the labelled training rows,
split evenly over the languages; every whole text is predicted.

Defined results: a null text, or one without a letter, is ``und`` with score
0.0; ties go to the first language in sort order; without any training row
every text is ``und``; repeated rows get equal results; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.llm._common import fold, mix64, small_batches, texts_of

ORDERS = (1, 2, 3)
DIMENSIONS = 1 << 15       # hashed n-grams; presence of each is one bit
TRAIN_SAMPLE = 4_000       # at most about this many training rows, all languages together
LANDMARKS = 400            # of them, this many serve as landmarks
RIDGE = 1e-2
UNDETERMINED = "und"

_LETTERS: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Code point -> its lower-cased letter, or a space for whatever is no letter (built once per worker)."""
    global _LETTERS
    if _LETTERS is None:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _LETTERS = table
    return _LETTERS


def presence(text: str | None, dims: int = DIMENSIONS) -> np.ndarray | None:
    """Sorted hashed n-grams present in the text; None if it has no letter."""
    if not text:
        return None
    c = _letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letters = c != 32
    if not letters.any():
        return None
    # Runs of anything else count as one space; a space stands at both ends.
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint64)
    seen = np.zeros(dims, bool)
    for n in ORDERS:
        h = np.full(max(0, len(c) - n + 1), n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + c[k:len(c) - n + 1 + k]
            seen[(mix64(h) % np.uint64(dims)).astype(np.int64)] = True
    return np.flatnonzero(seen)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    columns: np.ndarray     # n-gram -> column of ``landmarks``, -1 where no landmark has it
    landmarks: np.ndarray   # landmarks x used n-grams, 0/1
    sizes: np.ndarray       # n-grams of each landmark
    weights: np.ndarray     # (landmarks + 1) x languages; the last row is the constant

    def decide(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of class scores for each n-gram set."""
        return np.hstack([self._kernel(sets), np.ones((len(sets), 1))]) @ self.weights

    def _kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        return _kernel(sets, self.columns, self.landmarks, self.sizes)


def _kernel(sets, columns, landmarks, sizes, rows: int = 128) -> np.ndarray:
    out = np.empty((len(sets), len(sizes)))
    for at in range(0, len(sets), rows):
        part = sets[at:at + rows]
        x = np.zeros((len(part), landmarks.shape[1]), np.float32)
        for i, s in enumerate(part):
            cols = columns[s]
            x[i, cols[cols >= 0]] = 1
        norm = np.sqrt(np.outer([len(s) for s in part], sizes))
        out[at:at + rows] = (x @ landmarks.T) / norm
    return out


def solve(sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE,
          dims: int = DIMENSIONS) -> LanguageModel | None:
    """Nyström features and one-versus-rest ridge regression on the sample."""
    if not sets:
        return None
    names = sorted(set(langs))
    # Landmarks are taken evenly from the languages, in sample order.
    turn, nth = {name: 0 for name in names}, []
    for lang in langs:
        nth.append(turn[lang])
        turn[lang] += 1
    chosen = sorted(range(len(sets)), key=lambda i: (nth[i], i))[:landmarks]
    used = np.unique(np.concatenate([sets[i] for i in chosen]))
    columns = np.full(dims, -1, np.int64)
    columns[used] = np.arange(len(used))
    z = np.zeros((len(chosen), len(used)), np.float32)
    for row, i in enumerate(chosen):
        z[row, columns[sets[i]]] = 1
    sizes = z.sum(axis=1).astype(np.float64)
    values, vectors = np.linalg.eigh(_kernel([sets[i] for i in chosen], columns, z, sizes))
    good = values > 1e-8 * max(values.max(), 1.0)
    root = vectors[:, good] / np.sqrt(values[good])          # K_mm^(-1/2), without its null space
    phi = np.hstack([_kernel(sets, columns, z, sizes) @ root, np.ones((len(sets), 1))])
    y = np.array([[1.0 if lang == name else -1.0 for name in names] for lang in langs])
    # Every language counts alike, however many sample rows it has.
    w = np.array([len(sets) / (len(names) * turn[lang]) for lang in langs])[:, None]
    beta = np.linalg.solve(phi.T @ (w * phi) + ridge * np.eye(phi.shape[1]), phi.T @ (w * y))
    return LanguageModel(names, columns, z, sizes, np.vstack([root @ beta[:-1], beta[-1:]]))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample: int = TRAIN_SAMPLE, test_fold: int = 0) -> LanguageModel | None:
    """Learn from the rows outside the held-out fold; the n-gram sets of the sample (bounded) reach the driver."""
    rows = (docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col) != test_fold))
            .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("body"),
                    F.xxhash64(F.col(id_col).cast("string")).alias("pick")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sample / max(1, len(sizes))
    picked = F.lit(False)
    for lang, n in sorted(sizes.items()):
        bound = int((1 << 30) * min(1.0, share / n))
        picked = picked | ((F.col("lang") == F.lit(lang)) & (F.pmod("pick", F.lit(1 << 30)) < bound))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [presence(t) for t in texts_of(batch, "body")]
            has = pa.array([f is not None for f in found])
            bits = [None if f is None else np.packbits(np.isin(np.arange(DIMENSIONS), f)).tobytes() for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("lang")),
                 batch.column(batch.schema.get_field_index("pick")), pa.array(bits, pa.binary())],
                ["lang", "pick", "bits"]).filter(has)

    found = rows.where(picked).mapInArrow(sets, "lang string, pick long, bits binary").collect()
    found.sort(key=lambda r: (r["pick"], r["lang"], bytes(r["bits"])))
    unpacked = [np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8))) for r in found]
    return solve(unpacked, [r["lang"] for r in found])


def _predict(texts: list, model: LanguageModel | None) -> tuple[list[str], np.ndarray]:
    sets = [presence(t) if model else None for t in texts]
    known = [i for i, s in enumerate(sets) if s is not None]
    langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if known:
        margin = model.decide([sets[i] for i in known])
        # Class scores are about +1 and -1; a logistic curve turns them into shares.
        e = np.exp(4 * (margin - margin.max(axis=1, keepdims=True)))
        share = e / e.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        scores[known] = share[np.arange(len(known)), best]
        for i, b in zip(known, best, strict=True):
            langs[i] = model.languages[b]
    return langs, scores


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text",
             test_fold: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == test_fold).alias("held_out"),
                       F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            langs, scores = _predict(texts_of(batch, "body"), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()),
                                              pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel | None, min_score: float = 0.4,
                    text_col: str = "text") -> DataFrame:
    """The rows whose language is determined with at least ``min_score``, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            langs, scores = _predict(texts_of(batch, text_col), model)
            yield batch.filter(pa.array([a != UNDETERMINED and s >= min_score
                                         for a, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
