"""Near-duplicate documents by one-permutation MinHash.

Each document's word shingles are hashed once; the hash space is cut into
``BINS`` bins and the smallest value of each bin is its entry (empty bins
borrow from a bin picked by an own hash: optimal densification). Bins are
read in bands; documents alike in a band share a bucket.

Documents with equal shingle sets are one class from the start. In every
bucket one member is the centre and only the edges of that star are
candidates, so their number stays below buckets times members. Star rounds
with other centres follow for buckets that still hold several components;
what is then left is compared across components only, in packed chunks. Every candidate is
confirmed on the full shingle sets, and components follow by spreading the
smallest label.

Defined results: a document without words (null or blank text) has an empty
set, no link, and is kept; fewer words than a shingle count as one shingle;
a null id sorts last; rows with a null or shared id are one document only if
their sets are equal, and all others are compared on their own; a component
goes by its smallest id, and its first document (by id, then fingerprint) is
kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.llm._common import HashCache, arrow_rows, fresh, mix64, release_shuffles, small_batches, texts_of
from cellsight.session import materialize

SHINGLE_WORDS = 2
BANDS = 40                 # buckets of a document
ROWS = 6                   # bins that must agree in a bucket
PERCENT = 80               # least intersection in per cent of the union
STAR_ROUNDS = 2
PACK_TOKENS = 40_000       # shingles of the documents that are compared together
NULL_ID = (1 << 63) - 1

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shingles(text: str | None, cache: HashCache, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word shingles."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    h = cache.array(tokens)
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k])
    return np.unique(out)


class OnePermutation:
    """Densified one-permutation signatures, as one hash per band."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each bin; ``hashes`` ascend, so the first of a bin is its smallest."""
        h = np.sort(mix64(hashes + np.uint64(0x632BE59BD9B4E019)))
        # The high 32 bits pick the bin, so that a bin's values stand together.
        bin_of = ((h >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        filled, first = np.unique(bin_of, return_index=True)
        sig = np.zeros(self.bins, np.uint64)
        sig[filled] = h[first]
        full = np.zeros(self.bins, bool)
        full[filled] = True
        empty, attempt = np.flatnonzero(~full), 0
        while len(empty):
            attempt += 1
            with np.errstate(over="ignore"):
                pick = mix64(empty.astype(np.uint64) * np.uint64(1 << 32) + np.uint64(attempt)) % np.uint64(self.bins)
            hit = full[pick.astype(np.int64)]
            sig[empty[hit]] = sig[pick[hit].astype(np.int64)]
            empty = empty[~hit]
        return sig

    def band_hashes(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            s = self.signature(hashes).reshape(self.bands, self.rows)
            out = np.arange(self.bands, dtype=np.uint64)
            for k in range(self.rows):
                out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + s[:, k])
        return out.view(np.int64)


def _keyed(id_col: str, text_col: str) -> tuple:
    """Columns doc (the id) and print (of the text), which tell apart texts under a null or shared id."""
    return (F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"),
            F.xxhash64(F.col(text_col)).alias("print"))


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc, print, n, f1, f2, bands): set size, 128-bit fingerprint of the set, and band hashes of every row."""
    rows = docs.select(*_keyed(id_col, text_col), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, oph = HashCache(_word_hash), OnePermutation()
        for batch in small_batches(batches):
            sets = [shingles(t, cache, words) for t in texts_of(batch, "body")]
            prints = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]),
                 pa.array(prints[:, 1]),
                 pa.array([oph.band_hashes(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                ["doc", "print", "n", "f1", "f2", "bands"])

    return rows.mapInArrow(run, "doc long, print long, n long, f1 long, f2 long, bands array<long>")


def _full_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, hashes): full shingle sets of the documents in ``wanted`` (rep, doc, print, f1); the texts move once."""
    rows = docs.select(*_keyed(id_col, text_col), F.col(text_col).alias("body"))
    rows = rows.hint("merge").join(wanted, ["doc", "print"]).select("rep", "body", "f1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = HashCache(_word_hash)
        for batch in small_batches(batches):
            sets = [shingles(t, cache, words) for t in texts_of(batch, "body")]
            prints = [int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0]) for s in sets]
            # Texts sharing an id and a print: the one whose set is the class's own.
            own = pa.array([a == b for a, b in zip(prints, texts_of(batch, "f1"), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("rep")), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["rep", "hashes"]).filter(own)

    with arrow_rows(docs.sparkSession, 1000):
        return materialize(rows.mapInArrow(run, "rep long, hashes binary").dropDuplicates(["rep"]), "near-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("a_set"))
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("b_set"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame | None:
    """(v, label): the smallest vertex reachable, for every vertex of (a, b); None without edges.

    Every round each vertex takes the smallest label among its neighbours'
    and its own, then its label's label, until nothing changes. A vertex of
    many edges only ever receives a minimum, which is pre-aggregated, and the
    edges it sends along are rows of a join that may be split.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    both = materialize(both, "near-edges")
    labels = materialize(both.groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("m"))
                         .select("v", F.least("v", "m").alias("label")), "near-labels")
    if labels.isEmpty():
        return None
    while True:
        heard = both.join(labels.withColumnRenamed("v", "dst"), "dst").select(F.col("src").alias("v"), "label", F.lit(None).cast("long").alias("own"))
        told = (heard.unionByName(labels.select("v", "label", F.col("label").alias("own"))).groupBy("v")
                .agg(F.max("own").alias("label"), F.min("label").alias("next")))
        step = labels.select(F.col("v").alias("next"), F.col("label").alias("jump"))
        new = materialize(told.join(step, "next", "left").select(
            "v", F.least("next", "jump").alias("label"), (F.least("next", "jump") < F.col("label")).alias("moved")), "near-labels")
        labels = new.select("v", "label")
        if new.where("moved").isEmpty():
            return labels


def _relabel(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Join the components of ``comps`` (rep, comp) that ``links`` (a, b) connect."""
    ends = (links.join(comps.select(F.col("rep").alias("a"), F.col("comp").alias("ca")), "a")
            .join(comps.select(F.col("rep").alias("b"), F.col("comp").alias("cb")), "b")
            .where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    labels = components(ends)
    if labels is None:
        return comps
    moved = comps.join(labels.withColumnRenamed("v", "comp"), "comp", "left")
    return materialize(moved.select("rep", "n", F.coalesce("label", "comp").alias("comp")), "near-comps")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
            percent: int = PERCENT, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """(doc, print, f1, f2, n_shingles, component, first) of every row: the smallest id of its component, and whether
    the row is the component's first document; ids as long, null ids as the largest."""
    sketches = materialize(sketch(docs, id_col, text_col, words), "near-sketches")
    # Equal sets are one class, represented by its first document and numbered on its own: ids may be shared.
    reps = (sketches.where("n > 0").groupBy("f1", "f2")
            .agg(F.min(F.struct("doc", "print")).alias("d"), F.first("n").alias("n"), F.first("bands").alias("bands"))
            .select(F.monotonically_increasing_id().alias("rep"), "f1", "f2", "d.doc", "d.print", "n", "bands"))
    reps = materialize(reps, "near-reps")
    members = reps.select("rep", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = members.groupBy("band", "bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    members = materialize(members.join(materialize(shared.select("band", "bucket"), "near-buckets"), ["band", "bucket"]),
                          "near-members")
    release_shuffles(docs.sparkSession)
    comps = reps.select("rep", "n", F.col("rep").alias("comp"))
    wanted = members.select("rep").distinct().join(reps.select("rep", "doc", "print", "f1"), "rep")
    sets = _full_sets(docs, id_col, text_col, wanted, words)
    release_shuffles(docs.sparkSession)
    tried = None
    for turn in range(star_rounds):
        open_ = members.withColumn("comp", F.col("rep")) if turn == 0 else _mixed(members, comps)
        small, large = F.least("na", "nb"), F.greatest("na", "nb")
        pairs = (_star(open_, turn).where((F.col("ca") != F.col("cb")) & (100 * small >= percent * large))
                 .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "near-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        with arrow_rows(docs.sparkSession, 500):
            links = materialize(_confirmed(pairs, sets, percent), "near-links")
        comps = _relabel(comps, links)
        release_shuffles(docs.sparkSession)
    comps = _relabel(comps, _across(_mixed(members, comps), sets, percent))
    release_shuffles(docs.sparkSession)
    by_set = materialize(reps.select("f1", "f2", "rep", "doc").join(comps.select("rep", "comp"), "rep"), "near-labelled")
    heads = by_set.groupBy("comp").agg(F.min(F.struct("doc", "f1", "f2")).alias("h"))
    by_set = materialize(by_set.join(heads, "comp").select("f1", "f2", "h"), "near-classes")
    out = sketches.select("doc", "print", "n", "f1", "f2").join(by_set, ["f1", "f2"], "left")
    return materialize(out.select(
        "doc", "print", "f1", "f2", F.col("n").alias("n_shingles"), F.coalesce("h.doc", "doc").alias("component"),
        F.coalesce(F.struct("doc", "f1", "f2") == F.col("h"), F.lit(True)).alias("first")), "near-found")


def _mixed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members with their component, of the buckets that hold more than one."""
    labelled = materialize(members.join(comps.select("rep", "comp"), "rep"), "near-labelled")
    mixed = (labelled.groupBy("band", "bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
             .where("low < high").select("band", "bucket"))
    return materialize(labelled.join(materialize(mixed, "near-mixed"), ["band", "bucket"]), "near-open")


def _star(open_: DataFrame, turn: int) -> DataFrame:
    """Edges of every member to its bucket's centre: the smallest id, later the smallest hash of the round."""
    by = F.struct((F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))).alias("first"), "rep", "n", "comp")
    centres = open_.groupBy("band", "bucket").agg(F.min(by).alias("c"))
    centres = materialize(centres.select("band", "bucket", F.col("c.rep").alias("b"), F.col("c.n").alias("nb"),
                                         F.col("c.comp").alias("cb")), "near-centres")
    spokes = open_.select("band", "bucket", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    return spokes.join(centres, ["band", "bucket"])


def _across(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that the stars left: between members outside a bucket's largest component and all other members.

    Members and their sets are packed into chunks of bounded size, a large
    bucket into many; a pair of chunks is one row, and only links come out.
    """
    sizes = open_.groupBy("band", "bucket", "comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens"))
    main = sizes.groupBy("band", "bucket").agg(F.max(F.struct("size", "comp")).alias("m"), F.sum("tokens").alias("tokens"))
    main = materialize(main.select("band", "bucket", F.col("m.comp").alias("main"),
                                   F.ceil(F.col("tokens") / F.lit(PACK_TOKENS)).alias("chunks")), "near-main")
    placed = materialize(open_.join(main, ["band", "bucket"]), "near-placed").join(sets, "rep")
    packed = (placed.groupBy("band", "bucket", F.pmod(F.xxhash64("rep"), "chunks").alias("chunk"))
              .agg(F.collect_list(F.struct("rep", "comp", "hashes", (F.col("comp") != F.col("main")).alias("rest"))).alias("all")))
    packed = materialize(packed, "near-packed")
    release_shuffles(open_.sparkSession)
    rest = packed.select("band", "bucket", F.filter("all", lambda x: x["rest"]).alias("some")).where(F.size("some") > 0)
    rows = rest.join(packed.select("band", "bucket", "all"), ["band", "bucket"]).select("some", "all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                some, every = batch.column(0).slice(row, 1).flatten(), batch.column(1).slice(row, 1).flatten()
                a, b = _links(_unpacked(some), _unpacked(every), percent)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    with arrow_rows(open_.sparkSession, 4):
        return materialize(rows.mapInArrow(run, "a long, b long"), "near-links")


def _unpacked(members: pa.StructArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    return (members.field("rep").to_numpy(), members.field("comp").to_numpy(),
            [np.frombuffer(x, np.uint64) for x in members.field("hashes").to_pylist()])


def _links(some: tuple, every: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed links of the first to the second members; one for each component reached."""
    rep, comp, sets = some
    rep2, comp2, sets2 = every
    size, size2 = (np.array([len(x) for x in y], np.int64) for y in (sets, sets2))
    # Tokens that only one side has cannot be common.
    tokens = np.intersect1d(np.concatenate(sets), np.concatenate(sets2))
    common = np.zeros((len(sets), len(sets2)), np.float32)
    for at in range(0, len(tokens), 4096):  # in bands of tokens, so that the matrices stay small
        band = tokens[at:at + 4096]
        x, y = (np.array([np.isin(band, s, assume_unique=True) for s in group], np.float32) for group in (sets, sets2))
        common += x @ y.T
    linked = 100 * common >= percent * (size[:, None] + size2 - common)
    i, j = np.nonzero(linked & (comp[:, None] != comp2))
    _, first = np.unique(np.stack([rep[i], comp2[j]]), axis=1, return_index=True)
    return rep[i[first]], rep2[j[first]]


def components_by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    found = classes(docs, id_col, text_col, **options)
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(back("doc").alias("doc_id"), "n_shingles", back("component").alias("component_id"),
                        F.col("first").alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are the first document of their component, with all their columns; one of equal rows."""
    keys = [fresh(docs, "kept_doc"), fresh(docs, "kept_print")]
    kept = (classes(docs, id_col, text_col, **options).where("first").groupBy("doc", "f1", "f2")
            .agg(F.min("print").alias("print")).select(F.col("doc").alias(keys[0]), F.col("print").alias(keys[1])))
    keyed = docs.withColumns(dict(zip(keys, _keyed(id_col, text_col), strict=True)))
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)
