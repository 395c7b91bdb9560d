"""Collocations, whitening and SimHash against plain versions, on the given tables and on awkward rows."""

import collections
import re

import brute
import numpy as np
import pytest
import xxhash
from conftest import LONG, SF
from pyspark.sql import functions as F

from cellsight.llm import collocations, simhash_dedup, whitening

# ---- collocations -----------------------------------------------------------------


def plain_collocations(rows, least=30, top=2000):
    """rows: (lang, text) -> {(lang, rank): (phrase, a, l, r, n, score)}."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.low(text or "")):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    cand = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    gone = {(lang, w[i:j]) for (lang, w), a in cand.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1)
            if j - i < len(w) and 100 * a >= 80 * f[lang, w[i:j]]}
    by_lang = collections.defaultdict(list)
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            by_lang[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, rank): (p.decode(), -a, x, y, n[lang], -s) for lang, found in by_lang.items()
            for rank, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)}


def collected(df):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


@pytest.fixture(scope="module")
def phrase_rows():
    rnd = np.random.default_rng(5)
    words = ["a", "B", "c\x01", "é", "d d", "zz"]
    rows = [("en", " ".join(rnd.choice(words, 30))) for _ in range(60)]
    rows += [("en", "Strong tea, strong TEA; strong\ttea\x0bstrong tea")] * 12          # copies count
    rows += [("fr", "la vie en rose. la vie en rose! la vie en\nrose")] * 20             # ties, and a phrase cut by \n
    rows += [(None, "one two three four five"), ("", "one two")] * 35 + [("de", None), ("de", ""), ("de", " \t\r\n,;")]
    return rows + [("en", LONG), ("en", LONG)]


def test_collocations_match_brute_force(spark, phrase_rows):
    docs = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(phrase_rows)],
                                 "doc_id long, lang string, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("phrase", "words", "f", "k", "body", "n", "rank")}).repartition(3)
    want = plain_collocations(phrase_rows)
    assert collected(collocations.collocations(docs)) == want
    assert {lang for lang, _ in want} == {"en", "fr", "und", ""}
    # Few hash ranges or many, and a shorter list.
    assert collected(collocations.collocations(docs, range_bytes=1000)) == want
    assert collected(collocations.collocations(docs, top=3)) == {k: v for k, v in want.items() if k[1] <= 3}


def test_collocations_count_all_phrases(spark, phrase_rows):
    docs = spark.createDataFrame(phrase_rows[-80:], "lang string, text string")
    counts = {(r["lang"], r["phrase"]): r["f"] for r in collocations.phrase_counts(docs, least=2).where("words > 0").collect()}
    f = collections.Counter()
    for lang, text in phrase_rows[-80:]:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.low(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update(("und" if lang is None else lang, " ".join(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert counts == {k: c for k, c in f.items() if c >= 2}


def test_scores_of_large_counts_are_exact(spark):
    big = 3_000_000_000_000_000_000
    counts = spark.createDataFrame([("en", 1, "a", big + 7), ("en", 1, "b", big + 9), ("en", 2, "a b", big + 1)],
                                   "lang string, words int, phrase string, f long")
    assert collocations.candidates(counts).first()["score"] == 2_000_000 * (big + 1) // (2 * big + 16)


def test_no_documents_have_no_phrases(no_docs):
    assert collocations.collocations(no_docs).collect() == []


# ---- whitening ----------------------------------------------------------------------

def check_whitening(got, vectors, components=32):
    """got: rows; vectors: the usable vectors of one length, by position in id order."""
    ints = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, dim = len(ints), len(ints[0])
    sums = [sum(x[d] for x in ints) for d in range(dim)]
    centred = np.array([[(n * x[d] - sums[d]) / n for d in range(dim)] for x in ints])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    k = len(values)
    assert len(got) == n * k
    rows = sorted(got, key=lambda r: (r["vec_id"], r["component"]))
    white = np.array([r["whitened"] for r in rows]).reshape(n, k)
    want = centred @ axes / np.sqrt(values)
    assert np.allclose(white * np.sign((white * want).sum(axis=0)), want, atol=1e-7)
    far = [sum((n * x[d] - sums[d]) ** 2 for d in range(dim)) for x in ints]
    assert [r["deviation"] for r in rows] == [x for x in far for _ in range(k)]
    assert [r["component"] for r in rows] == list(range(1, k + 1)) * n and {r["n"] for r in rows} == {n}
    assert np.allclose([r["explained"] for r in rows[:k]], values / np.trace(cov), rtol=1e-9)
    error = {r["identity_error"] for r in rows}
    measured = (white - white.mean(axis=0)).T @ (white - white.mean(axis=0)) / n - np.eye(k)
    assert len(error) == 1 and error.pop() == pytest.approx(np.abs(measured).max(), abs=1e-12)
    assert np.abs(measured).max() < 1e-9


@pytest.mark.parametrize("block_rows", [4096, 23])
def test_whitening_matches_dense_algebra(spark, block_rows):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [r["embedding"] for r in table.orderBy("vec_id").collect()]
    check_whitening(whitening.whitened_by_component(table, block_rows=block_rows).collect(), vectors)


def test_whitening_of_awkward_rows(spark):
    rnd = np.random.default_rng(2)
    good = [(i, (rnd.normal(size=4) * [9, 5, 3, 1] + [0, 7, -2, 0]).tolist()) for i in range(150)]
    good += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(150, 260)]                 # equal rows
    bad = [(900, None), (901, []), (902, [1.0, None, 0.0, 1.0]), (903, [float("nan"), 0.0, 0.0, 1.0]),
           (904, [float("-inf"), 0.0, 0.0, 1.0]), (905, [1e300, 0.0, 0.0, 1.0])]
    other = [(i, [float(i), float(i)]) for i in range(950, 960)] + [(970, [5.0])]  # other lengths
    df = spark.createDataFrame(good + bad + other, "vec_id long, embedding array<double>")
    df = df.withColumns({c: F.lit("x") for c in ("id", "x", "n", "seq", "component", "block")}).repartition(5)
    got = whitening.whitened_by_component(df, block_rows=40).collect()
    assert {r["vec_id"] for r in got} == {i for i, _ in good + other}
    check_whitening([r for r in got if r["vec_id"] < 900], [v for _, v in good])
    line = sorted((r["vec_id"], r["component"], r["whitened"]) for r in got if 950 <= r["vec_id"] < 960 and r["component"] == 1)
    assert np.allclose(np.abs([x for _, _, x in line]), np.abs((np.arange(10) - 4.5) / np.std(np.arange(10))))
    # No variance: the second component of the line, and the only row of its length.
    flat = [r for r in got if r["vec_id"] == 970 or (r["vec_id"] >= 950 and r["component"] == 2)]
    assert len(flat) == 11 and all(r["whitened"] is None and r["explained"] < 1e-12 for r in flat)


def test_whitening_keeps_rows_under_shared_ids(spark):
    rnd = np.random.default_rng(3)
    rows = [(None if i < 3 else 7 if i < 6 else 100 + i, rnd.normal(size=3).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    (model, white), = whitening.whiten(df)
    assert model.n == 40 and white.count() == 40 and white.where("id is null").count() == 3 and white.where("id = '7'").count() == 3


def test_whitening_of_an_empty_table(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert whitening.whitened_by_component(df).collect() == []
    assert whitening.whitened_by_component(df.limit(0)).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


# ---- SimHash ----------------------------------------------------------------------------

def plain_fingerprint(text):
    w = brute.words(text)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=2):
    """prints: [(id, fingerprint)] -> the component's smallest id, per row."""
    distinct = sorted({p for _, p in prints})
    label = {p: p for p in distinct}
    changed = True
    while changed:
        changed = False
        for i, p in enumerate(distinct):
            for q in distinct[i + 1:]:
                if (p ^ q).bit_count() <= bits and label[p] != label[q]:
                    label[p] = label[q] = min(label[p], label[q])
                    changed = True
    first = {}
    for doc, p in prints:
        if doc is not None:
            first[label[p]] = min(doc, first.get(label[p], doc))
    return [first.get(label[p]) for _, p in prints]


@pytest.mark.parametrize("name", ["documents", "edge_docs"])
def test_simhash_matches_brute_force(name, request):
    docs = request.getfixturevalue(name)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"])
                  for r in simhash_dedup.components_by_document(docs).collect()))
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.select("doc_id", "text").collect()]
    want = sorted((doc is None, doc or 0, f"{p:016x}", c) for (doc, p), c in zip(prints, plain_components(prints), strict=True))
    assert got == want


@pytest.mark.parametrize("crowd", [64, 3, 1])
def test_links_connect_all_within_two_bits(spark, crowd):
    rnd = np.random.default_rng(4)
    flip = lambda p, n: int(p) ^ sum(1 << int(b) for b in rnd.choice(64, n, replace=False))
    centres = [int(x) for x in rnd.integers(0, 1 << 63, 12)]
    prints = centres + [flip(p, k) for p in centres for k in (1, 2, 2, 3, 4)]
    half = centres[0] >> 32 << 32
    prints += [half | int(x) for x in rnd.integers(0, 1 << 32, 200)]              # a crowd with an equal segment
    prints += [flip(p, 2) for p in prints[-40:]] + [0, 1, 1 << 63, 3 << 62]       # and its neighbours; the sign bit
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash_dedup.links(df, crowd=crowd).collect()]
    assert all((a ^ b).bit_count() <= 2 and a != b for a, b in edges)
    if crowd == 64:
        crowd_free = [p for p in prints if p >> 32 != half >> 32]
        near = {(min(p, q), max(p, q)) for p in crowd_free for q in crowd_free if p < q and (p ^ q).bit_count() <= 2}
        assert near <= {(min(e), max(e)) for e in edges}
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    # Each list of neighbours has one entry per fingerprint: pairs stay in proportion to them.
    assert len(edges) <= 65 * len(prints)
    assert [root(p) for p in prints] == plain_components([(p, p) for p in prints])


def test_simhash_takes_text_ids_and_no_rows(spark, no_docs):
    docs = spark.createDataFrame([("b", "x y z w"), ("a", "X  y z\nw"), (None, "other words here"), ("c", None), ("d", "")],
                                 "doc_id string, text string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.components_by_document(docs).collect()}
    assert got["a"] == got["b"] and got["a"][1] == "a" and got["c"] == got["d"] == ("0" * 16, "c") and got[None][1] is None
    assert simhash_dedup.components_by_document(no_docs).collect() == []
