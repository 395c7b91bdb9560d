import html
import re

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from cellsight.llm import _vectors, ann, exact_topk, html_extract
from cellsight.session import materialize


@pytest.fixture(scope="module")
def edge_vectors(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, rnd.normal(size=4).tolist()) for i in range(260)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(260, 400)]          # a hot group of equal vectors
    rows += [(500, None), (600, []), (700, [1.0, None, 0.0, 1.0]), (800, [float("nan"), 0.0, 0.0, 1.0]),
             (900, [float("inf"), 0.0, 0.0, 1.0]), (1000, [0.0, 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]),
             (1100, [1.0, 2.0]), (0, rows[0][1]), (1200, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("v", F.lit(0)).repartition(4)


def usable(table, drop_zero):
    out = {}
    for r in table.select("vec_id", "embedding").collect():
        v = r["embedding"]
        if r["vec_id"] is None or not v or any(x is None or not np.isfinite(x) for x in v) or (drop_zero and not any(v)):
            continue
        out[r["vec_id"]] = min(v, out.get(r["vec_id"], v))
    return out


def brute(vectors, every, k, score, descending):
    want = {}
    for q in sorted(i for i in vectors if i % every == 0):
        found = [(score(vectors[q], v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
        found.sort(key=lambda x: (-x[0] if descending else x[0], x[1]))
        for rank, (s, i) in enumerate(found[:k], 1):
            want[q, rank] = (i, s)
    return want


def inner(a, b):
    return sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b, strict=True))


def distance(a, b):
    return float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum()))


@pytest.mark.parametrize("shard_rows", [4096, 60])
def test_topk_matches_brute_force(spark, edge_vectors, shard_rows):
    for table in (edge_vectors, spark.read.parquet(f"{SF}/embeddings.parquet")):
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"])
               for r in exact_topk.top_k(table, shard_rows=shard_rows).collect()}
        assert got == brute(usable(table, False), 50, 5, inner, True)


def test_bounds_hold():
    rnd = np.random.default_rng(1)
    v, q = rnd.integers(-300, 300, (200, 8)), rnd.integers(-300, 300, (20, 8))
    assert (exact_topk.ApproximationFile(v).upper_bounds(q.astype(float)) >= q @ v.T).all()
    same = np.tile(v[:1], (5, 1))
    assert (exact_topk.ApproximationFile(same).upper_bounds(q.astype(float)) >= q @ same.T).all()


def test_topk_in_groups_of_queries(spark, edge_vectors, monkeypatch):
    plans = {}

    def stored(df, name):
        plans[name] = plans.get(name, "") + df._jdf.queryExecution().toString()
        return materialize(df, name)

    monkeypatch.setattr(exact_topk, "materialize", stored)
    monkeypatch.setattr(_vectors, "GROUP_ENTRIES", 12)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"])
           for r in exact_topk.top_k(edge_vectors, query_every=10, shard_rows=60).collect()}
    assert got == brute(usable(edge_vectors, False), 10, 5, inner, True)
    # No block is copied for each pair of a query block and a data block.
    assert not [name for name, plan in plans.items() if re.search("Join|Generate|explode", plan)]


def test_scan_takes_ties_and_large_numbers():
    rnd = np.random.default_rng(2)
    for v in (rnd.integers(-2, 3, (600, 3)), np.tile([[3, -1]], (600, 1)), rnd.integers(-1 << 29, 1 << 29, (600, 5))):
        ids, found = rnd.permutation(600), _vectors.Found(50, 5, np.int64)
        for at in range(0, 600, 150):
            own = np.sort(ids[at:at + 150])
            exact_topk.scan(exact_topk.ApproximationFile(v[own]), own, v[own], np.arange(50), v[:50], found)
        for q in range(50):
            order = sorted((i for i in range(600) if i != q), key=lambda i: (-int(v[i] @ v[q]), i))[:5]
            assert found.ids[q].tolist() == order and (~found.costs[q]).tolist() == [int(v[i] @ v[q]) for i in order]


def test_nearest_recall_and_scores(spark, edge_vectors):
    for table, rows in ((spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 700), (edge_vectors, 100)):
        vectors = usable(table, True)
        want = brute(vectors, 100, 10, distance, False)
        got = ann.nearest(table, shard_rows=rows).collect()
        hits = {(r["query_id"], r["vec_id"]) for r in got}
        asked = {(q, i) for (q, _), (i, _) in want.items()}
        assert len(hits) == len(got) and len(hits & asked) >= 0.95 * len(asked)
        for r in got:
            assert abs(r["score"] - distance(vectors[r["query_id"]], vectors[r["vec_id"]])) < 1e-9
            assert r["vec_id"] != r["query_id"]
    # All of the 10 nearest of a hot vector are its smallest equals.
    hot = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 1200)
    assert [i for _, i in hot] == list(range(260, 270))


def test_nearest_in_groups_of_queries(edge_vectors, monkeypatch):
    plans = {}

    def stored(df, name):
        plans[name] = plans.get(name, "") + df._jdf.queryExecution().toString()
        return materialize(df, name)

    monkeypatch.setattr(ann, "materialize", stored)
    monkeypatch.setattr(_vectors, "GROUP_ENTRIES", 12)
    vectors = usable(edge_vectors, True)
    want = brute(vectors, 10, 10, distance, False)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"])
           for r in ann.nearest(edge_vectors, query_every=10, shard_rows=60).collect()}
    assert {(q, i) for (q, _), (i, _) in got.items()} == {(q, i) for (q, _), (i, _) in want.items()}
    assert all(abs(s - want[x][1]) < 1e-9 for x, (_, s) in got.items())
    # No graph is copied for each block of queries.
    assert not [name for name, plan in plans.items() if re.search("Join|Generate|explode", plan)]


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_queries_of_a_block_share_what_they_read(kind):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(3000, 16)).astype(kind)
    v[:300] = v[0] + 1e-5 * rnd.normal(size=(300, 16))   # near copies
    q = np.concatenate([v[:3000:10], v[:20] + kind(1e-6)])
    nodes, flat = ann.build(np.arange(3000), v)
    beam, dist, read = ann.walk(v, nodes, flat, q)
    assert read <= 1.1 * len(v)
    exact = ((q[:, None].astype(float) - v) ** 2).sum(2)
    hits = sum(len(set(np.argsort(d, kind="stable")[:10]) & set(b[:10].tolist())) for d, b in zip(exact, beam, strict=True))
    assert hits >= 0.99 * 10 * len(q)
    assert np.allclose(dist, np.take_along_axis(exact, beam, 1), rtol=1e-3) and (np.diff(dist, axis=1) >= 0).all()


@pytest.mark.parametrize("v", [np.random.default_rng(4).normal(size=(900, 6)), np.eye(700), np.ones((1, 3)), np.eye(2),
                               1 + 1e-4 * np.random.default_rng(5).normal(size=(800, 4))])
def test_links_come_from_the_nearest_predecessors(v):
    v = v.astype(np.float32)
    exact = ((v[:, None].astype(float) - v) ** 2).sum(2)
    near = ann._predecessors(v, 64)
    chosen = ann._diverse(np.arange(len(v)), near, v, 16)
    for i in range(0, len(v), 7):
        d = np.sort(exact[i, :i])[:64]
        assert np.allclose(np.sort(exact[i, near[i][near[i] >= 0]]), d, rtol=1e-3, atol=1e-12) and (near[i] >= 0).sum() == len(d)
        kept = chosen[i][chosen[i] >= 0]
        assert len(kept) == min(16, len(d)) == len(set(kept.tolist()))
        assert not len(d) or exact[i, kept].min() <= d[0] * 1.001
    nodes, flat = ann.build(np.arange(len(v)), v)
    assert flat[0].shape[1] == 32 and (flat[0] < len(v)).all() and not (flat[0] == nodes[0][:, None]).any()


def test_vectors_empty_table(edge_vectors):
    assert exact_topk.top_k(edge_vectors.limit(0)).count() == 0
    assert ann.nearest(edge_vectors.limit(0)).count() == 0


# ---- pages ------------------------------------------------------------------------

def test_articles_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extract.extract_pages(pages).collect():
        body = raw[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


PARA = "This paragraph holds a fair amount of running text, as the body of an article does. "


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("   ", ""), ("<html><body><nav><a href=x>Menu</a></nav></body></html>", ""),
    ("just words", "just words"),
    (f"<body><header>Site</header><nav><ul><li>Home</li></ul></nav><main><h2>Title</h2><p>{PARA}</p><p>Short.</p>"
     f"<p>{PARA * 2}</p></main><aside>Other</aside><div class='comments'><p>{PARA * 3}</p></div><footer>(c)</footer>",
     f"Title\n{PARA.strip()}\nShort.\n{(PARA * 2).strip()}"),
    (f"<div id=cookie-notice><p>{PARA}</p></div><div class=post><p>A &amp; B &lt;c&gt; &eacute;\n {PARA}<p>Two<br>Three</div>"
     "<div class='sidebar'><p>Side</p></div><form><p>Name</p></form>",
     f"A & B <c> é {PARA.strip()}\nTwo\nThree"),
    (f"<article><script>var a='<p>no</p>';</script><style>p{{}}</style><p>{PARA}</p><table><tr><td>cell one</td>"
     f"<td>cell two</td></tr></table></article>", f"{PARA.strip()}\ncell one\ncell two"),
    (f"<div class=ad><p>Buy</p><article><p>{PARA}</p></article>", PARA.strip()),
    (f"<article><div class='article-header'><h1>Title</h1></div><p class=notice>Read our terms<p>{PARA}<ul><li class=promo>x"
     f"<li>Point</ul><section id=userComments><p>{PARA}</p></section></article>", f"Title\n{PARA.strip()}\nPoint"),
])
def test_pages(page, want):
    assert html_extract.extract(page) == want


TEXT = PARA.strip()
LONG_TEXT = (PARA * 20).strip()


@pytest.mark.parametrize("page, want", [
    (f"<article><h1>Title</h1><p>Lead.</p><div class=body><p>{PARA * 20}</p></div></article>", f"Title\nLead.\n{LONG_TEXT}"),
    (f"<article><header><h1>Title</h1></header><div>{PARA * 20}</div></article>", f"Title\n{LONG_TEXT}"),
    (f"<main><h1>Title</h1><article><p>{PARA * 20}</p></article><article><p>{PARA}</p></article></main>",
     f"Title\n{LONG_TEXT}\n{TEXT}"),
    (f"<body><section><p>{PARA * 20}</p></section><section><p>Short one.</p></section></body>", f"{LONG_TEXT}\nShort one."),
    (f"<body><article><p>{PARA * 20}</p></article><article><p>{PARA}</p></article></body>", f"{LONG_TEXT}\n{TEXT}"),
    (f"<body><h1><a href=x>Title</a></h1><div><a href=1>One link</a> <a href=2>Two</a></div><p>Lead.</p>"
     f"<div><p>{PARA * 20}</p></div></body>", f"Title\nLead.\n{LONG_TEXT}"),
])
def test_pages_keep_what_stands_beside_the_body(page, want):
    assert html_extract.extract(page) == want


@pytest.mark.parametrize("page, want", [
    (f"<article><h2 id=related-work>Related work</h2><p>{PARA}</p><h2 id=share>Share</h2><section id=comments-on-the-treaty>"
     f"<p>{PARA}</p></section><p id=notice-of-appeal>Notice.</p><p id=share-prices>Prices.</p></article>",
     f"Related work\n{TEXT}\nShare\n{TEXT}\nNotice.\nPrices."),
    (f"<body><div class='page has-sidebar'><p>{PARA}</p></div></body>", TEXT),
    (f"<body><div class='post comments-open'><p>{PARA}</p></div></body>", TEXT),
    (f"<body><div class=widget><p>{PARA * 20}</p><div class=share-buttons>Tweet</div></div><p>End.</p></body>",
     f"{LONG_TEXT}\nEnd."),
    (f"<body><p>{PARA}</p><div class=comment-list><p>{PARA * 20}</p></div><ul class=related-posts><li>{PARA}</ul>"
     f"<div id=left-sidebar>{PARA}</div></body>", TEXT),
])
def test_pages_take_names_as_hints(page, want):
    assert html_extract.extract(page) == want


@pytest.mark.parametrize("page, want", [
    (f"<body><article><p>{PARA}</p></article><section class=comments><article class=comment><p>{PARA * 9}</p></article>"
     "</section></body>", TEXT),
    (f"<body><main><p>{PARA}</p><article class=comment><p>{PARA * 9}</p></article></main></body>", TEXT),
    (f"<body><article><p>{PARA}</p><article class='user-comment'>{PARA * 9}</article></article></body>", TEXT),
    (f"<body><article><p>{PARA}</p></article><aside><article><p>{PARA}</p></article></aside>"
     f"<footer><article><p>{PARA}</p></article></footer><div role=complementary><article>{PARA}</article></div></body>", TEXT),
    (f"<body><nav><a href=x>Menu</a><article><p>{PARA}</p></article></body>", TEXT),
    (f"<body><form id=all><article><p>{PARA}</p></article></form></body>", TEXT),
])
def test_pages_leave_out_articles_of_closed_sections(page, want):
    assert html_extract.extract(page) == want


def test_pages_edge_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>text of a page</p>"), (1, "u", None),
            (3, "w", "<article><p>" + "word " * 200_000 + "</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")) \
        .withColumn("n_chars", F.lit("y"))
    got = sorted((str(r["page_id"]), str(r["url"]), r["n_chars"]) for r in html_extract.extract_pages(pages).collect())
    assert got == [("1", "u", 0), ("1", "u", 0), ("2", "None", 0), ("3", "w", 999_999), ("None", "v", 14)]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
