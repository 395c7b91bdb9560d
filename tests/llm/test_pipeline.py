import sys
from pathlib import Path

import brute
import pytest
from conftest import SF

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from cellsight.session import materialize  # noqa: E402


def test_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_on_documents(spark, documents):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), f"test-{name}")
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == documents.columns
        docs = out
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before, after = map(text, seen["lines"])
    assert after == {k: "\n".join(kept) for k, _, kept in brute.kept_lines(list(before.items()))}
    before, after = map(text, seen["near_duplicates"])
    comps, _ = brute.near_components(before, n=5)
    assert after == {i: t for i, t in before.items() if comps[i] == i}
    words = {i: len(brute.words(t)) for i, t in after.items()}
    packed = {}
    for r in seen["packing"][1].collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["n_tokens"]
    assert packed == words
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = text(seen["quality"][1])
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    kept_lang = text(seen["language"][1])
    assert len(kept_lang) >= 0.97 * len(kept)


def test_stages_take_edge_rows(spark, edge_docs, no_docs):
    for source in (edge_docs, no_docs):
        docs = source
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, docs, SF), f"edge-{name}")
            if name != "packing":
                assert out.columns == docs.columns
                docs = out
        assert out.count() >= 0


@pytest.mark.parametrize("name", ["pipeline"])
def test_run_equals_stages(spark, name):
    rows = entry.queries()[name](spark, SF).collect()
    assert rows and {"doc_id", "bin_id"} <= set(rows[0].asDict())
