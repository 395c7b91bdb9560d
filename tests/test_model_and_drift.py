"""The risk model against its own node table, recall priority, and drift from sketches."""

import os

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cellsight.operators import extensions, forest, risk
from cellsight.schemas import FEATURE_COLUMNS
from cellsight.sinks import load_model, save_model


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = np.random.default_rng(11)
    rows = [(f"r{i}", *map(float, rnd.gamma(2.0, 50.0, 4))) for i in range(120)]
    return risk.label_risk(spark.createDataFrame(rows, ["region_name", *FEATURE_COLUMNS]))


@pytest.fixture(scope="module")
def model(labelled):
    # A label that the features only partly tell, so that trees are deep and leaves are mixed.
    noisy = labelled.withColumn("label", F.when(F.xxhash64("region_name") % 7 == 0, F.lit("LOW")).otherwise(F.col("label")))
    return risk.train_risk_model(noisy, 30)


def shares(model, rows):
    found = model.transform(rows).withColumn("p", vector_to_array("probability"))
    return {r["region_name"]: (r["congestion_risk"], *r["p"]) for r in found.collect()}


def test_node_table_gives_the_probabilities_of_the_model(spark, labelled, model, tmp_dir):
    path = os.path.join(tmp_dir, "model")
    save_model(model, path)
    # Also rows that lie on thresholds and far outside of what was seen.
    nodes = forest.forest_nodes(spark, path)
    cuts = [r["threshold"] for r in nodes.where("feature = 0").select("threshold").distinct().collect()][:20]
    extra = spark.createDataFrame([(f"cut{i}", c, 1.0, 1e9, -1e9) for i, c in enumerate(cuts)], ["region_name", *FEATURE_COLUMNS])
    rows = labelled.drop("label").unionByName(extra)
    before, after = shares(model, rows), shares(load_model(path), rows)
    assert before == after
    by_nodes = {r["region_name"]: r for r in forest.node_probabilities(nodes, rows, "region_name").collect()}
    assert by_nodes.keys() == before.keys()
    for name, (label, *p) in before.items():
        own = [by_nodes[name][c] for c in ("p_low", "p_medium", "p_high")]
        assert own == pytest.approx(p, abs=1e-12) and own[risk.RISK_LABELS.index(label)] >= max(own) - 1e-9
    assert any(0 < max(p) < 1 for _, *p in before.values())


def test_differences_find_scores_that_do_not_follow_the_model(spark, labelled, model, tmp_dir):
    path = os.path.join(tmp_dir, "model")
    save_model(model, path)
    rows = labelled.drop("label")
    found = forest.node_probabilities(forest.forest_nodes(spark, path), rows, "region_name")
    scored = risk.score_batch(model, rows)
    check = lambda df: {(r["region_name"], c) for r in forest.score_differences(df, found, "region_name", 0.75).collect()
                        for c in ("class_ok", "score_ok", "flag_ok") if not r[c]}
    assert check(scored) == set()
    r0 = F.col("region_name") == "r0"
    assert check(scored.withColumn("score", F.when(r0, F.col("score") - 0.001).otherwise(F.col("score")))) == {("r0", "score_ok")}
    assert ("r0", "flag_ok") in check(scored.withColumn("anomaly_flag", F.col("anomaly_flag") != r0))
    unknown = spark.createDataFrame([("new", "HIGH", 0.9, False)], "region_name string, congestion_risk string, score double, anomaly_flag boolean")
    assert check(unknown) == {("new", "class_ok"), ("new", "score_ok"), ("new", "flag_ok")}


def test_recall_priority_goes_by_the_models_probability(labelled, model):
    rows = labelled.drop("label")
    plain = shares(model, rows)
    got = {r["region_name"]: r for r in extensions.score_with_recall(model, rows, 0.3).collect()}
    for name, (label, *p) in plain.items():
        assert got[name]["p_high"] == p[risk.RISK_LABELS.index("HIGH")]
        assert got[name]["congestion_risk"] == ("HIGH" if got[name]["p_high"] >= 0.3 else label)


def test_class_weights_raise_the_probability_of_their_label(spark, labelled):
    """The same noisy rows, with HIGH counting ten times: its mean probability and its recall grow."""
    noisy = labelled.withColumn("label", F.when(F.xxhash64("region_name") % 3 == 0, F.lit("MEDIUM")).otherwise(F.col("label")))
    noisy = noisy.select("region_name", "label", *[F.round(F.col(c), -2).alias(c) for c in FEATURE_COLUMNS])
    of = lambda m: risk.score_batch(m, noisy, with_p_high=True).agg(
        F.avg("p_high"), F.count_if((F.col("label") == "HIGH") & (F.col("congestion_risk") == "HIGH"))).first()
    even, weighted = of(risk.train_risk_model(noisy, 30)), of(risk.train_risk_model(noisy, 30, class_weights={"HIGH": 10.0}))
    assert weighted[0] > even[0] and weighted[1] >= even[1]


def exact_psi(a, b, edges):
    n = len(edges) + 1
    pa, pb = ((np.bincount(np.searchsorted(edges, x, side="left"), minlength=n) + 0.5) / (len(x) + 0.5 * n) for x in (a, b))
    return float(((pb - pa) * np.log(pb / pa)).sum())


@pytest.mark.parametrize("shift", [0.0, 0.6])
def test_drift_from_sketches_is_near_the_exact_one(spark, shift):
    rnd = np.random.default_rng(3)
    days = [(f"2024-01-{1 + i % 20:02d}", float(x) + (shift if i % 20 >= 10 else 0.0)) for i, x in enumerate(rnd.normal(size=30_000))]
    df = spark.createDataFrame(days + [("2024-01-03", None), ("2024-01-03", float("nan"))], "day string, x double").repartition(7)
    sketches = extensions.day_sketches(df, "x", "day")
    assert sketches.count() == 20 and max(len(r["sketch"]) for r in sketches.collect()) < 20_000
    got = extensions.sketch_drift(sketches, ("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20")).first()
    a, b = (np.array([x for d, x in days if (d <= "2024-01-10") == first]) for first in (True, False))
    assert (got["n_before"], got["n_after"]) == (len(a), len(b)) and len(got["edges"]) == 9
    # Edges are deciles of the first period within the rank error of the sketch, and the index is near the exact one.
    ranks = np.searchsorted(np.sort(a), got["edges"]) / len(a)
    assert np.abs(ranks - np.arange(1, 10) / 10).max() < 0.02
    assert got["psi"] == pytest.approx(exact_psi(a, b, np.quantile(a, np.arange(1, 10) / 10)), abs=0.02 + 0.1 * shift)


def test_drift_with_few_values_or_an_empty_period(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0)] * 50 + [("2024-01-02", 1.0)] * 30 + [("2024-01-02", 2.0)] * 30, "day string, x double")
    sketches = extensions.day_sketches(df, "x", "day")
    same = extensions.sketch_drift(sketches, ("2024-01-01", "2024-01-01"), ("2024-01-01", "2024-01-01")).first()
    moved = extensions.sketch_drift(sketches, ("2024-01-01", "2024-01-01"), ("2024-01-02", "2024-01-02")).first()
    assert same["edges"] == [1.0] and same["psi"] == 0 and moved["psi"] == pytest.approx(
        exact_psi(np.ones(50), np.array([1.0] * 30 + [2.0] * 30), [1.0]))
    assert extensions.sketch_drift(sketches, ("2023-01-01", "2023-12-31"), ("2024-01-01", "2024-01-02")).collect() == []
