import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsight.functions.ranking import column_percentiles, exact_percentiles, key_value, order_keys, rank_within
from cellsight.operators import risk


def test_exact_percentiles_match_numpy(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_percentiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0])
    assert got == pytest.approx(list(np.percentile(vals, [0, 25, 50, 90, 100])))


def _special_doubles():
    rnd = np.random.default_rng(0)
    powers = [2.0 ** k for k in range(-1074, 1024, 3)]
    return ([0.0, -0.0, 5e-324, -5e-324, float("inf"), -float("inf"), np.finfo(float).max, -np.finfo(float).max]
            + powers + [float(np.nextafter(p, 0)) for p in powers] + [-p for p in powers]
            + (rnd.normal(size=500) * 10.0 ** rnd.integers(-300, 300, 500)).tolist())


def test_order_keys_sort_as_doubles_and_turn_back():
    x = np.array(_special_doubles())
    keys = order_keys(x)
    by_key, by_value = x[np.argsort(keys, kind="stable")], np.sort(x)
    assert (by_key == by_value).all() and [key_value(k) for k in keys.tolist()] == x.tolist()
    assert (np.diff(keys[np.argsort(x, kind="stable")]) >= 0).all() and order_keys(np.array([-0.0, 0.0])).tolist() == [0, 0]


def test_percentiles_of_columns_equal_sorted_values(spark):
    """Special values, one value holding a third of the rows, nulls, NaN, integers, an empty column; exactly equal."""
    rnd = np.random.default_rng(1)
    special = [float(v) for v in _special_doubles() if np.isfinite(v)]
    n = len(special)
    near = (1.0 + rnd.integers(0, 1 << 20, n) * 2.0 ** -52).tolist()              # equal up to the last digit
    hot = [7.25 if i % 3 == 0 else float(v) for i, v in enumerate(rnd.normal(size=n))]
    holes = [None if i % 4 == 0 else float("nan") if i % 4 == 1 else float(i) for i in range(n)]
    rows = list(zip(special, near, hot, holes, rnd.integers(-5, 5, n).tolist(), [None] * n, strict=True))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e int, f double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]
    got = column_percentiles(df, list("abcdef"), probs)
    for name, column in zip("abcde", zip(*rows, strict=True), strict=False):
        values = np.array([v for v in column if v is not None and v == v], float)
        assert got[name] == np.quantile(values, probs).tolist()
    assert np.isnan(got["f"]).all()


def test_rank_within_skewed_group(spark):
    # One group holds most rows, including many equal values.
    rows = [("hot", i % 7) for i in range(500)] + [("cold", i) for i in range(5)] + [(None, 1)]
    df = spark.createDataFrame(rows, "g string, x int")
    ranked = rank_within(df, ["g"], ["x"], "r", num_partitions=6).collect()
    for g in ["hot", "cold", None]:
        got = sorted((r["r"], r["x"]) for r in ranked if r["g"] == g)
        xs = sorted(x for gg, x in rows if gg == g)
        assert [r for r, _ in got] == list(range(len(xs)))
        assert [x for _, x in got] == xs


def test_ranks_of_many_rows_are_a_permutation(spark):
    """450,000 rows, one group with nine tenths of them; whatever columns the caller keeps."""
    df = (spark.range(450_000).withColumn("g", F.when(F.col("id") % 10 == 0, "A").otherwise("B"))
          .withColumn("x", F.xxhash64("id") % 5000).withColumn("extra", F.md5(F.col("id").cast("string"))).repartition(8))
    ranked = rank_within(df, ["g"], ["x"], "r", num_partitions=8)
    seen = ranked.groupBy("g").agg(F.count("r").alias("n"), F.count_distinct("r").alias("d"), F.min("r").alias("lo"),
                                   F.max("r").alias("hi")).collect()
    for r in seen:
        assert r["n"] == r["d"] == r["hi"] + 1 and r["lo"] == 0
    ends = ranked.groupBy("g", "x").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("extra").alias("n"))
    assert ends.where("hi - lo + 1 <> n").isEmpty()


def test_split_of_many_rows_matches_row_number(spark, tmp_dir):
    from pyspark.sql import Window
    df = (spark.range(400_000).withColumn("region_name", F.concat(F.lit("r"), "id"))
          .withColumn("label", F.when(F.col("id") % 10 == 0, "HIGH").when(F.col("id") % 10 < 5, "MEDIUM").otherwise("LOW"))
          .repartition(8))
    path = f"{tmp_dir}/split"
    risk.stratified_split(df).write.parquet(path)
    w = Window.partitionBy("label").orderBy(F.md5(F.concat(F.col("region_name"), F.lit("|42"))))
    want = df.withColumn("n", F.row_number().over(w)).withColumn(
        "want", F.when(F.col("n") <= F.round(F.count(F.lit(1)).over(Window.partitionBy("label")) * 0.2), "test").otherwise("train"))
    both = spark.read.parquet(path).join(want.select("id", "want"), "id")
    assert both.count() == 400_000 and both.where("split <> want").isEmpty()


def test_labels_with_ties(spark):
    # M2: values equal to p50 / p90 take the higher label.
    feats = spark.createDataFrame([(f"r{i}", float(v)) for i, v in enumerate([1, 2, 2, 2, 3, 10, 10, 10, 10, 10])],
                                  "region_name string, avg_usage double")
    p50, p90 = np.percentile([1, 2, 2, 2, 3, 10, 10, 10, 10, 10], [50, 90])
    labels = {r["region_name"]: r["label"] for r in risk.label_risk(feats).collect()}
    assert risk.risk_thresholds(feats) == pytest.approx((p50, p90))
    assert labels["r5"] == "HIGH" and labels["r4"] == "LOW" and labels["r0"] == "LOW"


def test_split_sizes_and_determinism(spark):
    rows = [(f"r{i}", "LOW" if i < 12 else "MEDIUM" if i < 22 else "HIGH") for i in range(25)]
    df = spark.createDataFrame(rows, "region_name string, label string")
    a = {r["region_name"]: r["split"] for r in risk.stratified_split(df).collect()}
    b = {r["region_name"]: r["split"] for r in risk.stratified_split(df).collect()}
    assert a == b
    tests = [r for r, s in a.items() if s == "test"]
    by = {lab: sum(1 for r, l in rows if r in tests and l == lab) for lab in ["LOW", "MEDIUM", "HIGH"]}
    assert by == {"LOW": 2, "MEDIUM": 2, "HIGH": 1}


def test_report_metrics(spark):
    pred = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("C", "B")],
                                 "label string, congestion_risk string")
    rep = {r["label"]: r for r in risk.classification_report(pred).collect()}
    assert rep["accuracy"]["precision"] == pytest.approx(0.5)
    assert rep["B"]["precision"] == pytest.approx(1 / 3) and rep["B"]["recall"] == 1.0
    assert rep["C"]["precision"] == 0.0 and rep["C"]["f1_score"] == 0.0
    assert rep["macro avg"]["recall"] == pytest.approx((0.5 + 1 + 0) / 3)
    assert rep["weighted avg"]["support"] == 4


def test_scoring_flag_uses_raw_score(spark):
    # D-6: a HIGH prediction with top probability 0.75004 is flagged; exactly 0.75 is not.
    from pyspark.ml.linalg import Vectors
    from pyspark.ml import Transformer

    class Fixed(Transformer):
        def _transform(self, df):
            return df.withColumn("congestion_risk", F.lit("HIGH"))

    class WithProb(Fixed):
        def _transform(self, df):
            out = super()._transform(df)
            from pyspark.ml.linalg import VectorUDT
            from pyspark.sql.types import StringType, StructField, StructType
            schema = StructType([StructField("region_name", StringType()), StructField("probability", VectorUDT())])
            probs = spark.createDataFrame([("a", Vectors.dense([0.2, 0.04996, 0.75004])),
                                           ("b", Vectors.dense([0.25, 0.0, 0.75]))], schema)
            return out.join(probs, "region_name")

    feats = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 1.0), ("b", 1.0, 0.0, 0.0, 1.0)],
                                  "region_name string, avg_usage double, growth_rate double, variability double, peak_ratio double")
    out = {r["region_name"]: r for r in risk.score_batch(WithProb(), feats).collect()}
    assert out["a"]["anomaly_flag"] is True and out["a"]["score"] == 0.75
    assert out["b"]["anomaly_flag"] is False


def test_scenario_validation(spark):
    df = spark.createDataFrame([("ok", 1000.0, 0.1, 100.0, 1.4), ("bad", -1.0, 0.1, 100.0, None),
                                ("nogrowth", 1.0, None, 1.0, 1.0)],
                               "region string, avg_usage double, growth_rate double, variability double, peak_ratio double")
    out = {r["region"]: r for r in risk.validate_scenarios(df).collect()}
    assert out["ok"]["error"] is None
    assert "avg_usage" in out["bad"]["error"] and out["bad"]["peak_ratio"] == 1.0
    assert out["nogrowth"]["error"] == "Missing feature: growth_rate"


def test_train_and_score_end_to_end(spark):
    import random
    rnd = random.Random(1)
    rows = [(f"r{i}", float(i * 10 + rnd.random()), rnd.random(), float(i), 1.0 + rnd.random()) for i in range(30)]
    feats = spark.createDataFrame(rows, "region_name string, avg_usage double, growth_rate double, "
                                        "variability double, peak_ratio double")
    labelled = risk.label_risk(feats)
    split = risk.stratified_split(labelled)
    model = risk.train_risk_model(split.where("split = 'train'"), num_trees=20)
    scored = risk.score_batch(model, feats).collect()
    assert len(scored) == 30
    assert all(r["congestion_risk"] in ("LOW", "MEDIUM", "HIGH") and 1 / 3 <= r["score"] <= 1 for r in scored)
