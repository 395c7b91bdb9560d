"""Congestion-risk labels, split, model, metrics and scoring (M2-M7, E5, Q10).

Training data has one row per region; Spark ML fits the forest on the
executors. Label thresholds and the split use exact ranks computed without
sending a whole group to one task (see :mod:`cellsight.functions.ranking`).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsight.functions.ranking import exact_percentiles, rank_within
from cellsight.operators._util import require_columns
from cellsight.schemas import FEATURE_COLUMNS, RISK_LABELS
from cellsight.session import materialize

ANOMALY_SCORE = 0.75


def risk_thresholds(features: DataFrame, col: str = "avg_usage") -> tuple[float, float]:
    """(p50, p90) of ``col`` over all rows, linear interpolation (M2)."""
    p50, p90 = exact_percentiles(features, col, [0.5, 0.9])
    return p50, p90


def label_risk(features: DataFrame, col: str = "avg_usage",
               thresholds: tuple[float, float] | None = None) -> DataFrame:
    """HIGH at or above p90, MEDIUM at or above p50, else LOW (M2).

    Without given thresholds the features (one row per region) are first
    written to the checkpoint folder: a double aggregate evaluated twice can
    differ in its last bit, and the median region must compare equal to the
    median computed from it.
    """
    if thresholds is None:
        features = materialize(features, "risk-features")
    p50, p90 = thresholds or risk_thresholds(features, col)
    x = F.col(col)
    label = F.when(x >= F.lit(p90), "HIGH").when(x >= F.lit(p50), "MEDIUM").otherwise("LOW")
    return features.withColumn("label", label)


def stratified_split(labelled: DataFrame, test_fraction: float = 0.2, seed: int = 42,
                     key_col: str = "region_name", label_col: str = "label") -> DataFrame:
    """Deterministic stratified split (M3): adds ``split`` in {train, test}.

    Within each label, rows are ordered by md5(key|seed) and the first
    round(test_fraction * n_label) are the test set.
    """
    order_key = F.md5(F.concat_ws("|", F.col(key_col).cast("string"), F.lit(str(seed))))
    ranked = rank_within(labelled.withColumn("_split_key", order_key), [label_col], ["_split_key"],
                         "_split_rank", few_groups=True)
    sizes = labelled.groupBy(F.col(label_col).alias("_size_label")).agg(
        F.round(F.count(F.lit(1)) * F.lit(test_fraction)).cast("long").alias("_n_test"))
    out = ranked.join(F.broadcast(sizes), F.col(label_col).eqNullSafe(F.col("_size_label"))).drop("_size_label")
    split = F.when(F.col("_split_rank") < F.col("_n_test"), "test").otherwise("train")
    return out.withColumn("split", split).drop("_split_key", "_split_rank", "_n_test")


def check_split_classes(labelled: DataFrame, label_col: str = "label") -> None:
    """Every class needs at least two rows for a stratified split."""
    small = [r[label_col] for r in labelled.groupBy(label_col).count().where("count < 2").collect()]
    if small:
        raise ValueError(f"classes with fewer than 2 rows cannot be split: {small}")


def label_index(label_col: str = "label"):
    """Index of the label in the fixed label list LOW, MEDIUM, HIGH."""
    return (F.array_position(F.array(*[F.lit(x) for x in RISK_LABELS]), F.col(label_col)) - 1).cast("double")


def risk_pipeline(num_trees: int = 200, seed: int = 42, max_depth: int = 30, weight_col: str | None = None) -> Pipeline:
    """Feature vector in fixed order -> random forest -> predicted label name (M4)."""
    weights = {"weightCol": weight_col} if weight_col else {}
    return Pipeline(stages=[
        VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="features_vec"),
        # Deep trees: node ids are cached per row (checkpointed to the checkpoint
        # folder every 10 iterations) instead of shipping all trees each level.
        RandomForestClassifier(labelCol="label_index", featuresCol="features_vec", numTrees=num_trees,
                               maxDepth=max_depth, seed=seed, featureSubsetStrategy="sqrt",
                               impurity="gini", bootstrap=True, cacheNodeIds=True, **weights),
        IndexToString(inputCol="prediction", outputCol="congestion_risk", labels=RISK_LABELS),
    ])


def train_risk_model(train: DataFrame, num_trees: int = 200, seed: int = 42,
                     class_weights: dict[str, float] | None = None) -> PipelineModel:
    """Fit the pipeline on labelled rows (M4).

    ``class_weights`` (label -> weight, 1 if missing) lets rows of a label
    count more; a larger weight of HIGH gives its recall priority (X6).
    """
    rows = train.withColumn("label_index", label_index())
    if class_weights is None:
        return risk_pipeline(num_trees, seed).fit(rows)
    weight = F.lit(1.0)
    for label, w in class_weights.items():
        weight = F.when(F.col("label") == label, F.lit(float(w))).otherwise(weight)
    return risk_pipeline(num_trees, seed, weight_col="class_weight").fit(rows.withColumn("class_weight", weight))


def score_batch(model: PipelineModel, features: DataFrame, with_p_high: bool = False) -> DataFrame:
    """All feature columns + congestion_risk, score (4 places, half-even), anomaly_flag (M6).

    The flag uses the unrounded top probability (D-6). ``with_p_high`` adds the
    model's probability of HIGH as ``p_high``.
    """
    scored = model.transform(features).withColumn("_p", vector_to_array(F.col("probability")))
    high = [F.get("_p", F.lit(RISK_LABELS.index("HIGH"))).alias("p_high")] if with_p_high else []
    return scored.select(*features.columns, "congestion_risk", *score_columns("_p", "congestion_risk"), *high)


def score_columns(probabilities: str, label: str) -> list:
    """``score`` and ``anomaly_flag`` from an array of class probabilities and the predicted label."""
    top = F.array_max(probabilities)
    return [F.bround(top, 4).alias("score"),
            ((F.col(label) == "HIGH") & (top > ANOMALY_SCORE)).alias("anomaly_flag")]


def validate_scenarios(df: DataFrame) -> DataFrame:
    """Range checks on scoring input (Q10): adds ``error`` (null when valid).

    avg_usage and variability must be present and >= 0, growth_rate present,
    peak_ratio >= 0 with a missing value read as 1.0.
    """
    require_columns(df, ["avg_usage", "growth_rate", "variability"])
    peak = F.coalesce(F.col("peak_ratio"), F.lit(1.0)) if "peak_ratio" in df.columns else F.lit(1.0)
    out = df.withColumn("peak_ratio", peak.cast("double"))
    problems = []
    for c in ["avg_usage", "growth_rate", "variability"]:
        problems.append(F.when(F.col(c).isNull(), F.lit(f"Missing feature: {c}")))
    for c in ["avg_usage", "variability", "peak_ratio"]:
        problems.append(F.when(F.col(c) < 0, F.lit(f"{c}: input should be greater than or equal to 0")))
    err = F.concat_ws("; ", *problems)
    return out.withColumn("error", F.when(err == "", F.lit(None).cast("string")).otherwise(err))


def predict_risk(model: PipelineModel, scenarios: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Score scenario rows (M7, E5): (scored valid rows, rejected rows with error and status 422)."""
    checked = validate_scenarios(scenarios)
    valid = checked.where(F.col("error").isNull()).drop("error")
    rejects = (checked.where(F.col("error").isNotNull())
               .withColumn("status_code", F.lit(422)).withColumnRenamed("error", "detail"))
    return score_batch(model, valid), rejects


# ---- metrics (M5) ---------------------------------------------------------------

def confusion_counts(pred: DataFrame, label_col: str = "label",
                     pred_col: str = "congestion_risk") -> DataFrame:
    return pred.groupBy(F.col(label_col).alias("actual"), F.col(pred_col).alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame, label_col: str = "label",
                     pred_col: str = "congestion_risk") -> DataFrame:
    """Rows = actual label, one column per label (sorted names), zero-filled."""
    counts = confusion_counts(pred, label_col, pred_col)
    labels = sorted(RISK_LABELS)
    present = counts.select(F.col("actual").alias("label")).union(counts.select("predicted")).distinct()
    wide = counts.groupBy("actual").pivot("predicted", labels).agg(F.sum("n"))
    out = present.join(wide, present.label == wide.actual, "left").select(
        F.col("label").alias("actual"), *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in labels])
    return out.orderBy("actual")


def classification_report(pred: DataFrame, label_col: str = "label",
                          pred_col: str = "congestion_risk") -> DataFrame:
    """Per class precision, recall, f1, support, plus accuracy, macro and weighted rows.

    A zero denominator gives 0. Everything is computed from the (actual,
    predicted) count table, at most (labels x labels) rows.
    """
    counts = confusion_counts(pred, label_col, pred_col)
    actual = counts.groupBy(F.col("actual").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))
                                           .otherwise(0)).alias("tp"))
    predicted = counts.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("n_pred"))
    classes = actual.select("cls").union(predicted.select("cls")).distinct()
    per = classes.join(actual, "cls", "left").join(predicted, "cls", "left").fillna(0)

    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    per = per.select("cls", ratio("tp", "n_pred").alias("precision"), ratio("tp", "support").alias("recall"),
                     "support", "tp")
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))) \
        .otherwise(F.lit(0.0))
    per = per.withColumn("f1_score", f1)
    total = F.sum("support")
    acc = F.sum("tp") / total
    summary = per.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("wr"),
        (F.sum(F.col("f1_score") * F.col("support")) / total).alias("wf"),
        acc.alias("acc"), total.alias("n"))
    cols = ["label", "precision", "recall", "f1_score", "support"]
    rows = per.select(F.col("cls").alias("label"), "precision", "recall", "f1_score",
                      F.col("support").cast("long").alias("support"))
    accuracy = summary.select(F.lit("accuracy").alias("label"), F.col("acc").alias("precision"),
                              F.col("acc").alias("recall"), F.col("acc").alias("f1_score"),
                              F.col("n").cast("long").alias("support"))
    macro = summary.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                           F.col("mr").alias("recall"), F.col("mf").alias("f1_score"),
                           F.col("n").cast("long").alias("support"))
    weighted = summary.select(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"),
                              F.col("wr").alias("recall"), F.col("wf").alias("f1_score"),
                              F.col("n").cast("long").alias("support"))
    return rows.select(*cols).unionByName(accuracy).unionByName(macro).unionByName(weighted)
