"""A saved risk forest as a table of nodes, and scoring as joins with it.

The table (a row per node of every tree) is what can be read of a model
without Spark ML, by any engine; scoring with it is a second, independent
way to the model's probabilities, which the tests and the registered queries
compare with ``transform`` row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsight.schemas import FEATURE_COLUMNS, RISK_LABELS
from cellsight.session import materialize

TIE = 1e-9  # probabilities closer than this may be told apart by the order of their sums alone


def forest_nodes(spark: SparkSession, model_path: str) -> DataFrame:
    """(tree, node, feature, threshold, below, above, counts) of a model saved by :func:`cellsight.sinks.save_model`.

    A row goes to ``below`` if its feature is at most the threshold. Leaves
    have no children; ``counts`` are the training rows of each label there.
    """
    stored = spark.read.parquet(f"{model_path}/stages/1_*/data")
    leaf = F.col("n.leftChild") < 0
    inner = lambda c: F.when(~leaf, c)
    return stored.select(F.col("treeID").alias("tree"), F.col("nodeData").alias("n")).select(
        "tree", F.col("n.id").alias("node"), inner(F.col("n.split.featureIndex")).alias("feature"),
        inner(F.get("n.split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        inner(F.col("n.leftChild")).alias("below"), inner(F.col("n.rightChild")).alias("above"),
        F.col("n.impurityStats").alias("counts"))


def node_probabilities(nodes: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, p_low, p_medium, p_high) of every row of features.

    Each row stands at the root of every tree and moves down by one join per
    level; a round is written out, so the plan does not grow with the depth.
    """
    trees = nodes.agg(F.max("tree")).first()[0] + 1
    at = rows.select(key, F.array(*[F.col(c).cast("double") for c in FEATURE_COLUMNS]).alias("x"),
                     F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(0).alias("node"))
    reached = None
    while True:
        met = materialize(at.join(nodes, ["tree", "node"]), "forest-level")
        leaves = met.where(F.col("below").isNull()).select(key, "counts")
        reached = leaves if reached is None else reached.unionByName(leaves)
        inner = met.where(F.col("below").isNotNull())
        if inner.isEmpty():
            break
        goes_below = F.get("x", F.col("feature")) <= F.col("threshold")
        at = inner.select(key, "x", "tree", F.when(goes_below, F.col("below")).otherwise(F.col("above")).alias("node"))
    total = F.aggregate("counts", F.lit(0.0), lambda s, c: s + c)
    return reached.groupBy(key).agg(*[
        (F.sum(F.get("counts", F.lit(i)) / total) / trees).alias(f"p_{label.lower()}") for i, label in enumerate(RISK_LABELS)])


def score_differences(scored: DataFrame, probabilities: DataFrame, key: str, anomaly_score: float) -> DataFrame:
    """(key, class_ok, score_ok, flag_ok): whether label, score and flag of every scored row follow from the node table."""
    shares = F.array(*[F.col(f"p_{x.lower()}") for x in RISK_LABELS])
    own = F.get(shares, F.array_position(F.array(*[F.lit(x) for x in RISK_LABELS]), F.col("congestion_risk")).cast("int") - 1)
    top = F.array_max(shares)
    flag = (F.col("congestion_risk") == "HIGH") & (top > anomaly_score)
    checked = scored.join(probabilities, key, "left")
    return checked.select(
        key, F.coalesce(own >= top - TIE, F.lit(False)).alias("class_ok"),
        F.coalesce(F.abs(F.col("score") - top) <= 0.00005 + TIE, F.lit(False)).alias("score_ok"),
        F.coalesce((F.col("anomaly_flag").cast("boolean") == flag) | (F.abs(top - anomaly_score) <= TIE), F.lit(False)).alias("flag_ok"))
