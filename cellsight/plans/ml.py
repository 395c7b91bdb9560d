"""Features -> labels -> split -> train -> evaluate -> save; and batch scoring (§3.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsight.operators._util import require_nonempty
from cellsight.operators.features import build_features
from cellsight.operators.risk import (check_split_classes, classification_report, confusion_matrix,
                                      label_risk, score_batch, stratified_split, train_risk_model)
from cellsight.operators.star import Star
from cellsight.sinks import load_model, save_model, write_predictions


def train_and_evaluate(features: DataFrame, num_trees: int = 200, seed: int = 42):
    """Label, split, fit and evaluate; returns (model, metrics dict of DataFrames)."""
    labelled = label_risk(features).persist()
    try:
        check_split_classes(labelled)
        split = stratified_split(labelled, 0.2, seed)
        model = train_risk_model(split.where(F.col("split") == "train"), num_trees, seed)
        test_pred = model.transform(split.where(F.col("split") == "test"))
        metrics = {
            "report": classification_report(test_pred),
            "confusion_matrix": confusion_matrix(test_pred),
        }
        return model, metrics
    finally:
        labelled.unpersist()


def train_and_save(star: Star, model_path: str, num_trees: int = 200, seed: int = 42) -> dict:
    """M1 -> M2 -> M3 -> M4 -> M5 -> K5; returns the metrics collected (a few rows)."""
    features = build_features(star)
    require_nonempty(features, "warehouse data for feature engineering")
    model, metrics = train_and_evaluate(features, num_trees, seed)
    save_model(model, model_path)
    report = {r["label"]: r.asDict() for r in metrics["report"].collect()}
    matrix = [r.asDict() for r in metrics["confusion_matrix"].collect()]
    return {"accuracy": report.get("accuracy", {}).get("precision"), "report": report,
            "confusion_matrix": matrix}


def run_batch_scoring(spark: SparkSession, star: Star, model_path: str, output_path: str) -> str:
    """M1 -> S9 -> M6 -> K4."""
    scored = score_batch(load_model(model_path), build_features(star))
    write_predictions(scored, output_path)
    return output_path
