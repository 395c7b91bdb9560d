"""Run the whole flow on the driver tables and print each step's seconds.

usage: python tools/run_pipeline.py [sf_dir]
Raw activity CSV (from events) -> ETL (cleaned + summaries) -> warehouse
load (checked star) -> features, training, evaluation -> batch scoring.
All outputs go below the session's checkpoint folder.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from cellsight.session import create_session, scratch_path
    spark = create_session(master="local[8]", shuffle_partitions=8,
                           extra={"spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    from cellsight.plans.catalog import events_mapping, events_raw
    from cellsight.plans.etl import run_etl
    from cellsight.plans.ml import run_batch_scoring, train_and_save
    from cellsight.plans.warehouse import load_star
    from cellsight.sources.files import read_star

    root = scratch_path(spark, "pipeline")
    steps = {}

    def step(name, fn):
        t = time.perf_counter()
        out = fn()
        steps[name] = round(time.perf_counter() - t, 2)
        return out

    step("write raw csv", lambda: events_raw(spark, sf_dir).write.option("header", True).csv(f"{root}/raw"))
    paths = step("etl", lambda: run_etl(spark, f"{root}/raw/*.csv", events_mapping(spark, sf_dir), f"{root}/processed"))
    counts = step("warehouse load", lambda: load_star(spark, paths["cleaned_usage"], f"{root}/star"))
    star = read_star(spark, f"{root}/star")
    metrics = step("train + evaluate", lambda: train_and_save(star, f"{root}/model"))
    step("batch scoring", lambda: run_batch_scoring(spark, star, f"{root}/model", f"{root}/predictions"))
    print(json.dumps({"sf_dir": sf_dir, "seconds": steps, "star": counts,
                      "accuracy": metrics["accuracy"]}))


if __name__ == "__main__":
    main()
