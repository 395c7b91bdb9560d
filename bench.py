"""

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints ONE JSON line:
{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}

Each query runs 3 times in a warm session; the median is reported. Results
are forced with the no-op sink (full computation, nothing collected), except
where the operation itself writes (star build, model fit).

Data: the usage adapters over ``lineitem`` (grid = supplier, region = its
nation) and over ``events`` (raw text layout through the full cleaning).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    from cellsight.session import create_session, scratch_path
    spark = create_session("cellsight-bench", master=f"local[{CPUS}]", shuffle_partitions=int(CPUS),
                           extra={"spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")

    from pyspark.sql import functions as F

    from cellsight.operators import features, quality, reports, risk, rollups, star
    from cellsight.plans.catalog import events_enriched, lineitem_cleaned
    from cellsight.sinks import write_star
    from cellsight.sources.files import read_star

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    # Inputs shared by the timed steps.
    usage = lineitem_cleaned(spark, SF_DIR)
    star_path = scratch_path(spark, "bench-star")
    write_star(star.build_star(usage, reliable_base=True), star_path)
    stored = read_star(spark, star_path)
    feats = features.build_features(stored).persist()
    feats.count()
    labelled = risk.label_risk(feats)
    split = risk.stratified_split(labelled).persist()
    split.count()
    model = risk.train_risk_model(split.where(F.col("split") == "train"), 200)

    def etl_events():
        noop(events_enriched(spark, SF_DIR))

    def rollups_a2_a5():
        # As the ETL plan does: one shared (date, hour, grid) pass, persisted
        # while the four summaries read it.
        base = rollups.hourly_grid_base(usage).persist()
        try:
            for df in rollups.compute_summaries(base).values():
                noop(df)
        finally:
            base.unpersist()

    def star_t1_t3():
        write_star(star.build_star(usage, reliable_base=True), scratch_path(spark, "bench-star-run"))

    def flagship_a17():
        noop(reports.region_hour_calls(stored, 10))

    def summary_e1():
        noop(reports.usage_summary(stored))

    def region_e2():
        noop(reports.region_usage(stored, "nation_3"))

    def profile_q6b():
        noop(quality.profile_columns(usage))

    def features_m1():
        noop(features.build_features(stored))

    def train_m4():
        risk.train_risk_model(split.where(F.col("split") == "train"), 200)

    def score_m6():
        noop(risk.score_batch(model, feats))

    steps = {
        "etl_clean_enrich_events": etl_events,
        "rollups_A2_A5": rollups_a2_a5,
        "star_build_T1_T3": star_t1_t3,
        "flagship_A17": flagship_a17,
        "summary_E1": summary_e1,
        "region_usage_E2": region_e2,
        "profile_Q6b": profile_q6b,
        "features_M1": features_m1,
        "train_M4": train_m4,
        "score_M6": score_m6,
    }
    results = {}
    for name, fn in steps.items():
        fn()  # warm-up
        times = []
        for _ in range(RUNS):
            t = time.perf_counter()
            fn()
            times.append(time.perf_counter() - t)
        results[name] = round(statistics.median(times), 3)

    match = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "sf": float(match.group(1)) if match else SF_DIR,
        "spark": spark.version,
        "cpus": int(CPUS),
        "runs": RUNS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
