import os

from pyspark.sql import functions as F

from cellsight.plans.catalog import events_mapping, events_raw
from cellsight.plans.etl import run_etl
from cellsight.plans.ml import run_batch_scoring, train_and_save
from cellsight.plans.warehouse import load_star
from cellsight.sources.files import read_star

SF = "/root/testdata/sf0.001"


def test_etl_warehouse_ml(spark, tmp_dir):
    raw_dir = os.path.join(tmp_dir, "raw")
    events_raw(spark, SF).write.option("header", True).csv(raw_dir)
    paths = run_etl(spark, f"{raw_dir}/*.csv", events_mapping(spark, SF), os.path.join(tmp_dir, "processed"))
    cleaned = spark.read.parquet(paths["cleaned_usage"])
    assert cleaned.count() == 1000
    assert set(paths) >= {"calls_per_hour", "sms_per_region_day", "internet_per_day", "top_5_peak_hours",
                          "records_per_file"}
    per_file = spark.read.parquet(paths["records_per_file"])
    assert per_file.agg(F.sum("records")).first()[0] == 1000
    calls = spark.read.parquet(paths["calls_per_hour"]).agg(F.sum("total_calls")).first()[0]
    assert abs(calls - cleaned.agg(F.sum("call_count")).first()[0]) < 1e-6
    assert spark.read.parquet(paths["top_5_peak_hours"]).count() == 5

    star_dir = os.path.join(tmp_dir, "star")
    counts = load_star(spark, paths["cleaned_usage"], star_dir)
    assert counts["fact_usage"] == 1000
    assert counts["dim_region"] == cleaned.select("region_name", "city").distinct().count()
    star = read_star(spark, star_dir)
    # warehouse totals are the per-row truncated counts
    trunc = cleaned.agg(F.sum(F.col("call_count").cast("int"))).first()[0]
    assert star.fact.agg(F.sum("call_count")).first()[0] == trunc

    model_path = os.path.join(tmp_dir, "model")
    metrics = train_and_save(star, model_path, num_trees=20)
    assert 0.0 <= metrics["accuracy"] <= 1.0
    out = run_batch_scoring(spark, star, model_path, os.path.join(tmp_dir, "pred"))
    pred = spark.read.option("header", True).option("inferSchema", True).csv(out)
    assert pred.count() == counts["dim_region"]
    assert {"region_name", "congestion_risk", "score", "anomaly_flag"} <= set(pred.columns)


def test_ingest_accepts_valid_new_files(spark, tmp_dir):
    from cellsight.plans.ingest import run_ingest
    landing, raw = os.path.join(tmp_dir, "landing"), os.path.join(tmp_dir, "raw")
    os.makedirs(landing)
    os.makedirs(raw)
    head = "timestamp,grid_id,call_count,sms_count,internet_usage\n"
    files = {"a.csv": head + "2013-11-01 10:00:00,1,2,3,4.5\n2013-11-01 11:00:00,2,1,1,1\n",
             "b.csv": head + "2013-11-01 12:00:00,1,NA,3,4\n",
             "c.csv": head + "2013-11-02 09:00:00,3,1,1,1\n"}
    for name, text in files.items():
        with open(os.path.join(landing, name), "w") as fh:
            fh.write(text)
    with open(os.path.join(raw, "c.csv"), "w") as fh:
        fh.write(files["c.csv"])
    mapping = spark.createDataFrame([("1", "North", "Milan")], "grid_id string, region_name string, city string")
    out = os.path.join(tmp_dir, "out")
    counts = run_ingest(spark, f"{landing}/*.csv", f"{raw}/*.csv", mapping, out)
    assert counts == {"accepted": 1, "rejected": 1, "duplicate": 1}
    from cellsight.plans.ingest import read_ingested, read_manifest
    cleaned = read_ingested(spark, out)
    assert cleaned.count() == 2
    assert cleaned.where("grid_id = '1'").first()["region_name"] == "North"
    # The same folder again, then with a new file: accepted files are loaded once.
    assert run_ingest(spark, f"{landing}/*.csv", f"{raw}/*.csv", mapping, out) == {"rejected": 1, "duplicate": 2}
    assert read_ingested(spark, out).count() == 2
    with open(os.path.join(landing, "d.csv"), "w") as fh:
        fh.write(files["c.csv"])
    assert run_ingest(spark, f"{landing}/*.csv", f"{raw}/*.csv", mapping, out)["accepted"] == 1
    assert read_ingested(spark, out).count() == 3
    assert read_manifest(spark, out).count() == 10


def test_ingest_reads_each_file_by_its_header_and_name(spark, tmp_dir):
    from cellsight.plans.ingest import read_ingested, run_ingest
    landing = os.path.join(tmp_dir, "landing")
    os.makedirs(landing)
    long_text = "x" * 140_000
    files = {"a.csv": "timestamp,grid_id,call_count,sms_count,internet_usage\n2013-11-01 10:00:00,1,2,3,4.5\n",
             "b.csv": "grid_id,Timestamp,internet_usage,sms_count,call_count\n2,2013-11-02 10:00:00,5,6,7\n",
             "c d.csv": "timestamp,grid_id,call_count,sms_count,internet_usage\n2013-11-03 10:00:00,3,1,1,1\n",
             "p%41.csv": "timestamp,grid_id,call_count,sms_count,internet_usage,note\n2013-11-04 10:00:00,4,1,1,1,\"a,\"\"b\"\"\"\n",
             "long.csv": "timestamp,grid_id,call_count,sms_count,internet_usage,note\n"
                         f"2013-11-05 10:00:00,5,1,1,1,{long_text}\n"}
    for name, text in files.items():
        with open(os.path.join(landing, name), "w") as fh:
            fh.write(text)
    out = os.path.join(tmp_dir, "out")
    assert run_ingest(spark, f"{landing}/*.csv", None, None, out) == {"accepted": 5}
    rows = {r["grid_id"]: (r["call_count"], r["sms_count"], r["internet_usage"], str(r["event_date"]))
            for r in read_ingested(spark, out).collect()}
    assert rows == {"1": (2.0, 3.0, 4.5, "2013-11-01"), "2": (7.0, 6.0, 5.0, "2013-11-02"),
                    "3": (1.0, 1.0, 1.0, "2013-11-03"), "4": (1.0, 1.0, 1.0, "2013-11-04"),
                    "5": (1.0, 1.0, 1.0, "2013-11-05")}


def test_ingest_takes_any_name_and_quoted_line_breaks(spark, tmp_dir, monkeypatch):
    from cellsight.plans import ingest
    monkeypatch.setattr(ingest, "PATHS_AT_ONCE", 2)
    head = "timestamp,grid_id,call_count,sms_count,internet_usage,note\n"
    for i, name in enumerate(["[a].csv", "{b,c}.csv", "d*.csv", "e\\f.csv", "g?.csv"]):
        with open(os.path.join(tmp_dir, name), "w") as fh:
            fh.write(head + f'2013-11-01 10:00:00,{i},1,2,3,"two\nlines"\n2013-11-01 11:00:00,{i},1,2,3,\n')
    out = os.path.join(tmp_dir, "out")
    assert ingest.run_ingest(spark, f"{tmp_dir}/*.csv", None, None, out, quoted_newlines=True) == {"accepted": 5}
    got = sorted((r["grid_id"], r["hour"]) for r in ingest.read_ingested(spark, out).collect())
    assert got == [(str(i), h) for i in range(5) for h in (10, 11)]


def test_runs_are_compacted_without_a_change_for_readers(spark, tmp_dir):
    from cellsight.plans import ingest
    head = "timestamp,grid_id,call_count,sms_count,internet_usage\n"
    out, landing = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "landing")
    os.makedirs(landing)

    def run(i):
        with open(f"{landing}/f{i}.csv", "w") as fh:
            fh.write(head + "".join(f"2013-11-0{d} 10:00:00,{i},1,2,3\n" for d in (1, 2)))
        ingest.run_ingest(spark, f"{landing}/*.csv", None, None, out)

    rows = lambda: sorted(map(str, ingest.read_ingested(spark, out).collect()))
    folders = lambda: [r["run_id"] for r in ingest.current_runs(spark, out).collect()]
    for i in range(4):
        run(i)
    before = rows()
    assert len(before) == 8 and len(folders()) == 4
    # A merged folder without its entry, as after a crash, changes nothing.
    merged_only = ingest.read_ingested(spark, out)
    ingest.write_cleaned(merged_only, f"{out}/cleaned_usage/run_id=c-crashed")
    assert rows() == before
    merged = ingest.compact_runs(spark, out)
    assert folders() == [merged] and rows() == before and ingest.compact_runs(spark, out) is None
    days = {os.path.dirname(f) for f in ingest.read_ingested(spark, out).inputFiles() if merged in f}
    assert len(days) == 2
    # Names taken before the compaction stay taken; later runs add to it, and it is merged again.
    run(4)
    assert len(rows()) == 10 and sorted(folders()) == sorted([merged, *[f for f in folders() if f != merged]])
    ingest.compact_runs(spark, out)
    assert len(rows()) == 10 and len(folders()) == 1
    assert ingest.remove_replaced(spark, out) == 6 and len(rows()) == 10


def test_scratch_tables_are_cleared(spark, monkeypatch):
    from cellsight import session
    monkeypatch.setattr(session, "_SCRATCH", [])
    df = session.materialize(spark.range(3), "scratch-test")
    path = session._SCRATCH[0]
    assert df.count() == 3 and session.clear_scratch(spark) == 1
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)
