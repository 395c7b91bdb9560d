import os

import pytest
from pyspark.sql import functions as F

from cellsight.operators import features, reports, star
from cellsight.plans import catalog, warehouse
from cellsight.sinks import snapshots, write_cleaned, write_star
from cellsight.sources.files import read_star

CLEANED = ("grid_id string, call_count double, sms_count double, internet_usage double, "
           "event_timestamp timestamp_ntz, event_date date, hour int, region_name string, city string")


def cleaned(spark, rows):
    df = spark.createDataFrame(rows, "grid_id string, call_count double, sms_count double, "
                                     "internet_usage double, ts string, region_name string, city string")
    return (df.withColumn("event_timestamp", F.col("ts").cast("timestamp_ntz")).drop("ts")
            .withColumn("event_date", F.to_date("event_timestamp"))
            .withColumn("hour", F.hour("event_timestamp")))


def test_truncation_defaults_and_keys(spark):
    df = cleaned(spark, [
        ("g1", 0.9, 2.7, 1.5, "2013-11-01 10:00:00", "A", "X"),
        ("g2", 2.7, 0.9, 1.5, "2013-11-01 10:30:00", None, None),  # D-4: region -> grid, city -> Unknown
    ])
    s = star.build_star(df)
    facts = sorted((r["call_count"], r["sms_count"]) for r in s.fact.collect())
    assert facts == [(0, 2), (2, 0)]
    regions = {(r["region_name"], r["city"]) for r in s.dim_region.collect()}
    assert regions == {("A", "X"), ("g2", "Unknown")}
    t = s.dim_time.collect()
    assert len(t) == 1 and t[0]["weekday"] == "Friday" and (t[0]["day"], t[0]["month"]) == (1, 11)
    assert all(r["violations"] == 0 for r in star.star_checks(s).collect())


def test_missing_region_columns(spark):
    df = cleaned(spark, [("g1", 1.0, 1.0, 1.0, "2013-11-01 10:00:00", "A", "X")]).drop("region_name", "city")
    assert [(r["region_name"], r["city"]) for r in star.build_star(df).dim_region.collect()] == [("g1", "Unknown")]


def test_equal_rows_get_distinct_ids(spark):
    # D-1: two equal rows in one hour, plus rows equal only to 4 decimals.
    rows = [("g1", 1.0, 1.0, 2.0, "2013-11-01 10:00:00", "A", "X")] * 2 + [
        ("g2", 1.0, 1.0, 2.0, "2013-11-01 10:10:00", "A", "X"),
        ("g3", 1.0, 1.0, 2.00001, "2013-11-01 10:20:00", "A", "X"),
        ("g4", 1.0, 1.0, 2.000012, "2013-11-01 10:20:00", "A", "X")]
    s = star.build_star(cleaned(spark, rows))
    ids = [r["usage_id"] for r in s.fact.collect()]
    assert len(ids) == 5 and len(set(ids)) == 5
    assert all(r["violations"] == 0 for r in star.star_checks(s).collect())


def test_chunked_expansion_matches(spark):
    # A hot group of copies is cut into chunks expanded by separate tasks.
    rows = [("g1", 1.0, 2.0, 3.0, "2013-11-01 10:00:00", "A", "X")] * 25 + \
           [("g2", 1.0, 2.0, 3.0, "2013-11-01 11:00:00", "A", "X")] * 3
    base = star.usage_counts(star.prepare_usage(cleaned(spark, rows)))
    plain = sorted(tuple(r) for r in star.fact_usage(base).collect())
    chunked = sorted(tuple(r) for r in star.fact_usage(base, chunk_rows=4).collect())
    assert plain == chunked and len({r[0] for r in plain}) == 28


def test_checks_detect_violations(spark):
    s = star.build_star(cleaned(spark, [("g1", 1.0, 1.0, 1.0, "2013-11-01 10:00:00", "A", "X")]))
    broken = star.Star(s.dim_time.limit(0), s.dim_region.unionByName(s.dim_region), s.fact)
    res = {(r["check_name"], r["target"]): r["violations"] for r in star.star_checks(broken).collect()}
    assert res[("foreign_key", "fact_usage.time_id")] == 1
    assert res[("primary_key", "dim_region.region_id")] == 1
    with pytest.raises(ValueError):
        star.assert_star_valid(broken)


def test_hot_group_is_expanded_by_several_tasks(spark):
    # A group of copies is cut into chunks; the chunks are spread before expansion.
    rows = [("g1", 1.0, 2.0, 3.0, "2013-11-01 10:00:00", "A", "X")] * 40 + \
           [("g2", 5.0, 2.0, 3.0, "2013-11-01 11:00:00", "A", "X")]
    base = star.usage_counts(star.prepare_usage(cleaned(spark, rows)))
    fact = star.fact_usage(base, chunk_rows=4).withColumn("task", F.spark_partition_id())
    hot = fact.where("call_count = 1").collect()
    assert len(hot) == 40 and len({r["usage_id"] for r in hot}) == 40
    assert len({r["task"] for r in hot}) >= 2


def test_shared_ids_are_told_apart(spark):
    rows = [(7, 1, 1, 5, 0, 1.0), (7, 1, 1, 4, 0, 1.0), (7, 2, 1, 5, 0, 1.0), (8, 1, 1, 5, 0, 1.0)]
    fact = spark.createDataFrame(rows, "usage_id long, time_id long, region_id long, call_count long, sms_count long, "
                                       "internet_mb double")
    got = sorted(tuple(r) for r in star.resolve_key_collisions(fact).collect())
    assert got == sorted([(7, 1, 1, 4, 0, 1.0), (7 + (1 << 60), 1, 1, 5, 0, 1.0), (7 + (2 << 60), 2, 1, 5, 0, 1.0),
                          (8, 1, 1, 5, 0, 1.0)])


def test_large_measures_load(spark):
    rows = [("g1", 3e9, 1e30, 1e15, "2013-11-01 10:00:00", "A", "X"), ("g1", 1.0, 2.0, 1e300, "2013-11-01 10:00:00", "A", "X")]
    fact = {r["call_count"]: r for r in star.build_star(cleaned(spark, rows)).fact.collect()}
    assert fact[3_000_000_000]["sms_count"] == (1 << 63) - 1 and fact[3_000_000_000]["internet_mb"] == 1e15
    assert fact[1]["internet_mb"] == 1e300


def test_failed_check_keeps_the_old_star(spark, tmp_dir, monkeypatch):
    path, out = os.path.join(tmp_dir, "cleaned"), os.path.join(tmp_dir, "star")
    write_cleaned(cleaned(spark, [("g1", 1.0, 1.0, 2.0, "2013-11-01 10:00:00", "A", "X")]), path)
    assert warehouse.load_star(spark, path, out)["fact_usage"] == 1

    def broken(star):
        raise ValueError("star constraints violated")
    monkeypatch.setattr(warehouse, "assert_star_valid", broken)
    write_cleaned(cleaned(spark, [("g1", 1.0, 1.0, 2.0, "2013-11-01 10:00:00", "A", "X")] * 3), path)
    with pytest.raises(ValueError):
        warehouse.load_star(spark, path, out)
    assert read_star(spark, out).fact.count() == 1


def _published(spark, out):
    """Everything a reader of the star sees, as comparable rows."""
    return [sorted(map(repr, df.select(*sorted(df.columns)).collect())) for df in read_star(spark, out)]


def _days(spark, path, rows):
    write_cleaned(cleaned(spark, rows), path)


DAY1 = [("g1", 1.0, 1.0, 2.0, "2013-11-01 10:00:00", "A", "X")] * 3 + [("g2", 4.0, 0.0, 1.5, "2013-11-01 11:00:00", "B", "X")]
DAY2 = [("g1", 2.0, 1.0, 2.0, "2013-11-02 10:00:00", "A", "X"), ("g3", 2.0, 1.0, 2.0, "2013-11-02 10:00:00", "C", None)]
DAY3 = [("g1", 7.0, 1.0, 2.0, "2013-11-03 23:00:00", "A", "Y")]


def test_a_day_loaded_alone_gives_the_star_of_a_full_load(spark, tmp_dir):
    path, out = os.path.join(tmp_dir, "cleaned"), os.path.join(tmp_dir, "star")
    _days(spark, path, DAY1 + DAY2)
    warehouse.load_star(spark, path, out, days=["2013-11-01"])          # the first load takes all days
    assert read_star(spark, out).fact.count() == 6
    # The second day changes, the third comes.
    changed = [DAY2[0], ("g9", 1.0, 1.0, 1.0, "2013-11-02 10:00:00", "D", "Z")]
    _days(spark, path, DAY1 + changed + DAY3)
    first_day = [f for f in read_star(spark, out, ("2013-11-01", "2013-11-01")).fact.inputFiles()]
    counts = warehouse.load_star(spark, path, out, days=["2013-11-02", "2013-11-03"])
    assert counts == {"dim_time": 4, "dim_region": 4, "fact_usage": 7}
    by_day = _published(spark, out)
    assert first_day == [f for f in read_star(spark, out, ("2013-11-01", "2013-11-01")).fact.inputFiles()]
    warehouse.load_star(spark, path, f"{out}_full")
    assert by_day == _published(spark, f"{out}_full")
    # The first day goes, and its regions with it.
    _days(spark, path, changed + DAY3)
    warehouse.load_star(spark, path, out, days=["2013-11-01"])
    warehouse.load_star(spark, path, f"{out}_full")
    assert _published(spark, out) == _published(spark, f"{out}_full")
    assert {r["region_name"] for r in read_star(spark, out).dim_region.collect()} == {"A", "D"}
    before = _published(spark, out)
    assert warehouse.remove_old_loads(spark, out) > 0 and _published(spark, out) == before


def test_keys_shared_by_days_are_told_apart_as_in_a_full_load(spark, tmp_dir, monkeypatch):
    """With keys of two values almost all rows of all days share one."""
    monkeypatch.setattr(star, "surrogate_key", lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(2)))
    monkeypatch.setattr(star, "time_key", lambda: F.xxhash64("date", "hour"))
    monkeypatch.setattr(star, "region_key", lambda: F.xxhash64("region_name", "city"))
    monkeypatch.setattr(warehouse, "region_key", star.region_key)
    path, out = os.path.join(tmp_dir, "cleaned"), os.path.join(tmp_dir, "star")
    _days(spark, path, DAY1[2:] + DAY3)
    warehouse.load_star(spark, path, out)
    _days(spark, path, DAY1[2:] + DAY2 + DAY3)
    warehouse.load_star(spark, path, out, days=["2013-11-02"])
    warehouse.load_star(spark, path, f"{out}_full")
    assert _published(spark, out) == _published(spark, f"{out}_full")
    ids = [r["usage_id"] for r in read_star(spark, out).fact.collect()]
    assert len(set(ids)) == 5 and any(i >> 60 for i in ids)


def test_a_load_that_dies_leaves_the_old_star_whole(spark, tmp_dir, monkeypatch):
    """The load is stopped before each of its writes in turn, the pointer file included."""
    path, out = os.path.join(tmp_dir, "cleaned"), os.path.join(tmp_dir, "star")
    _days(spark, path, DAY1)
    warehouse.load_star(spark, path, out)
    before = _published(spark, out)
    _days(spark, path, DAY1 + DAY2)
    writers = ["materialize", "materialize", "write_days", "write_days", "write_days", "write_days", "assert_star_valid", "publish"]
    for last in range(len(writers)):
        done = []

        def stopping(name, step, last=last, done=done):
            def run(*args, **kwargs):
                if len(done) == last:
                    raise InterruptedError
                done.append(name)
                return step(*args, **kwargs)
            return run

        with monkeypatch.context() as m:
            for name in set(writers[:-1]):
                m.setattr(warehouse, name, stopping(name, getattr(warehouse, name)))
            m.setattr(snapshots, "publish", stopping("publish", snapshots.publish))
            with pytest.raises(InterruptedError):
                warehouse.load_star(spark, path, out, days=["2013-11-02"])
        assert done == writers[:last]
        if last % 3 == 1:
            assert _published(spark, out) == before
    # A pointer file that was not written to its end is passed over, and the next load takes the next number.
    with open(f"{out}/_versions/{2:012d}", "w") as fh:
        fh.write('{"days": {}, "loads"')
    assert _published(spark, out) == before
    warehouse.load_star(spark, path, out, days=["2013-11-02"])
    assert read_star(spark, out).fact.count() == 6 and len(snapshots.current(spark, out)["loads"]) == 2


def test_a_reader_keeps_its_version_and_two_loads_cannot_take_one_number(spark, tmp_dir, monkeypatch):
    path, out = os.path.join(tmp_dir, "cleaned"), os.path.join(tmp_dir, "star")
    _days(spark, path, DAY1)
    warehouse.load_star(spark, path, out)
    reader = read_star(spark, out)
    _days(spark, path, DAY1 + DAY2)
    warehouse.load_star(spark, path, out)
    assert reader.fact.count() == 4 and reader.dim_region.count() == 2 and read_star(spark, out).fact.count() == 6
    stale = snapshots._pointers(spark, out)[1:]
    monkeypatch.setattr(snapshots, "_pointers", lambda *_: stale)
    with pytest.raises(Exception, match="already exists"):
        snapshots.publish(spark, out, {"days": {}, "loads": {}})


def test_reports_read_the_rollup_and_equal_those_from_the_fact_table(spark, tmp_dir):
    path, out = os.path.join(tmp_dir, "cleaned"), os.path.join(tmp_dir, "star")
    _days(spark, path, DAY1 + DAY2 + DAY3)
    warehouse.load_star(spark, path, out)
    stored = read_star(spark, out)
    plain = stored._replace(hourly=None)
    for report in (reports.summary_totals, reports.usage_by_hour, reports.usage_by_region, reports.region_hour_calls,
                   reports.usage_summary, reports.peak_traffic, features.build_features,
                   lambda s: reports.region_usage(s, "a"), lambda s: reports.region_trend(s, "a"),
                   lambda s: reports.region_hourly(s, "A"), lambda s: features.region_features(s, "a")):
        got, want = report(stored), report(plain)
        assert got.dtypes == want.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        assert not any("fact_usage" in f for f in got.inputFiles())


def test_facts_come_in_order_and_are_written_unsorted(spark, tmp_dir):
    # Sorting the expanded rows spilled most of a large fact table; the counts are sorted instead.
    rows = [(f"g{i % 7}", float(i % 5), 1.0, float(i % 11), f"2013-11-0{1 + i % 3} {i % 24:02d}:00:00", f"R{i % 4}", "X")
            for i in range(600)]
    base = star.usage_counts(star.prepare_usage(cleaned(spark, rows)))
    for chunk in (1, 1_000_000):
        fact = star.fact_usage(base, chunk_rows=chunk).withColumn("task", F.spark_partition_id())
        last = {}
        for r in fact.collect():
            key = (r["region_id"], r["time_id"])
            assert last.get(r["task"], key) <= key
            last[r["task"]] = key
    write_star(star.build_star(cleaned(spark, rows), reliable_base=True), tmp_dir)
    assert read_star(spark, tmp_dir).fact.count() == 600


def test_rows_are_dealt_out_before_they_are_counted(spark):
    # One scan task with many different rows: its counts are made by several tasks.
    usage = (spark.range(0, 20_000, 1, 1).select(F.lit("2013-11-01").cast("date").alias("date"), F.lit(1).alias("hour"),
             F.lit("A").alias("region_name"), F.lit("X").alias("city"), F.col("id").alias("call_count"),
             F.lit(1).cast("bigint").alias("sms_count"), F.lit(1.0).alias("internet_mb")))
    twice = usage.unionByName(usage)
    plan = star.usage_counts(twice)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") == 1 and plan.find("partial_count") < plan.find("REPARTITION_BY_COL")
    got = star.usage_counts(twice)
    assert (got.count(), got.agg(F.sum("n")).first()[0], got.where("n != 2").count()) == (20_000, 40_000, 0)


def test_stored_lookup_is_broadcast(spark, tmp_dir):
    # A lookup joined from several tables had no known size, and all usage rows were shuffled to meet it.
    spark.range(50).selectExpr("id l_orderkey", "id % 5 l_suppkey", "1 l_linenumber", "1D l_quantity", "2D l_extendedprice",
                               "timestamp_ntz'2013-11-01 00:00:00' l_shipdate").write.parquet(f"{tmp_dir}/lineitem.parquet")
    spark.range(5).selectExpr("id s_suppkey", "1 s_nationkey").write.parquet(f"{tmp_dir}/supplier.parquet")
    spark.sql("SELECT 1 n_nationkey, 'N' n_name, 2 n_regionkey").write.parquet(f"{tmp_dir}/nation.parquet")
    spark.sql("SELECT 2 r_regionkey, 'R' r_name").write.parquet(f"{tmp_dir}/region.parquet")
    found = catalog.lineitem_cleaned(spark, tmp_dir)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().sparkPlan().toString()
    assert {tuple(r) for r in found.select("region_name", "city").collect()} == {("N", "R")} and found.count() == 50
