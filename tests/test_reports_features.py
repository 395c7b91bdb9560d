import pytest
from pyspark.sql import functions as F

from cellsight.operators import features, reports, star


def make_star(spark, rows):
    df = spark.createDataFrame(rows, "grid_id string, call_count double, sms_count double, "
                                     "internet_usage double, ts string, region_name string, city string")
    df = (df.withColumn("event_timestamp", F.col("ts").cast("timestamp_ntz")).drop("ts")
          .withColumn("event_date", F.to_date("event_timestamp")).withColumn("hour", F.hour("event_timestamp")))
    return star.build_star(df)


def test_ties_break_by_key(spark):
    # D-2: equal totals in two hours -> the smaller hour first.
    s = make_star(spark, [("g", 5.0, 0.0, 0.0, "2013-11-01 03:00:00", "A", "X"),
                          ("g", 5.0, 0.0, 0.0, "2013-11-01 01:00:00", "B", "X"),
                          ("g", 1.0, 0.0, 0.0, "2013-11-01 02:00:00", "A", "X")])
    assert [r["hour"] for r in reports.usage_by_hour(s, 2).collect()] == [1, 3]
    summary = reports.usage_summary(s, 3).first()
    assert summary["top_peak_hours"] == [1, 3, 2]
    assert summary["top_busiest_regions"] == ["A", "B"]
    assert summary["total_calls"] == 11


def test_region_match_ignores_case(spark):
    # names equal up to case are one region in the region reports.
    s = make_star(spark, [("g1", 1.0, 0.0, 0.0, "2013-11-01 03:00:00", "Milan", "X"),
                          ("g2", 3.0, 0.0, 0.0, "2013-11-01 03:00:00", "MILAN", "Y")])
    hourly = reports.region_hourly(s, "milan").collect()
    assert [(r["hour"], r["calls"]) for r in hourly] == [(3, 4.0)]
    feats = features.region_features(s, "milan").collect()
    assert len(feats) == 1 and feats[0]["region"] == "milan"
    with pytest.raises(LookupError):
        reports.region_usage_or_raise(s, "rome")
    with pytest.raises(LookupError):
        features.region_features_or_raise(s, "rome")


def test_empty_totals_are_zero(spark):
    s = make_star(spark, [("g1", 1.0, 0.0, 0.0, "2013-11-01 03:00:00", "A", "X")])
    empty = star.Star(s.dim_time, s.dim_region, s.fact.limit(0))
    r = reports.summary_totals(empty).first()
    assert (r["total_calls"], r["total_sms"], r["total_internet_mb"]) == (0, 0, 0.0)


def test_growth_variability_peak(spark):
    # One-day region -> variability 0; W2: zero day before a positive day -> growth 0;
    # A gap day is skipped (previous present day).
    rows = [("a", 10.0, 0.0, 0.0, "2013-11-01 01:00:00", "One", "X"),
            ("b", 0.0, 0.0, 0.0, "2013-11-01 01:00:00", "Two", "X"),
            ("b", 4.0, 0.0, 0.0, "2013-11-02 01:00:00", "Two", "X"),
            ("b", 8.0, 0.0, 0.0, "2013-11-04 02:00:00", "Two", "X")]
    s = make_star(spark, rows)
    f = {r["region_name"]: r for r in features.build_features(s).collect()}
    assert f["One"]["variability"] == 0.0 and f["One"]["growth_rate"] == 0.0 and f["One"]["peak_ratio"] == 1.0
    # daily totals 0, 4, 8: growth 0 (first), 0 (prev 0), (8-4)/4 = 1 -> mean 1/3
    assert f["Two"]["avg_usage"] == pytest.approx(4.0)
    assert f["Two"]["growth_rate"] == pytest.approx(1 / 3)
    assert f["Two"]["variability"] == pytest.approx(4.0)
    # hourly totals: hour1 = 4, hour2 = 8 -> max / mean = 8 / 6
    assert f["Two"]["peak_ratio"] == pytest.approx(8 / 6)


def test_region_reports_add_up_to_totals(spark):
    # SURVEY §5 invariant: E2 hourly sums over every region = A12 totals.
    from cellsight.plans.catalog import events_star
    s = events_star(spark, "/root/testdata/sf0.001")
    totals = reports.summary_totals(s).first()
    calls = sms = inet = 0.0
    for r in s.dim_region.select("region_name").distinct().collect():
        part = reports.region_usage(s, r["region_name"]).where("kind = 'hourly_distribution'")
        agg = part.agg(F.sum("calls"), F.sum("sms"), F.sum("internet_mb")).first()
        calls, sms, inet = calls + agg[0], sms + agg[1], inet + agg[2]
    assert calls == totals["total_calls"] and sms == totals["total_sms"]
    assert inet == pytest.approx(totals["total_internet_mb"], rel=1e-12)
