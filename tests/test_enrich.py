
from cellsight.operators import enrich


def test_dedup_mapping_keeps_smallest_non_null(spark):
    m = spark.createDataFrame([("g1", "B", "x"), ("g1", "A", "z"), ("g1", None, "a"), ("g2", "C", None),
                               ("g2", "C", "b")], "grid_id string, region_name string, city string")
    rows = {r["grid_id"]: (r["region_name"], r["city"]) for r in enrich.dedup_mapping(m).collect()}
    assert rows == {"g1": ("A", "z"), "g2": ("C", "b")}


def test_enrich_left_join_preserves_rows(spark):
    usage = spark.createDataFrame([("g1", 1.0), ("g1", 2.0), ("g3", 3.0)], "grid_id string, call_count double")
    m = spark.createDataFrame([("g1", "A", "c"), ("g1", "B", "c")], "grid_id string, region_name string, city string")
    out = enrich.enrich_region(usage, m)
    assert out.count() == 3
    assert out.where("grid_id = 'g3'").first()["region_name"] is None
    assert enrich.enrich_region(usage, None).columns == usage.columns


def test_plan_defaults_and_lookup(spark):
    customers = spark.createDataFrame([("c1",), ("c2",)], "customer_id string")
    plans = spark.createDataFrame([("c2", "Basic", 100, None, None, None)],
                                  "customer_id string, plan_name string, data_limit_mb int, "
                                  "voice_limit_minutes int, sms_limit int, status string")
    out = {r["customer_id"]: r for r in enrich.enrich_plan(customers, plans).collect()}
    assert out["c1"]["plan_name"] == "Premium Plus" and out["c1"]["data_limit_mb"] == 25000
    assert out["c2"]["plan_name"] == "Basic" and out["c2"]["voice_limit_minutes"] == 1200
    assert enrich.enrich_plan(customers).count() == 2


def test_lookup_join_follows_the_session_threshold(spark):
    usage = spark.createDataFrame([("g1", 1.0), ("g2", 2.0), ("g3", 3.0)], "grid_id string, call_count double")
    m = spark.createDataFrame([("g1", "A", "c"), ("g2", "B", "d")], "grid_id string, region_name string, city string")
    small = sorted(tuple(r) for r in enrich.enrich_region(usage, m).collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = sorted(tuple(r) for r in enrich.enrich_region(usage, m).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert small == shuffled and len(shuffled) == 3


def test_several_plans_of_a_customer_are_one_row(spark):
    customers = spark.createDataFrame([("c1",), ("c2",)], "customer_id string")
    plans = spark.createDataFrame([("c1", "B", 1, 1, 1, "ACTIVE"), ("c1", "A", 2, 2, 2, "ACTIVE"), ("c1", None, 0, 0, 0, "X")],
                                  "customer_id string, plan_name string, data_limit_mb int, "
                                  "voice_limit_minutes int, sms_limit int, status string")
    out = {r["customer_id"]: r["plan_name"] for r in enrich.enrich_plan(customers, plans).collect()}
    assert out == {"c1": "A", "c2": "Premium Plus"}
