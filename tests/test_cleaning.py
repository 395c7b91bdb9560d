import math
import os

from pyspark.sql import functions as F

from cellsight.operators import cleaning
from cellsight.sources.files import read_raw_activity

RAW_HEADER = "datetime,CellID,countrycode,smsin,smsout,callin,callout,internet\n"


def write(path, text):
    with open(path, "w") as fh:
        fh.write(text)


def test_raw_csv_binds_by_position_and_cleans(spark, tmp_dir):
    # S1/P1-P7/F1/F2/D-11: bad timestamp dropped, null grid dropped, short row
    # padded with nulls, 'abc' -> null -> 0, NaN -> 0.
    write(os.path.join(tmp_dir, "a.csv"),
          "DT,CELL,CC,A,B,C,D,E\n"
          "2013-11-01 10:15:00,7,39,1.5,0.5,2.0,1.0,10.0\n"
          "not a time,7,39,1,1,1,1,1\n"
          "2013-11-01 11:00:00,,39,1,1,1,1,1\n"
          "2013-11-01 12:00:00,8,39\n"
          "2013-11-01 13:00:00,9,39,abc,NaN,NaN,,NaN\n"
          "2013-11-02,9,39,1,1,1,1,1\n")
    raw = read_raw_activity(spark, os.path.join(tmp_dir, "*.csv"))
    rows = {r["grid_id"] + "|" + str(r["hour"]): r for r in cleaning.clean_raw(raw).collect()}
    assert set(rows) == {"7|10", "8|12", "9|13", "9|0"}
    r7 = rows["7|10"]
    assert (r7["call_count"], r7["sms_count"], r7["internet_usage"]) == (3.0, 2.0, 10.0)
    assert str(r7["event_date"]) == "2013-11-01"
    r8 = rows["8|12"]
    assert (r8["call_count"], r8["sms_count"], r8["internet_usage"]) == (0.0, 0.0, 0.0)
    r9 = rows["9|13"]
    assert not any(math.isnan(r9[c]) for c in ["call_count", "sms_count", "internet_usage"])
    assert (r9["call_count"], r9["sms_count"], r9["internet_usage"]) == (0.0, 0.0, 0.0)
    assert str(rows["9|0"]["event_date"]) == "2013-11-02"


def test_lineage_column(spark, tmp_dir):
    write(os.path.join(tmp_dir, "x.csv"), RAW_HEADER + "2013-11-01 10:00:00,1,39,1,1,1,1,1\n")
    raw = read_raw_activity(spark, os.path.join(tmp_dir, "*.csv"), with_lineage=True)
    assert raw.select("source_file").first()[0].endswith("x.csv")


def test_activity_long_keeps_zeros_and_sums(spark):
    df = spark.createDataFrame(
        [("g1", 1.0, 0.0, 2.5), ("g2", 0.0, 4.0, 0.0)],
        "grid_id string, call_count double, sms_count double, internet_usage double") \
        .withColumn("event_timestamp", F.lit("2013-11-01 10:00:00").cast("timestamp_ntz")) \
        .withColumn("event_date", F.to_date("event_timestamp")).withColumn("hour", F.hour("event_timestamp"))
    long = cleaning.activity_long(df)
    assert long.count() == 6
    assert sorted(r["activity_type"] for r in long.where("grid_id = 'g1'").collect()) == ["call", "internet", "sms"]
    assert long.agg(F.sum("activity_value")).first()[0] == 7.5


def test_clean_flat_rules(spark):
    # Header normalised, NaN and negatives dropped (F4 before F5), duplicates removed.
    df = spark.createDataFrame([
        ("2013-11-01 10:00:00", "g1", "1", "2", "3", "x"),
        ("2013-11-01 10:00:00", "g1", "1", "2", "3", "x"),   # duplicate
        ("2013-11-01 11:00:00", "g1", "NaN", "2", "3", "x"),  # NaN -> dropped
        ("2013-11-01 12:00:00", "g1", "-1", "2", "3", "x"),   # negative -> dropped
        ("bad", "g1", "1", "2", "3", "x"),                    # unparseable time
        ("2013-11-01 13:00:00", None, "1", "2", "3", "x"),    # null grid
        ("2013-11-01", "g2", " 3 ", "1e3", "inf", None),      # loose numbers accepted
    ], "` Timestamp ` string, GRID_ID string, call_count string, sms_count string, internet_usage string, extra string")
    out = cleaning.clean_flat(df).collect()
    assert len(out) == 2
    g2 = [r for r in out if r["grid_id"] == "g2"][0]
    assert (g2["call_count"], g2["sms_count"], g2["internet_usage"]) == (3.0, 1000.0, float("inf"))
    assert g2["hour"] == 0 and str(g2["day"]) == "2013-11-01"
    assert "extra" in cleaning.clean_flat(df).columns


def test_clean_flat_missing_columns(spark):
    import pytest
    df = spark.createDataFrame([("a", "b")], "timestamp string, grid_id string")
    with pytest.raises(ValueError, match="call_count"):
        cleaning.clean_flat(df)


def test_flat_time_formats(spark):
    # D-7: explicit format list, first match wins; unknown layouts are null.
    from cellsight.functions.columns import parse_with_formats
    df = spark.createDataFrame([("2013-11-01 10:15:00",), ("2013-11-01 10:15",), ("2013-11-01T10:15:00",),
                                ("2013-11-01",), ("01/11/2013",), (" 2013-11-01 10:15:00 ",)], "t string")
    got = [r[0] for r in df.select(parse_with_formats(F.col("t")).cast("string")).collect()]
    assert got == ["2013-11-01 10:15:00", "2013-11-01 10:15:00", "2013-11-01 10:15:00",
                   "2013-11-01 00:00:00", None, "2013-11-01 10:15:00"]


def test_missing_cleaned_path(spark, tmp_dir):
    import pytest

    from cellsight.sources.files import read_cleaned
    with pytest.raises(FileNotFoundError):
        read_cleaned(spark, os.path.join(tmp_dir, "nope"))


def test_empty_input_rejected(spark):
    import pytest

    from cellsight.operators._util import require_nonempty
    with pytest.raises(ValueError):
        require_nonempty(spark.range(0), "usage data")


def test_hour_and_date_ignore_session_zone(spark, tmp_dir):
    # H1: wall-clock timestamps (TIMESTAMP_NTZ) give the same hour and date in any session zone.
    write(os.path.join(tmp_dir, "z.csv"), RAW_HEADER + "2013-11-01 00:30:00,1,39,1,1,1,1,1\n")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Rome")
        row = cleaning.clean_raw(read_raw_activity(spark, os.path.join(tmp_dir, "z.csv"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert row["hour"] == 0 and str(row["event_date"]) == "2013-11-01"


def test_header_check_option(spark, tmp_dir):
    # D-10: by default columns bind by position; check_header makes Spark verify the names.
    import pytest
    write(os.path.join(tmp_dir, "h.csv"), "when,cell,cc,a,b,c,d,e\n2013-11-01 10:00:00,1,39,1,1,1,1,1\n")
    assert read_raw_activity(spark, os.path.join(tmp_dir, "h.csv")).count() == 1
    with pytest.raises(Exception):
        read_raw_activity(spark, os.path.join(tmp_dir, "h.csv"), check_header=True).collect()
