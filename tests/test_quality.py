import csv
import io
import os

import pytest

from cellsight.operators import quality
from cellsight.sources.landing import head_records, list_landing, read_heads

GOOD = "timestamp,grid_id,call_count,sms_count,internet_usage,extra\n2013-11-01 10:00:00,1,2,3,4.5,x\n"


def landing(tmp_dir):
    files = {
        "good.csv": GOOD,
        "upper.csv": " TimeStamp ,GRID_ID,Call_Count,sms_count,internet_usage\n2013-11-01 10:00:00,1,2,3,4\n",
        "null_required.csv": "timestamp,grid_id,call_count,sms_count,internet_usage\n2013-11-01 10:00:00,1,NA,3,4\n",
        "missing_cols.csv": "timestamp,grid_id,call_count\n2013-11-01 10:00:00,1,2\n",
        "null_extra.csv": "timestamp,grid_id,call_count,sms_count,internet_usage,extra\n2013-11-01 10:00:00,1,2,3,4,\n",
        "header_only.csv": "timestamp,grid_id,call_count,sms_count,internet_usage\n",
        "zero.csv": "",
        "short_row.csv": "timestamp,grid_id,call_count,sms_count,internet_usage\n2013-11-01 10:00:00,1,2\n",
        "quoted.csv": 'timestamp,grid_id,call_count,sms_count,internet_usage\n"2013-11-01 10:00:00","a,b",1,2,3\n',
        "space_value.csv": "timestamp,grid_id,call_count,sms_count,internet_usage\n2013-11-01 10:00:00, ,1,2,3\n",
    }
    for name, text in files.items():
        with open(os.path.join(tmp_dir, name), "w") as fh:
            fh.write(text)
    return os.path.join(tmp_dir, "*.csv")


def test_validate_files(spark, tmp_dir):
    res = {r["file_name"]: (r["valid"], r["reason"]) for r in quality.validate_files(spark, landing(tmp_dir)).collect()}
    assert res["good.csv"] == (True, None)
    assert res["upper.csv"][0] is True            # D-12: normalised once, then accepted
    assert res["null_required.csv"] == (False, "null in required column")
    assert res["missing_cols.csv"] == (False, "missing required columns")
    assert res["null_extra.csv"][0] is True
    assert res["header_only.csv"][0] is True
    assert res["zero.csv"] == (False, "unreadable or empty file")
    assert res["short_row.csv"][0] is False
    assert res["quoted.csv"][0] is True
    assert res["space_value.csv"][0] is True     # a blank is a value, not a missing marker


def test_sample_is_limited(spark, tmp_dir):
    body = "".join(f"2013-11-01 10:00:00,{i},1,1,1\n" for i in range(300))
    with open(os.path.join(tmp_dir, "big.csv"), "w") as fh:
        fh.write("timestamp,grid_id,call_count,sms_count,internet_usage\n" + body + "2013-11-01,1,,1,1\n")
    sample = quality.sample_files(list_landing(spark, os.path.join(tmp_dir, "big.csv")), 200)
    assert sample.count() == 201
    # the null is beyond the sample, so the file passes (the check samples 200 rows)
    assert quality.validate_files(spark, os.path.join(tmp_dir, "big.csv")).first()["valid"] is True


def test_heads_read_no_further_than_they_need(tmp_dir):
    """A file of 40 MB costs less than 1 MB, and one endless line is refused early."""
    class Counted(io.FileIO):
        taken = 0

        def readinto(self, buffer):
            n = super().readinto(buffer)
            self.taken += n
            return n

    path = os.path.join(tmp_dir, "large.csv")
    with open(path, "w") as fh:
        for _ in range(40):
            fh.write("timestamp,grid_id,call_count,sms_count,internet_usage\n" * 20_000)
    with Counted(path) as raw:
        assert len(head_records(io.BufferedReader(raw), 201)) == 201 and raw.taken < 1_000_000
    with open(path, "w") as fh:
        fh.write("x" * 20_000_000)
    with Counted(path) as raw:
        with pytest.raises((ValueError, csv.Error)):
            head_records(io.BufferedReader(raw), 201)
        assert raw.taken < 5_000_000


def test_quoted_line_breaks_are_part_of_a_field(spark, tmp_dir):
    head = "timestamp,grid_id,call_count,sms_count,internet_usage,note\r\n"
    rows = '2013-11-01 10:00:00,1,2,3,4,"first\r\nsecond, ""third""\n"\r\n\r\n  \r\n2013-11-01 10:00:00,1,NA,3,4,\r\n'
    for name, text in {"one.csv": head + rows.split("\r\n\r\n")[0], "null.csv": head + rows, "bom.csv": "\ufeff" + head}.items():
        with open(os.path.join(tmp_dir, name), "w", newline="") as fh:
            fh.write(text)
    with open(os.path.join(tmp_dir, "latin.csv"), "wb") as fh:
        fh.write(head.encode() + "2013-11-01 10:00:00,é,1,2,3,\n".encode("latin-1"))
    listing = list_landing(spark, f"{tmp_dir}/*.csv")
    fields = {(r["uri"].rsplit("/", 1)[1], r["line_no"]): r["fields"] for r in read_heads(listing, 201).collect()}
    assert fields["one.csv", 1][5] == 'first\r\nsecond, "third"\n' and ("one.csv", 2) not in fields
    assert fields["null.csv", 2][2] == "NA" and ("null.csv", 3) not in fields
    checked = {r["file_name"]: (r["valid"], r["reason"]) for r in quality.check_files(listing).collect()}
    assert checked == {"one.csv": (True, None), "null.csv": (False, "null in required column"), "bom.csv": (True, None),
                       "latin.csv": (False, "unreadable or empty file")}


def test_listing_follows_patterns_and_names(spark, tmp_dir):
    for folder in ("a", "b1", "b2"):
        os.makedirs(f"{tmp_dir}/{folder}/deep")
        for name in ("x.csv", "y é %41#.csv", "z.txt", ".hidden.csv"):
            with open(f"{tmp_dir}/{folder}/{name}", "w") as fh:
                fh.write("h\n1\n")
    names = lambda p: sorted(r["path"].removeprefix(f"file:{tmp_dir}/") for r in list_landing(spark, p).collect())
    assert names(f"{tmp_dir}/b*/*.csv") == [f"{f}/{n}" for f in ("b1", "b2") for n in ("x.csv", "y é %41#.csv")]
    assert names(f"file:{tmp_dir}/{{a,b2}}/[x-y].csv") == ["a/x.csv", "b2/x.csv"]
    assert names(f"file://{tmp_dir}/a/z.???") == ["a/z.txt"] and names(f"{tmp_dir}/nowhere/*.csv") == []
    found = list_landing(spark, f"{tmp_dir}/a/*.csv")
    of_spark = spark.read.text(f"{tmp_dir}/a/*.csv").select("_metadata.file_path").distinct().collect()
    assert {r["uri"] for r in found.collect()} == {r[0].replace("file:///", "file:/") for r in of_spark}
    assert {(r["length"], r["modification_time"] is None) for r in found.collect()} == {(4, False)}


def test_route_and_status(spark, tmp_dir):
    checked = quality.validate_files(spark, landing(tmp_dir))
    ingested = spark.createDataFrame([("good.csv",)], "file_name string")
    routed = {r["file_name"]: r for r in quality.route_files(checked, ingested).collect()}
    assert routed["good.csv"]["status"] == "duplicate" and routed["good.csv"]["target_name"] == "duplicate_good.csv"
    assert routed["upper.csv"]["status"] == "accepted"
    assert routed["zero.csv"]["status"] == "rejected"
    counts = {r["status"]: r["files"] for r in quality.ingest_status(quality.route_files(checked, ingested)).collect()}
    assert counts == {"accepted": 5, "duplicate": 1, "rejected": 4}


def test_quality_profile(spark):
    df = spark.createDataFrame([
        ("2013-11-01 10:00:00", "g", "1", "-2", "3"),
        ("2013-11-01 10:00:00", "g", "1", "-2", "3"),
        ("2013-11-01 10:00:00", "g", "1", "-2", "3"),
        ("junk", None, "abc", "1", "-1"),
        ("junk", None, "abc", "1", "-1"),
    ], "Timestamp string, grid_id string, call_count string, sms_count string, internet_usage string")
    r = quality.quality_profile(df).first()
    assert (r["rows"], r["missing_timestamps"], r["duplicate_rows"]) == (5, 2, 3)
    assert (r["negative_call_count"], r["negative_sms_count"], r["negative_internet_usage"]) == (0, 3, 2)


def test_profile_columns(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "b"), (None, None)], "x double, s string")
    prof = {r["column"]: r for r in quality.profile_columns(df).collect()}
    assert prof["x"]["count"] == 3 and prof["x"]["nulls"] == 1 and prof["x"]["p50"] == 2.0
    assert prof["s"]["top"] == "b" and prof["s"]["freq"] == 2 and prof["s"]["unique"] == 2


def test_profile_of_any_type(spark):
    df = spark.sql("""SELECT map('k', id % 2) AS m, array(id % 3) AS a, struct(id % 2 AS f) AS s, id % 2 = 0 AS b,
        date_add(date'2024-01-01', cast(id % 2 AS int)) AS d, cast(id AS decimal(10, 2)) AS x, cast(null AS string) AS nothing
        FROM range(9)""")
    prof = {r["column"]: r for r in quality.profile_columns(df).collect()}
    assert [(prof[c]["unique"], prof[c]["top"], prof[c]["freq"]) for c in "msbd"] == [
        (2, "{k -> 0}", 5), (2, "{0}", 5), (2, "true", 5), (2, "2024-01-01", 5)]
    assert prof["a"]["unique"] == 3 and prof["a"]["top"] == "[0]" and prof["x"]["p25"] == 2.0
    assert (prof["nothing"]["unique"], prof["nothing"]["top"], prof["nothing"]["nulls"]) == (0, None, 9)
