"""Adapters from the driver's tables to the reference's input layouts (FIXTURES §3).

Each adapter is a plain projection or join over the given tables, so its
cost grows with them and Catalyst prunes and pushes filters into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Fixed mapping of event types onto the five raw measures.
EVENT_MEASURES = {
    "signup": "smsin",
    "purchase": "smsout",
    "click": "callin",
    "view": "callout",
    "error": "internet",
}


def grid_of_user(user_col="user_id"):
    return F.concat(F.lit("R"), F.col(user_col).cast("string"))


def raw_activity_from_events(events: DataFrame) -> DataFrame:
    """events -> raw activity rows (datetime text, CellID, countrycode, 5 measures)."""
    cols = {name: F.when(F.col("event_type") == kind, F.col("value")).cast("double")
            for kind, name in EVENT_MEASURES.items()}
    return events.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datetime"),
        grid_of_user().alias("CellID"),
        F.pmod(F.col("event_id"), F.lit(5)).cast("string").alias("countrycode"),
        cols["smsin"].alias("smsin"),
        cols["smsout"].alias("smsout"),
        cols["callin"].alias("callin"),
        cols["callout"].alias("callout"),
        cols["internet"].alias("internet"),
    )


def nation_regions(nation: DataFrame, region: DataFrame) -> DataFrame:
    """nation_key -> (region_name = nation name, city = region name)."""
    return (nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
            .select(F.col("n_nationkey").alias("nation_key"),
                    F.col("n_name").alias("region_name"),
                    F.col("r_name").alias("city")))


def region_mapping_from_events(events: DataFrame, nation: DataFrame, region: DataFrame,
                               mapped_nations: int | None = None) -> DataFrame:
    """One mapping row per user: grid 'R<user>' -> nation (user % 25) and its region.

    ``mapped_nations`` keeps only users with ``user % 25 < mapped_nations`` to
    leave grids without a region (D-4).
    """
    users = events.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    users = users.withColumn("nation_key", F.pmod(F.col("user_id"), F.lit(25)).cast("int"))
    if mapped_nations is not None:
        users = users.where(F.col("nation_key") < mapped_nations)
    lookup = nation_regions(nation, region)
    return (users.join(lookup, "nation_key", "left")
            .select(grid_of_user().alias("grid_id"), "region_name", "city"))


def flat_usage_from_events(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """events -> flat usage rows (timestamp text, grid_id, call, sms, internet), and the columns to ``keep``."""
    kind, value = F.col("event_type"), F.col("value")
    zero = F.lit(0.0)
    return events.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        grid_of_user().alias("grid_id"),
        F.when(kind.isin("click", "view"), value).otherwise(zero).alias("call_count"),
        F.when(kind.isin("signup", "purchase"), value).otherwise(zero).alias("sms_count"),
        F.when(kind == "error", value).otherwise(zero).alias("internet_usage"),
        *(keep or []),
    )


def usage_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """lineitem -> cleaned usage rows (the benchmark adapter).

    event_timestamp = l_shipdate + (l_orderkey % 24) hours; grid = supplier.
    """
    ts = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.pmod("l_orderkey", F.lit(24)).cast("int"))
    return (lineitem.select(
        F.col("l_suppkey").cast("string").alias("grid_id"),
        F.col("l_quantity").cast("double").alias("call_count"),
        F.col("l_linenumber").cast("double").alias("sms_count"),
        F.col("l_extendedprice").cast("double").alias("internet_usage"),
        ts.cast("timestamp_ntz").alias("event_timestamp"))
        .withColumn("event_date", F.to_date("event_timestamp"))
        .withColumn("hour", F.hour("event_timestamp")))


def region_mapping_from_suppliers(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Supplier grid -> nation name and region name (benchmark lookup)."""
    lookup = nation_regions(nation, region)
    return (supplier.join(lookup, supplier.s_nationkey == lookup.nation_key, "left")
            .select(F.col("s_suppkey").cast("string").alias("grid_id"), "region_name", "city"))


def customers_from_table(customer: DataFrame) -> DataFrame:
    """Customer ids for the plan lookup."""
    return customer.select(F.col("c_custkey").cast("string").alias("customer_id"))
