"""Lookup joins (J1, J7) and the lookup de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def dedup_mapping(mapping: DataFrame) -> DataFrame:
    """One row per grid_id: the smallest (region_name, city), nulls last (D1, D-3).

    An aggregate rather than a window, so it combines map-side and a grid
    listed many times costs no more than one listed once.
    """
    best = F.min(F.struct(F.col("region_name").isNull().alias("rn"), F.col("region_name").alias("r"),
                          F.col("city").isNull().alias("cn"), F.col("city").alias("c")))
    return (mapping.groupBy("grid_id").agg(best.alias("_best"))
            .select("grid_id", F.col("_best.r").alias("region_name"), F.col("_best.c").alias("city")))


def enrich_region(cleaned: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """Left join of usage rows to the grid lookup.

    Unmatched grids keep null region_name and city; the lookup is made unique
    first, so the row count is preserved. Without a lookup (S3) the rows are
    returned unchanged. How the join runs is left to Spark, which measures
    the lookup in bytes (``spark.sql.autoBroadcastJoinThreshold``, AQE).
    """
    if mapping is None:
        return cleaned
    lookup = dedup_mapping(mapping)
    return cleaned.join(lookup, "grid_id", "left")


# Fixed plan attributes every customer gets when no plan is on record.
DEFAULT_PLAN = {
    "plan_name": "Premium Plus",
    "data_limit_mb": 25000,
    "voice_limit_minutes": 1200,
    "sms_limit": 1000,
    "status": "ACTIVE",
}


def enrich_plan(customers: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Attach plan attributes by customer_id, defaulting to :data:`DEFAULT_PLAN`.

    A customer with several plans on record gets the smallest of them (by the
    attributes in their order, nulls last), so each customer stays one row.
    """
    attrs = list(DEFAULT_PLAN)
    if plans is None:
        return customers.select("*", *[F.lit(v).alias(k) for k, v in DEFAULT_PLAN.items()])
    key = [f for a in attrs for f in (F.col(a).isNull().alias(f"_n_{a}"), F.col(a).alias(f"_p_{a}"))]
    lookup = (plans.groupBy("customer_id").agg(F.min(F.struct(*key)).alias("_best"))
              .select("customer_id", *[F.col(f"_best._p_{a}").alias(f"_p_{a}") for a in attrs]))
    joined = customers.join(lookup, "customer_id", "left")
    return joined.select(*customers.columns,
                         *[F.coalesce(F.col(f"_p_{a}"), F.lit(DEFAULT_PLAN[a])).alias(a) for a in attrs])
