"""Small helpers shared by operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def single_row(*frames: DataFrame) -> DataFrame:
    """Merge one-row frames with disjoint columns into one row.

    Done as a union plus a global aggregate, so no join (and no cross
    product) is planned; each input holds exactly one row.
    """
    cols = [c for f in frames for c in f.columns]
    unioned = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return unioned.agg(*[F.max(c).alias(c) for c in cols])


def require_columns(df: DataFrame, required) -> None:
    """Raise naming every required column missing from ``df`` (Q4)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def require_nonempty(df: DataFrame, what: str = "dataset") -> None:
    """Raise when ``df`` has no rows (Q5); reads at most one row."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
