"""Exact ranks and percentiles without putting a whole group into one task.

A window ``row_number() over (partition by g order by x)`` sends every row of
a group to one task. Here rows are range-partitioned on (g, x, tie), so one
large group spreads over many tasks; each task numbers its rows locally and a
small table of per-(partition, group) counts turns local numbers into ranks.
That table has at most (partitions + groups) rows. The numbered rows are
written once and read by both: a range exchange planned twice samples its
bounds twice, and numbers and offsets would then belong to two partitionings.

Percentiles need no ranks of all rows: they are selected digit by digit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsight.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | row index
_DIGIT = 16       # bits of a key that are counted at a time
_LARGEST = np.int64((1 << 63) - 1)


def rank_within(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str],
                rank_col: str = "rank", num_partitions: int | None = None,
                few_groups: bool = False) -> DataFrame:
    """Add a 0-based ``rank_col`` within ``partition_cols`` ordered by ``order_cols``.

    Order is ascending with nulls last. Rows equal on every order column get
    distinct, adjacent ranks. ``few_groups`` broadcasts the per-partition count
    table; set it only when the number of groups is small and known. The rows
    are written once to the checkpoint folder while this function runs.
    """
    spark = df.sparkSession
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pcols = list(partition_cols)
    keys = [F.col(c).asc_nulls_last() for c in pcols + list(order_cols)] + [F.col("_tie")]

    placed = (df.withColumn("_tie", F.monotonically_increasing_id())
              .repartitionByRange(parts, *keys)
              .sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
              .withColumn("_loc", F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1)).drop("_mid", "_tie"))
    placed = materialize(placed, "ranked-rows")

    gkeys = [f"_g{i}" for i in range(len(pcols))]
    runs = placed.groupBy(F.col("_pid").alias("_rpid"), *[F.col(c).alias(g) for c, g in zip(pcols, gkeys)]) \
        .agg(F.min("_loc").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    w = (Window.partitionBy(*gkeys) if gkeys else Window).orderBy("_rpid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_offset", F.coalesce(F.sum("_cnt").over(w), F.lit(0))).drop("_cnt")
    if few_groups:
        runs = F.broadcast(runs)

    cond = [F.col("_pid") == F.col("_rpid")] + [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(pcols, gkeys)]
    out = placed.join(runs, cond, "inner").select(
        *[F.col(c) for c in df.columns],
        (F.col("_offset") + F.col("_loc") - F.col("_first")).alias(rank_col))
    return out


def _lerp(a: float, b: float, t: float) -> float:
    # Same rounding as NumPy's linear method.
    diff = b - a
    return b - diff * (1 - t) if t >= 0.5 else a + diff * t


def exact_percentiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float]:
    """Linear-interpolated percentiles of ``col`` (nulls and NaN ignored); see :func:`column_percentiles`."""
    return column_percentiles(df, [col], probs)[col]


def order_keys(x: np.ndarray) -> np.ndarray:
    """Longs that sort as the doubles do: their IEEE bits, negated for negative numbers. Both zeros have key 0."""
    bits = x.view(np.int64)
    return np.where(bits < 0, -(bits & _LARGEST), bits)


def key_value(key: int) -> float:
    """The double of an order key."""
    size = float(np.int64(abs(key)).view(np.float64))
    return -size if key < 0 else size


def _digit_counts(values: DataFrame, shift: int, wanted: dict[int, list[int]] | None) -> DataFrame:
    """(c, d, n, low, high): number and range of the keys of column ``c`` whose bits from ``shift`` on are ``d``.

    ``wanted`` limits each column to keys with one of the given bits above the
    digit. Every task counts its own part and gives one row per digit.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def merge(c: int) -> None:
            d, n, low, high = (np.concatenate(x) for x in zip(*held[c], strict=True))
            order = np.argsort(d, kind="stable")
            d = d[order]
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            held[c] = [(d[first], np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first),
                        np.maximum.reduceat(high[order], first))]

        for batch in batches:
            for c in range(batch.num_columns):
                if wanted is not None and c not in wanted:
                    continue
                x = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                keys = order_keys(x[~np.isnan(x)])
                if wanted is not None:
                    keys = keys[np.isin(keys >> (shift + _DIGIT), wanted[c])]
                if len(keys):
                    keys = np.sort(keys)
                    d = keys >> shift
                    first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                    last = np.append(first[1:], len(d)) - 1
                    held.setdefault(c, []).append((d[first], last - first + 1, keys[first], keys[last]))
                    if len(held[c]) > 100:
                        merge(c)
        for c in held:
            merge(c)
            d, n, low, high = held[c][0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), c, np.int32)), *map(pa.array, (d, n, low, high))],
                                             ["c", "d", "n", "low", "high"])

    parts = values.mapInArrow(run, "c int, d long, n long, low long, high long")
    return parts.groupBy("c", "d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def column_percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Linear-interpolated percentiles of several columns, one float per probability (``nan`` without values).

    Radix selection: the order keys of all columns are counted by their first
    16 bits, then, where a wanted rank falls, by the next 16, four times at
    most; a digit that holds one value only is settled at once. Every pass is
    one scan whose counts are combined in the tasks (a double's bits have no
    column function, so they count in Arrow batches). No row is sorted or
    written; at most 65,536 counts per column and wanted rank reach the driver.
    """
    values = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    top = 64 - _DIGIT
    positions: dict[int, list[float]] = {}
    found: dict[tuple[int, int], int] = {}          # (column, rank) -> key
    wanted: dict[tuple[int, int], dict] = {}        # (column, bits so far) -> rank -> rank within them
    for shift in range(top, -1, -_DIGIT):
        chosen: dict[int, list[int]] | None = None if shift == top else {}
        for i, p in wanted:
            chosen.setdefault(i, []).append(p)
        counted = _digit_counts(values, shift, chosen).toArrow()
        c, d, n, low, high = (counted.column(x).to_numpy() for x in ("c", "d", "n", "low", "high"))
        if shift == top:
            for i in np.unique(c).tolist():
                positions[i] = [p * (int(n[c == i].sum()) - 1) for p in probs]
                wanted[i, 0] = {r: r for pos in positions[i] for r in (math.floor(pos), math.ceil(pos))}
        deeper: dict = {}
        for (i, p), ranks in wanted.items():
            own = np.flatnonzero((c == i) & ((d >> _DIGIT == p) | (shift == top)))
            own = own[np.argsort(d[own])]
            ends = np.cumsum(n[own])
            for rank, within in ranks.items():
                k = int(np.searchsorted(ends, within, side="right"))
                at = own[k]
                if low[at] == high[at]:
                    found[i, rank] = int(low[at])
                else:
                    deeper.setdefault((i, int(d[at])), {})[rank] = within - (int(ends[k - 1]) if k else 0)
        wanted = deeper
        if not wanted:
            break
    out = {}
    for i, name in enumerate(cols):
        out[name] = [_lerp(key_value(found[i, math.floor(pos)]), key_value(found[i, math.ceil(pos)]), pos - math.floor(pos))
                     for pos in positions[i]] if i in positions else [float("nan")] * len(probs)
    return out
