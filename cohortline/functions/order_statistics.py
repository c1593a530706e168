"""Exact order statistics of a column too large to sort in one place."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int]) -> list[float]:
    """Values at the 1-based ``ranks`` of the non-NULL values in ascending order.

    Each pass counts at most ``BUCKETS`` equal-width buckets between the current bounds and goes on
    inside the bucket that holds the rank. Bounds are actual values, so the range shrinks strictly
    and the result is exact.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL").persist()
    try:
        whole = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        return [_locate(values, rank, whole["lo"], whole["hi"]) for rank in ranks]
    finally:
        values.unpersist()


def _locate(values: DataFrame, rank: int, lo: float, hi: float) -> float:
    below = 0
    while lo < hi:
        share = (F.col("v") - F.lit(lo)) / F.lit(hi - lo)
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        inside = values.where(F.col("v").between(lo, hi)).groupBy(bucket.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for row in sorted(inside.collect(), key=lambda r: r["b"]):
            if below + row["n"] >= rank:
                lo, hi = row["lo"], row["hi"]
                break
            below += row["n"]
    return lo


def nearest_even_rank(n: int, p: float) -> int:
    """Rank of the quantile defined as the nearest order statistic, ties to the even one (type 3)."""
    target = n * p - 0.5
    j = math.floor(target + 1e-9 * max(1.0, abs(target)))
    exact = abs(target - j) <= 1e-9 * max(1.0, abs(target))
    rank = j if exact and j % 2 == 0 else j + 1
    return min(max(rank, 1), n)
