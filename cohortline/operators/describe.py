"""Baseline tables: means, shares, standardised differences and contingency tests."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortline.functions.tails import chi2_tail


def table_one(df: DataFrame, arm: str, continuous: Sequence[str], categorical: Mapping[str, Sequence],
              weight: str | None = None) -> DataFrame:
    """Long baseline table: (variable, level, arm, n, total, mean, sd, share).

    One aggregate per arm holds the sums of every variable, so rows are read once and not
    multiplied. ``n`` counts rows, ``total`` their weights. Missing values are left out of their
    variable. Level lists name the categories.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    sums, structs = [], []

    def record(variable: str, level: str | None, n: Column, total_w: Column, mean: Column, sd: Column, share: Column):
        structs.append(F.struct(
            F.lit(variable).alias("variable"), F.lit(level).cast("string").alias("level"), n.alias("n"),
            total_w.alias("total"), mean.cast("double").alias("mean"), sd.cast("double").alias("sd"),
            share.cast("double").alias("share")))

    nothing = F.lit(None)
    for v in continuous:
        x = F.col(v).cast("double")
        sums += [F.count(v).alias(f"n_{v}"), F.sum(F.when(x.isNotNull(), w)).alias(f"w_{v}"),
                 F.sum(w * x).alias(f"s1_{v}"), F.sum(w * x * x).alias(f"s2_{v}")]
        n, tw = F.col(f"n_{v}"), F.col(f"w_{v}")
        mean = F.col(f"s1_{v}") / tw
        spread = F.greatest(F.col(f"s2_{v}") / tw - mean * mean, F.lit(0.0))
        sd = F.when(n > 1, F.sqrt(spread * n / (n - 1)))
        record(v, None, n, tw, mean, sd, nothing)
    for v, levels in categorical.items():
        known = F.col(v).isin(list(levels))
        sums.append(F.coalesce(F.sum(F.when(known, w)), F.lit(0.0)).alias(f"w_{v}"))
        for i, level in enumerate(levels):
            hit = F.col(v) == F.lit(level)
            sums += [F.count_if(hit).alias(f"n_{v}_{i}"),
                     F.coalesce(F.sum(F.when(hit, w)), F.lit(0.0)).alias(f"w_{v}_{i}")]
            record(v, str(level), F.col(f"n_{v}_{i}"), F.col(f"w_{v}_{i}"), nothing, nothing,
                   F.col(f"w_{v}_{i}") / F.nullif(F.col(f"w_{v}"), F.lit(0.0)))
    wide = df.where(F.col(arm).isNotNull()).groupBy(F.col(arm).alias("arm")).agg(*sums)
    return wide.select("arm", F.inline(F.array(*structs)))


def smd_rows(table: DataFrame) -> list[tuple]:
    """Standardised mean differences of a baseline table: (variable, arm_a, arm_b, smd, mean over pairs).

    Reads the finished table, whose size is arms x listed variables and levels.
    """
    stats: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
    for r in table.orderBy("variable", "arm", "level").collect():
        stats[r["variable"]][r["arm"]].append(r)
    out = []
    for variable, by_arm in sorted(stats.items()):
        found = [(a, b, _smd(by_arm[a], by_arm[b])) for a, b in combinations(sorted(by_arm), 2)]
        known = [d for _, _, d in found if d is not None]
        mean = float(np.mean(known)) if known else None
        out += [(variable, a, b, d, mean) for a, b, d in found]
    return out


def _smd(a: list, b: list) -> float | None:
    kind = "sd" if a[0]["level"] is None else "share"
    if any(r[kind] is None for r in [*a, *b]):
        return None
    if kind == "sd":
        spread = np.sqrt((a[0]["sd"] ** 2 + b[0]["sd"] ** 2) / 2)
        gap = abs(a[0]["mean"] - b[0]["mean"])
        return float(gap / spread) if spread > 0 else None
    p, q = (np.array([r["share"] for r in rows][1:], dtype=float) for rows in (a, b))
    cov = (np.diag(p) - np.outer(p, p) + np.diag(q) - np.outer(q, q)) / 2
    if not np.any(cov):
        return None
    return float(np.sqrt((p - q) @ np.linalg.pinv(cov) @ (p - q)))


def smd(spark: SparkSession, table: DataFrame) -> DataFrame:
    return spark.createDataFrame(
        smd_rows(table), "variable string, arm_a string, arm_b string, smd double, smd_mean double")


def contingency(df: DataFrame, variable: str, strata: Sequence[Sequence[str]]) -> DataFrame:
    """Counts of ``variable`` for several stratifications: (strata, stratum, level, n, share).

    A row without a level, or without one of a table's own strata, is left out of that table alone. The rows are aggregated once over all stratifying columns; every table is summed from that.
    """
    columns = list(dict.fromkeys(c for s in strata for c in s))
    cells = df.dropna(subset=[variable]).groupBy(variable, *columns).agg(F.count(F.lit(1)).alias("_n"))
    joined = [F.concat(*[p for c in s for p in (F.lit(":"), F.col(c).cast("string"))][1:]) for s in strata]
    entries = [F.struct(F.lit("+".join(s)).alias("strata"), j.alias("stratum")) for s, j in zip(strata, joined)]
    stacked = cells.select(F.inline(F.array(*entries)), F.col(variable).cast("string").alias("level"), "_n")
    stacked = stacked.where("stratum IS NOT NULL")
    table = stacked.groupBy("strata", "stratum", "level").agg(F.sum("_n").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("strata", "stratum"))
    return table.withColumn("share", F.col("n") / whole)


def chisq(table: DataFrame) -> DataFrame:
    """Pearson statistic and degrees of freedom per stratification of a contingency table.

    A 2 x 2 table gets the continuity correction. Cells without rows need no entry: the sum of
    O^2/E and the sum of 1/E follow from the margins. The table is as small as its categories.
    """
    in_column, in_row, in_table = (Window.partitionBy("strata", *c) for c in (["stratum"], ["level"], []))
    cells = table.select("strata", "stratum", "level", F.col("n").cast("double").alias("o")).select(
        "strata", "o", F.sum("o").over(in_column).alias("c"), F.sum("o").over(in_row).alias("r"),
        F.sum("o").over(in_table).alias("total"), F.count("o").over(in_column).alias("in_c"),
        F.count("o").over(in_row).alias("in_r"))
    expected = F.col("r") * F.col("c") / F.col("total")
    facts = cells.groupBy("strata").agg(
        (F.sum(F.col("o") * F.col("o") / expected) - F.max("total")).alias("plain"),
        F.max(F.abs(F.col("o") - expected)).alias("gap"), F.max("total").alias("total"),
        F.round(F.sum(1 / F.col("in_c"))).cast("long").alias("nc"),
        F.round(F.sum(1 / F.col("in_r"))).cast("long").alias("nr"),
        F.sum(1 / F.col("c") / F.col("in_c")).alias("inv_c"), F.sum(1 / F.col("r") / F.col("in_r")).alias("inv_r"))
    corrected = F.pow(F.col("gap") - F.least(F.lit(0.5), F.col("gap")), 2) * F.col("total") * F.col("inv_c") * F.col("inv_r")
    square = (F.col("nc") == 2) & (F.col("nr") == 2)
    return facts.select("strata", F.when(square, corrected).otherwise(F.col("plain")).alias("chisq"),
                        ((F.col("nc") - 1) * (F.col("nr") - 1)).alias("df"))


def chisq_test(table: DataFrame) -> DataFrame:
    """:func:`chisq` with its tail probability, one row per stratification; all of it inside the plan."""
    return chisq(table).withColumn("p", chi2_tail(F.col("chisq"), F.col("df")))
