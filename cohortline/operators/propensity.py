"""Propensity scores over several arms and weights towards a focal arm."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.columns import total
from cohortline.functions.fixed_values import TRIM_AT
from cohortline.functions.linear import independent, sum_vectors
from cohortline.functions.order_statistics import nearest_even_rank, order_statistics
from cohortline.functions.sizing import cut_lineage


#: Passes over the rows at most, and the change of the log likelihood, relative to its size, that ends them.
MAX_PASSES, SETTLED = 50, 1e-12


def _logistic_fits(rows: DataFrame, arm: str, levels: Sequence[str], names: Sequence[str], means: np.ndarray, spreads: np.ndarray) -> np.ndarray:
    """Coefficients [level, intercept and standardised terms] of each level against the rest.

    A pass sums log likelihood, score and information of all levels at once: A * (1 + k + k * k) numbers for each partition.
    Where a step lowers a level's likelihood it is halved, in the same passes as the other levels' steps.
    """
    k, n_levels = len(names) + 1, len(levels)
    size = 1 + k + k * k

    def sums(beta: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
        def batch_vector(batch) -> np.ndarray:
            x = np.column_stack([np.ones(len(batch)), (batch[list(names)].to_numpy(float) - means) / spreads])
            own, eta, out = batch[arm].to_numpy(), x @ beta.T, np.zeros((n_levels, size))
            for a, level in enumerate(levels):
                y, e = (own == level).astype(float), eta[:, a]
                p = 1 / (1 + np.exp(-np.clip(e, -700, 700)))
                out[a, 0] = (y * e - np.logaddexp(0, e)).sum()
                out[a, 1:k + 1] = x.T @ (y - p)
                out[a, k + 1:] = (x.T @ ((p * (1 - p))[:, None] * x)).ravel()
            return out.ravel()

        found = sum_vectors(rows.select(arm, *names), n_levels * size, batch_vector).reshape(n_levels, size)
        return [(f[0], f[1:k + 1], f[k + 1:].reshape(k, k)) for f in found]

    beta, step = np.zeros((n_levels, k)), np.zeros((n_levels, k))
    best: list[tuple[float, np.ndarray, np.ndarray] | None] = [None] * n_levels
    going = np.ones(n_levels, bool)
    for _ in range(MAX_PASSES):
        for a, now in enumerate(sums(beta + step)):
            if not going[a]:
                continue
            before = best[a]
            if before is not None and now[0] < before[0] - SETTLED * max(1.0, abs(before[0])):
                step[a] /= 2
                going[a] = np.abs(step[a]).max() > 1e-12
                continue
            beta[a] += step[a]
            best[a] = now
            kept = independent(now[2])
            step[a] = 0.0
            step[a, kept] = np.linalg.solve(now[2][np.ix_(kept, kept)], now[1][kept]) if kept.any() else 0.0
            going[a] = kept.any() and (before is None or abs(now[0] - before[0]) > SETTLED * max(1.0, abs(now[0])))
        step[~going] = 0.0
        if not going.any():
            return beta
    warnings.warn("the propensity fits have not settled", stacklevel=3)
    return beta


def propensity_scores(df: DataFrame, arm: str, levels: Sequence[str], terms: Mapping[str, str]) -> DataFrame:
    """One logistic fit per arm against the rest, normalised to sum 1; adds ``ps_<arm>`` for every arm.

    Rows outside ``levels`` or with a missing term are left out. Terms that do not vary, or only with earlier ones, carry no
    information and get no weight. The fits share their passes over the rows, which are as many as the slowest one needs.
    """
    names = [f"_z{i}" for i in range(len(terms))]
    rows = df.where(F.col(arm).isin(list(levels))).withColumns(
        {n: F.expr(e).cast("double") for n, e in zip(names, terms.values())}).dropna(subset=names)
    rows = cut_lineage(rows)
    facts = rows.agg(*[f(n) for n in names for f in (F.avg, F.stddev_pop)]).first()
    means, spreads = np.array(facts[0::2], float), np.array(facts[1::2], float)
    varies = [i for i in range(len(names)) if spreads[i] > 0]
    used, means, spreads = [names[i] for i in varies], means[varies], spreads[varies]
    seen = rows.select(arm, *used).persist()
    beta = _logistic_fits(seen, arm, levels, used, means, spreads)
    seen.unpersist()
    odds = {}
    for level, b in zip(levels, beta):
        slopes = b[1:] / spreads
        eta = F.lit(float(b[0] - slopes @ means))
        for slope, n in zip(slopes, used):
            eta = eta + F.lit(float(slope)) * F.col(n)
        odds[f"_raw_{level}"] = 1.0 / (1.0 + F.exp(-eta))
    raw = rows.withColumns(odds)
    whole = total([F.col(c) for c in odds])
    return raw.withColumns({f"ps_{level}": F.try_divide(F.col(f"_raw_{level}"), whole) for level in levels}).drop(*odds, *names)


def att_weight(arm: str, levels: Sequence[str], focal: str) -> Column:
    """1 for the focal arm, p(focal) / p(own arm) for the others; NULL where the own arm's score is 0."""
    weight = F.lit(None).cast("double")
    for level in levels:
        value = F.lit(1.0) if level == focal else F.try_divide(F.col(f"ps_{focal}"), F.col(f"ps_{level}"))
        weight = F.when(F.col(arm) == level, value).otherwise(weight)
    return weight


def trim_limits(df: DataFrame, weight: str, arm: str, focal: str, at: float = TRIM_AT,
                lower: bool = True) -> tuple[float | None, float]:
    """Order statistics of the non-focal weights at ``1 - at`` and ``at``."""
    others = df.where(F.col(arm) != focal).select(weight)
    n = others.where(F.col(weight).isNotNull()).count()
    ranks = ([nearest_even_rank(n, 1 - at)] if lower else []) + [nearest_even_rank(n, at)]
    found = order_statistics(others, weight, ranks)
    return (found[0] if lower else None), found[-1]


def trim_weights(df: DataFrame, weight: str, arm: str, focal: str, at: float = TRIM_AT, lower: bool = True) -> DataFrame:
    """Pull the weights of the non-focal arms inside the limits."""
    low, high = trim_limits(df, weight, arm, focal, at, lower)
    clipped = F.least(F.col(weight), F.lit(high))
    if low is not None:
        clipped = F.greatest(clipped, F.lit(low))
    return df.withColumn(weight, F.when(F.col(arm) != focal, clipped).otherwise(F.col(weight)))


def weight_summary(df: DataFrame, weight: str, arm: str) -> DataFrame:
    """Range, variation and effective sample size of the weights per arm."""
    w = F.col(weight)
    return df.where(F.col(arm).isNotNull()).groupBy(arm).agg(
        F.count(w).alias("n"), F.min(w).alias("min_weight"), F.max(w).alias("max_weight"),
        F.avg(w).alias("mean_weight"), (F.stddev_samp(w) / F.avg(w)).alias("cv"),
        (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("ess"))
