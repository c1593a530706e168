"""Small matrices of sums over large frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# up to this many columns the sums are plain aggregate expressions
MAX_EXPRESSION_COLUMNS = 8


def pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def symmetric(values: Sequence[float], k: int) -> np.ndarray:
    """Full matrix from its upper triangle in :func:`pairs` order."""
    out = np.zeros((k, k))
    for (i, j), v in zip(pairs(k), values):
        out[i, j] = out[j, i] = v
    return out


def sum_vectors_of(*parts: tuple[DataFrame, int, Callable[[pd.DataFrame], np.ndarray]]) -> list[np.ndarray]:
    """For each (frame, size, function) the sum of a numpy vector over the batches of the frame, all by one job.

    Each partition ships ``size`` numbers.
    """
    frames, start = [], 0
    for df, size, batch_vector in parts:
        def partial(batches, start=start, size=size, batch_vector=batch_vector):
            out = np.zeros(size)
            for batch in batches:
                if len(batch):
                    out += batch_vector(batch)
            yield pd.DataFrame({"pos": np.arange(start, start + size), "value": out})

        frames.append(df.mapInPandas(partial, "pos int, value double"))
        start += size
    total = np.zeros(start)
    for r in reduce(DataFrame.unionAll, frames).groupBy("pos").agg(F.sum("value").alias("value")).collect():
        total[r["pos"]] = r["value"]
    return np.split(total, np.cumsum([size for _, size, _ in parts])[:-1])


def sum_vectors(df: DataFrame, size: int, batch_vector: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    return sum_vectors_of((df, size, batch_vector))[0]


def gram_part(df: DataFrame, weight: str, columns: Sequence[str]) -> tuple[DataFrame, int, Callable[[pd.DataFrame], np.ndarray]]:
    """Sum over rows of weight * x x' as a part of :func:`sum_vectors_of`; the matrix comes row by row."""
    def batch_vector(batch: pd.DataFrame) -> np.ndarray:
        values = batch.to_numpy(dtype=float)
        w, x = values[:, :1], values[:, 1:]
        return (x.T @ (w * x)).ravel()

    named = [c if c.isidentifier() else f"{c} AS y{i}" for i, c in enumerate(columns)]
    return df.selectExpr(f"{weight} AS weight", *named), len(columns) ** 2, batch_vector


def weighted_gram(df: DataFrame, weight: str, columns: Sequence[str]) -> np.ndarray:
    """Sum over rows of weight * x x', for SQL expressions ``weight`` and ``columns``."""
    k = len(columns)
    if k <= MAX_EXPRESSION_COLUMNS:
        sums = df.selectExpr(*[f"sum(({weight}) * ({columns[i]}) * ({columns[j]}))" for i, j in pairs(k)]).first()
        return symmetric([v or 0.0 for v in sums], k)

    return sum_vectors_of(gram_part(df, weight, columns))[0].reshape(k, k)


def independent(info: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Which terms add to the information of the terms before them: pivots of a Cholesky pass in order."""
    left, scale = info.astype(float).copy(), np.diag(info).copy()
    kept = np.zeros(len(info), bool)
    for i in range(len(info)):
        if scale[i] > 0 and left[i, i] > tolerance * scale[i]:
            kept[i] = True
            left -= np.outer(left[:, i], left[i]) / left[i, i]
    return kept
