"""Tail probabilities of test statistics: of single numbers, and of columns inside a plan."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_upper(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees of freedom > x), by the finite recurrence in df."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2 == 0:
        tail, power, start = math.exp(-half), 1.0, 2
    else:
        tail, power, start = math.erfc(math.sqrt(half)), 0.5, 1
    for k in range(start, df, 2):
        tail += math.exp((k / 2.0) * math.log(half) - half - math.lgamma(k / 2.0 + 1.0))
    return tail


def _log_gamma_half(df: Column) -> Column:
    """ln of gamma(df / 2) for a whole df from 1 on: gamma(1) or gamma(1/2) times the steps up to it."""
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor((df - 1) / 2).cast("int"))), lambda i: F.log(F.abs(df / 2.0 - i)))
    climbed = F.when(df > 2, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)
    return climbed + F.when(df % 2 == 1, math.log(math.pi) / 2).otherwise(0.0)


def chi2_tail(x: Column, df: Column, terms: int = 200) -> Column:
    """P(chi-square with ``df`` whole degrees of freedom > x), as a column; NULL where either is, or df is not positive.

    The regularised incomplete gamma function: its series below the mean, its continued fraction above.
    """
    df = F.when(df > 0, df.cast("double"))
    z = F.when(x.isNotNull(), F.greatest(x.cast("double"), F.lit(0.0))) / 2.0
    a = df / 2.0
    many = F.sequence(F.lit(1), (F.lit(terms) + df).cast("int"))
    scale = F.exp(a * F.log(z) - z - _log_gamma_half(df))

    term = F.lit(1.0) / a
    summed = F.aggregate(
        many, F.struct(term.alias("t"), term.alias("s")),
        lambda p, i: F.struct((p["t"] * z / (a + i)).alias("t"), (p["s"] + p["t"] * z / (a + i)).alias("s")))
    below = 1.0 - scale * summed["s"]

    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def fraction(p: Column, i: Column) -> Column:
        step, b = -1.0 * i * (i - a), z + 1.0 - a + 2.0 * i
        d, c = 1.0 / safe(step * p["d"] + b), safe(b + step / p["c"])
        return F.struct(c.alias("c"), d.alias("d"), (p["h"] * c * d).alias("h"))

    first = 1.0 / safe(z + 1.0 - a)
    start = F.struct(F.lit(1.0 / tiny).alias("c"), first.alias("d"), first.alias("h"))
    above = scale * F.aggregate(many, start, fraction)["h"]
    tail = F.when(z == 0, 1.0).when(z < a + 1.0, below).otherwise(above)
    return F.when(df.isNotNull() & z.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def normal_tail(z: Column) -> Column:
    """P(|standard normal| > |z|), as a column."""
    return chi2_tail(z * z, F.lit(1))
