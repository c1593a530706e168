"""Follow-up summaries and incidence rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions.fixed_values import CHI2_95_1DF, DAYS_PER_YEAR, RATE_SCALE

NEWTON_STEPS = 40


def _per_day(df: DataFrame, keys: Sequence[str], event: str, time: str) -> DataFrame:
    """Rows and events per key and follow-up day: all that rates and quantiles need.

    Follow-up is in whole days, so a hot arm shrinks to one row per day before any quantile.
    """
    return df.dropna(subset=[*keys, time]).groupBy(*keys, F.col(time).alias("_t")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(event) == 1).alias("_d"))


def _quantile(p: float) -> Column:
    return F.percentile("_t", F.lit(p), F.col("_n"))


def _summary(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    years = F.bround(F.sum(F.col("_t") * F.col("_n")) / F.lit(DAYS_PER_YEAR), 1)
    return days.groupBy(*keys).agg(
        F.sum("_d").alias("n_event"), F.sum("_n").alias("n"),
        _quantile(0.5).alias("median_time"), _quantile(0.25).alias("q25_time"), _quantile(0.75).alias("q75_time"),
        years.alias("person_years"))


def followup_quantiles(df: DataFrame, keys: Sequence[str], event: str = "status", time: str = "time") -> DataFrame:
    """Median and quartiles (type 7) of follow-up per group."""
    return _summary(_per_day(df, keys, event, time), keys).select(
        *keys, "n", "median_time", "q25_time", "q75_time")


def profile_limit(n: Column, side: int) -> Column:
    """Limit of the expected count from the Poisson profile: 2 [n log(n/m) - (n - m)] = chi2(95 %).

    Solved for log m by Newton steps from outside the interval, where the convex profile makes them
    monotone.
    """
    n = n.cast("double")
    half = F.lit(CHI2_95_1DF / 2)
    start = F.log(n) - 1 - half / n if side < 0 else F.log(n) + F.sqrt(2 * half / n)

    def step(theta: Column, _: Column) -> Column:
        slope = F.exp(theta) - n
        value = n * F.log(n) - n * theta - n + F.exp(theta) - half
        return theta - value / slope

    return F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step))


def _number(c: Column) -> Column:
    """Number as text without a trailing .0"""
    return F.regexp_replace(c.cast("string"), "[.]0$", "")


def _with_rates(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rates per 10,000 person-years; groups without an event are left out.

    Person-years are rounded to 0.1 before dividing, as in the published tables.
    """
    per = lambda c: F.bround(F.try_divide(c, F.col("person_years")) * RATE_SCALE, 2)
    had = summary.where("n_event > 0")
    rates = had.select(
        *keys, "n_event", "n", "median_time", "q25_time", "q75_time", "person_years",
        per(F.col("n_event")).alias("rate"), per(profile_limit(F.col("n_event"), -1)).alias("rate_low"),
        per(profile_limit(F.col("n_event"), 1)).alias("rate_high"))
    return rates.withColumns({
        "followup_text": F.concat(_number(F.col("median_time")), F.lit(" ("), _number(F.col("q25_time")), F.lit(", "),
                                  _number(F.col("q75_time")), F.lit(")")),
        "rate_text": F.concat(_number(F.col("rate")), F.lit("("), _number(F.col("rate_low")), F.lit(", "),
                              _number(F.col("rate_high")), F.lit(")")),
    })


def incidence_rates(df: DataFrame, event: str = "status", time: str = "time", arm: str = "arm") -> DataFrame:
    """Per arm: events, rows, follow-up, person-years, rate and its profile interval."""
    return _with_rates(_summary(_per_day(df, [arm], event, time), [arm]), [arm])


def subgroup_rates(df: DataFrame, subgroups: Mapping[str, Column], event: str = "status", time: str = "time",
                   arm: str = "arm") -> DataFrame:
    """The rates of the whole population and of each subgrouping, from one pass over the rows.

    A subgrouping is a column whose values are the subgroups; NULL belongs to none.
    """
    names = list(subgroups)
    marked = df.withColumns({f"_g_{n}": c for n, c in subgroups.items()}).dropna(subset=[arm, time])
    days = marked.groupBy(arm, *[f"_g_{n}" for n in names], F.col(time).alias("_t")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(event) == 1).alias("_d"))
    labels = F.array(
        F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("subgroup")),
        *[F.struct(F.lit(n).alias("grouping"), F.col(f"_g_{n}").cast("string").alias("subgroup")) for n in names])
    long = days.select(arm, "_t", "_n", "_d", F.inline(labels)).where("subgroup IS NOT NULL")
    keys = ["grouping", "subgroup", arm]
    return _with_rates(_summary(long, keys), keys)
