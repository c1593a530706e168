"""Censoring, follow-up time and event status."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import fixed_values as V
from cohortline.functions.columns import flag
from cohortline.operators.timejoin import earliest_per_key


def risk_window_outcome(df: DataFrame, days: int = V.RISK_WINDOW_DAYS, event: str = "event_date",
                        anchor: str = "index_date2") -> DataFrame:
    """Event date and flag counted only from ``days`` days after the anchor."""
    late = F.datediff(F.col(event), F.col(anchor)) >= days
    return df.withColumns({"event_date_late": F.when(late, F.col(event)), "event_late": flag(late)})


def late_crossover_date(vaccinated: str = "vaccinated", brand: str = "brand_1st", date: str = "date_1st") -> Column:
    """First dose of those unvaccinated at baseline."""
    return F.when((F.col(vaccinated) == 0) & F.col(brand).isNotNull(), F.col(date))


def censor_dates(df: DataFrame, variants: Mapping[str, str | None], study_end: Column,
                 common: Sequence[str]) -> DataFrame:
    """One censoring date per variant: the least of study end, its event date and the common dates."""
    out = {}
    for name, event in variants.items():
        dates = [F.col(c) for c in ([event] if event else []) + list(common)]
        out[name] = F.least(study_end, *dates)
    return df.withColumns(out)


def followup_days(censor: str, anchor: str = "index_date2") -> Column:
    """Days under observation, the anchor day included."""
    return (F.datediff(F.col(censor), F.col(anchor)) + 1).cast("int")


def death_flag(death: str = "death_date", anchor: str = "index_date2") -> Column:
    return flag(F.col(death) > F.col(anchor))


def competing_event(df: DataFrame, event: str = "status", death: str = "death", time_event: str = "time",
                    time_other: str = "time_death", key: str = "patient_id",
                    order: Sequence[str] = ("event_date",)) -> DataFrame:
    """One row per patient: status 1 event, 2 death, 0 censored, with the matching time."""
    first = earliest_per_key(df, [key], order)
    had = F.col(event) == 1
    return first.withColumns({
        "etime": F.when(had, F.col(time_event)).otherwise(F.col(time_other)),
        "estatus": F.when(had, 1).otherwise(2 * F.col(death)).cast("int"),
    })


def split_followup(df: DataFrame, cuts: Sequence[int] = tuple(V.SPLIT_DAYS), time: str = "time",
                   status: str = "status") -> DataFrame:
    """Cut follow-up into episodes (tstart, tstop]; the event belongs to the last one."""
    bounds = [0, *cuts]
    ends = [*cuts, None]
    parts = F.array(*[
        F.when(F.col(time) > lo, F.struct(
            F.lit(lo).alias("tstart"),
            (F.col(time) if hi is None else F.least(F.col(time), F.lit(hi))).cast("int").alias("tstop"),
            F.lit(i).alias("period")))
        for i, (lo, hi) in enumerate(zip(bounds, ends), start=1)
    ])
    episodes = df.withColumn("_part", F.explode(F.filter(parts, lambda p: p.isNotNull())))
    last = F.col("_part.tstop") == F.col(time)
    return episodes.select(
        *[c for c in df.columns if c not in (time, status)],
        "_part.tstart", "_part.tstop", "_part.period",
        F.when(last, F.col(status)).otherwise(0).cast("int").alias(status))
