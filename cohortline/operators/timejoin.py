"""Joins between a patient's records and the dates that anchor the study.

A patient may own a large share of all records. Each operator therefore first reduces the
records with an aggregate that Spark combines on the map side (one row per patient, or one per
patient and day), so that what is shuffled for one patient is bounded by the calendar and not by
the number of records.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.functions.columns import find, flag


def earliest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key under a total order. The rank limit is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def attach_anchor(records: DataFrame, anchors: DataFrame, key: str = "patient_id") -> DataFrame:
    """Every record with its patient's anchor columns (inner join)."""
    return records.join(anchors, key)


def seen_before(records: DataFrame, anchors: DataFrame, key: str = "patient_id",
                anchor: str = "index_date", date: str = "date") -> DataFrame:
    """Anchor rows with at least one record strictly before the anchor."""
    first = records.groupBy(key).agg(F.min(date).alias("_first"))
    return anchors.join(first, key).where(F.col("_first") < F.col(anchor)).drop("_first")


def first_on_or_after(records: DataFrame, anchors: DataFrame, key: str = "patient_id",
                      anchor: str = "index_date2", date: str = "date",
                      name: str = "event_date") -> DataFrame:
    """Earliest record date at or after the anchor, per patient that has one."""
    days = records.select(key, date).distinct()
    return (
        anchors.select(key, anchor).join(days, key)
        .where(F.col(date) >= F.col(anchor))
        .groupBy(key).agg(F.min(date).alias(name))
    )


def forward_interval(records: DataFrame, anchors: DataFrame, days: int, keep: Sequence[str],
                     key: str = "patient_id", anchor: str = "date", date: str = "disp_date") -> DataFrame:
    """Distinct (anchor row, kept record columns) with anchor <= record date < anchor + days."""
    daily = records.select(key, date, *keep).distinct()
    inside = (F.col(date) >= F.col(anchor)) & (F.col(date) < F.date_add(F.col(anchor), days))
    return anchors.join(daily, key).where(inside)


def in_reach(records: DataFrame, anchors: DataFrame, lookback: int, anchor: str = "index_date",
             start: str = "disp_date", end: str = "end_date") -> DataFrame:
    """Episodes that may overlap the look-back of some anchor: none that ended before the first one's or starts after the last.

    The bounds come from the anchors when the query is planned; as a condition on the records they go down to the scan, before
    any join or shuffle. ``anchors`` is read once for them and should be cheap to read.
    """
    first, last = anchors.agg(F.min(anchor), F.max(anchor)).first()
    if first is None:
        return records.where(F.lit(False))
    return records.where((F.col(start) <= F.lit(last)) & (F.col(end) >= F.date_sub(F.lit(first), lookback)))


def episode_overlap(records: DataFrame, anchors: DataFrame, flags: Mapping[str, Column], lookback: int,
                    anchor_keys: Sequence[str], key: str = "patient_id", anchor: str = "index_date",
                    start: str = "disp_date", end: str = "end_date", inclusive: bool = False) -> DataFrame:
    """0/1 per flag: an episode started before the anchor and reaches into the look-back days.

    ``inclusive`` also accepts an episode that starts on the anchor day. Per patient and start day only the latest end can
    decide, so records are reduced to that first. Along a patient's days the latest end so far is carried to the anchors, so
    the work is linear in days and anchors.
    """
    daily = records.groupBy(key, start).agg(*[F.max(F.when(c, F.col(end))).alias(n) for n, c in flags.items()])
    return carried_overlap(daily, anchors, {n: F.col(n) for n in flags}, lookback, anchor_keys, key, anchor, start, inclusive)


def carried_overlap(daily: DataFrame, anchors: DataFrame, ends: Mapping[str, Column], lookback: int, anchor_keys: Sequence[str],
                    key: str = "patient_id", anchor: str = "index_date", start: str = "disp_date", inclusive: bool = False) -> DataFrame:
    """As :func:`episode_overlap`, from rows per patient and start day; ``ends`` gives each flag's latest end in a row.

    A day may have several rows: the expressions are evaluated along a patient's days, after the one shuffle that brings
    them together with the anchors.
    """
    inputs = [c for c in daily.columns if c not in (key, start)]
    daily = daily.where(F.col(key).isNotNull() & F.col(start).isNotNull()).select(
        F.col(key).alias("_key"), F.col(start).alias("_day"), *inputs)
    own = anchors.select(*anchor_keys).distinct().select(
        F.col(key).alias("_key"), F.col(anchor).alias("_day"), F.struct(*anchor_keys).alias("_own"))
    first, second = (daily, own) if inclusive else (own, daily)
    rows = first.withColumn("_order", F.lit(0)).unionByName(second.withColumn("_order", F.lit(1)), allowMissingColumns=True)
    so_far = Window.partitionBy("_key").orderBy("_day", "_order").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.select("_own", "_day", *[F.max(e).over(so_far).alias(f"_end_{n}") for n, e in ends.items()]).where("_own IS NOT NULL")
    limit = F.date_sub("_day", lookback)
    return carried.select("_own.*", *[flag(F.col(f"_end_{n}") >= limit).alias(n) for n in ends])


def window_counts(records: DataFrame, anchors: DataFrame, classes: Mapping[str, str], days: int,
                  anchor_keys: Sequence[str], key: str = "patient_id", anchor: str = "index_date",
                  date: str = "date", source: str = "source") -> DataFrame:
    """Records per class strictly inside (anchor - days, anchor); 0 where there are none.

    Duplicate anchor rows count the same contacts again, as a join on them would.
    """
    daily = records.groupBy(key, date).agg(
        *[F.count_if(find(F.col(source), p)).alias(f"_n_{n}") for n, p in classes.items()])
    inside = (F.col(date) < F.col(anchor)) & (F.col(date) > F.date_sub(F.col(anchor), days))
    joined = anchors.select(*{**dict.fromkeys(anchor_keys), key: None, anchor: None}).join(
        daily.withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & inside, "left")
    return joined.groupBy(*anchor_keys).agg(
        *[F.coalesce(F.sum(f"_n_{n}"), F.lit(0)).cast("long").alias(n) for n in classes])
