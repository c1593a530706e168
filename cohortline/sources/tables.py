"""Readers and writers of the linked study tables (Parquet and CSV datasets)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.functions.columns import blank_to_date, fill_union, month_to_date, plain_names


MAX_ONE_FILE = 100_000


class Rule(NamedTuple):
    """One codebook row: the covariate it defines and the pattern of its codes."""

    name: str
    regex: str


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_bundle(spark: SparkSession, base: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Several named tables stored side by side under one folder."""
    return {name: spark.read.parquet(f"{base}/{name}") for name in names}


def read_years(spark: SparkSession, base: str, years: Sequence[int], column: str = "year") -> DataFrame:
    """Chosen yearly partitions as one table; the filter prunes the other partitions."""
    return spark.read.parquet(base).where(F.col(column).isin(list(years))).drop(column)


def write_years(records: DataFrame, base: str, date: str, column: str = "year") -> None:
    """Records partitioned by the year of ``date``; a year of many records is split over several files and tasks."""
    dated = records.withColumn(column, F.year(date))
    dated.hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(base)


def read_lookback(spark: SparkSession, base: str, anchors: DataFrame, anchor: str, days: int, column: str = "year") -> DataFrame:
    """The yearly partitions that any look-back of ``days`` before an anchor reaches into; others are not opened.

    The years come from the anchors when the query runs: a calendar's worth of them prunes the scan.
    """
    first, last = F.year(F.date_sub(anchor, days)), F.year(anchor)
    years = anchors.where(last > 0).select(F.explode(F.sequence(first, last)).alias(column)).distinct()
    return spark.read.parquet(base).join(F.broadcast(years), column, "left_semi").drop(column)


def clean_registry(registry: DataFrame) -> DataFrame:
    """Column names without special characters, and dates given as text read as dates, where blank means unknown."""
    named = plain_names(registry)
    texts = [c for c, kind in named.dtypes if kind == "string" and "date" in c.lower()]
    return named.withColumns({c: blank_to_date(F.col(c)) for c in texts})


def read_codebook(spark: SparkSession, path: str) -> list[Rule]:
    """A codebook stored as CSV with a header row holding ``name`` and ``regex``."""
    return codebook(spark.read.option("header", True).csv(path))


def codebook(rules: DataFrame) -> list[Rule]:
    """Rules become columns, in blocks, so a codebook, which people write, is read into the plan."""
    return [Rule(r["name"], r["regex"]) for r in rules.select("name", "regex").collect()]


def rules_named(rules: Sequence[Rule], part: str) -> list[Rule]:
    """The rules whose name contains ``part`` (diagnosis rules: dx, drug rules: rx)."""
    return [r for r in rules if part in r.name]


def combine_history(history: DataFrame, recent: DataFrame, month: str, date: str) -> DataFrame:
    """Impute the month column of the history, align both tables and stack them.

    A column that the history lacks is NULL there; one that only the history has is left out.
    """
    dated = history.withColumn(date, month_to_date(F.col(month)))
    return fill_union(recent, dated.select([c for c in recent.columns if c in dated.columns]))


def both_ages(history: DataFrame, recent: DataFrame, columns: Sequence[str], date: str, key: str = "patient_id") -> DataFrame:
    """History and recent records as one table; ``_old`` tells the history, whose date is not needed."""
    old = history.select(key, *columns, F.lit(None).cast("date").alias(date), F.lit(True).alias("_old"))
    return old.unionAll(recent.select(key, *columns, date, F.lit(False).alias("_old")))


def with_end_date(rx: DataFrame, start: str = "disp_date", days: str = "days", end: str = "end_date") -> DataFrame:
    """Episode end = dispensing date + duration."""
    return rx.withColumn(end, F.date_add(F.col(start), F.col(days).cast("int")))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_book(tables: Mapping[str, DataFrame], base: str, kind: str = "csv") -> None:
    """One dataset per named result table; a table of at most ``MAX_ONE_FILE`` rows is one CSV file."""
    for name, df in tables.items():
        if kind == "csv":
            one = df.limit(MAX_ONE_FILE + 1).count() <= MAX_ONE_FILE
            (df.coalesce(1) if one else df).write.mode("overwrite").option("header", True).csv(f"{base}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{base}/{name}")


@dataclass(frozen=True)
class StudyTables:
    """The linked tables of a study. History tables hold months, recent tables days.

    registry: patient_id, age, sex, vaccinated, brand_1st, brand_2nd, date_1st, date_2nd,
    index_date, index_date2, death_date. dx: patient_id, rec_id, date (date_ym), code, source,
    ranking. rx: patient_id, rec_id, item_cd, bnf, days, disp_date (disp_ym). encounters:
    patient_id, rec_id, date (date_ym), source. lab: patient_id, date, t_num, result.
    """

    registry: DataFrame
    dx_hist: DataFrame
    dx_recent: DataFrame
    rx_hist: DataFrame
    rx_recent: DataFrame
    enc_hist: DataFrame
    enc_recent: DataFrame
    lab: DataFrame
    class_rules: list[Rule]
    item_rules: list[Rule]

    def dx(self) -> DataFrame:
        return combine_history(self.dx_hist, self.dx_recent, "date_ym", "date")

    def rx(self) -> DataFrame:
        return with_end_date(combine_history(self.rx_hist, self.rx_recent, "disp_ym", "disp_date"))

    def by_age(self) -> tuple[DataFrame, DataFrame]:
        """Diagnoses and dispensings with ``_old`` for the history, whose months are not needed to exclude a patient."""
        dx = both_ages(self.dx_hist, self.dx_recent, ["code"], "date")
        return dx, both_ages(self.rx_hist, self.rx_recent, ["bnf", "item_cd"], "disp_date")

    def encounters(self) -> DataFrame:
        return combine_history(self.enc_hist, self.enc_recent, "date_ym", "date")
