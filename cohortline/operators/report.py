"""Result tables of fits and named books of results."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.functions.fixed_values import Z_95
from cohortline.operators.survival import CoxFit, coefficient_rows
from cohortline.sources.tables import write_book

#: The list of a book's complete versions, and its columns.
LIST = "versions"
ENTRIES = "version string, name string, kind string"
COEFFICIENTS = "term string, estimate double, std_error double, robust_se double, statistic double, p_value double"


def wald_interval(table: DataFrame) -> DataFrame:
    """Exponentiated 95 % limits per term from the reported standard error."""
    se = F.coalesce("robust_se", "std_error")
    return table.select("term", F.exp(F.col("estimate") - Z_95 * se).alias("lower"),
                        F.exp(F.col("estimate") + Z_95 * se).alias("upper"))


def coef_table(spark: SparkSession, fit: CoxFit) -> DataFrame:
    """One row per term: estimate, its exponential, errors, test and limits, and how the fit ended.

    A term without an estimate has NULL there.
    """
    table = spark.createDataFrame(coefficient_rows(fit), COEFFICIENTS)
    table = table.withColumn("exp_estimate", F.exp("estimate"))
    return table.join(wald_interval(table), "term").select(
        "term", "estimate", "exp_estimate", "std_error", "robust_se", "statistic", "p_value", "lower", "upper",
        F.lit(fit.n).cast("long").alias("n"), F.lit(fit.events).cast("long").alias("events"),
        F.lit(fit.iterations).cast("int").alias("iterations"), F.lit(bool(fit.converged)).alias("converged"))


def result_book(tables: Mapping[str, DataFrame], base: str, kind: str = "csv") -> str:
    """Write a named list of result tables as a new version of the book; returns the version's name.

    The tables go to a folder of their own, and the entry in the book's list comes last. A run that breaks off leaves a folder
    that no list names, and the former version stays the one that is read.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    write_book(tables, f"{base}/{version}", kind)
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, name, kind) for name in tables], ENTRIES).coalesce(1).write.mode("append").parquet(f"{base}/{LIST}")
    return version


def book_versions(spark: SparkSession, base: str) -> DataFrame:
    """Rows (version, name, kind) of all complete versions; names sort by the time of writing."""
    try:
        return spark.read.schema(ENTRIES).parquet(f"{base}/{LIST}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRIES)


def read_book(spark: SparkSession, base: str, name: str, version: str | None = None) -> DataFrame:
    """A table of the newest complete version of a book, or of a given one."""
    entries = book_versions(spark, base)
    wanted = entries.where(F.col("version") == version) if version else entries
    newest = wanted.agg(F.max("version")).first()[0]
    found = wanted.where((F.col("version") == newest) & (F.col("name") == name)).first()
    if found is None:
        raise FileNotFoundError(f"no complete version of {base} has a table {name}")
    path = f"{base}/{newest}/{name}"
    return spark.read.parquet(path) if found["kind"] == "parquet" else spark.read.option("header", True).csv(path)
