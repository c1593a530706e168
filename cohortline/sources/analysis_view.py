"""Analysis frame over the test tables: one row per patient with arm, follow-up and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.functions.columns import find, flag
from cohortline.operators import cohort as C
from cohortline.operators import followup as U
from cohortline.operators.timejoin import first_on_or_after
from cohortline.sources import driver_views as D

ARMS = {"BrandA": "BrandA", "BrandB": "BrandB"}


def analysis(spark: SparkSession, folder: str) -> DataFrame:
    people = C.exclude_early_death(D.patients(spark, folder))
    hits = D.dx(spark, folder).where(find(F.col("code"), "^0[0-4]"))
    events = first_on_or_after(hits, people.select("patient_id", "index_date2"))
    df = people.join(events, "patient_id", "left").withColumn("crossover_date", U.late_crossover_date())
    df = U.censor_dates(df, {"censor_date": "event_date"}, F.to_date(F.lit(D.STUDY_END)),
                        ["death_date", "crossover_date"])
    return df.select(
        "patient_id", "age", "sex", C.treatment_arm(arms=ARMS).alias("arm"),
        "index_date2", "event_date", "death_date", "censor_date",
        U.followup_days("censor_date").alias("time"),
        flag(F.col("event_date") == F.col("censor_date")).alias("status"),
        U.death_flag().alias("death"),
        F.expr("CAST(0.5 + (patient_id % 10) * 0.1 AS DOUBLE)").alias("w"),
    )
