"""The case-control study end to end: population, matching, covariates, tables, models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.functions import columns as X
from cohortline.functions import fixed_values as V
from cohortline.functions.sizing import cut_lineage
from cohortline.operators import cohort as C
from cohortline.operators import describe as B
from cohortline.operators import matching as M
from cohortline.operators import phenotype as P
from cohortline.operators import survival as Y
from cohortline.operators import timejoin as T
from cohortline.operators.report import coef_table
from cohortline.sources.tables import StudyTables, clean_registry, rules_named

REGISTRY = ["patient_id", "age", "sex", "brand_1st", "date_1st", "brand_2nd", "date_2nd", "death_date"]


def population(t: StudyTables, start: Column) -> DataFrame:
    """Registry without mixed brands, prior disease, prior drugs and metastases before the start."""
    people = clean_registry(t.registry).where(F.col("patient_id").isNotNull())
    people = people.withColumn("age", (F.col("age") - 1).cast("int"))
    people = C.exclude(people, C.mixed_brand_ids(people))
    return C.without_reasons(people, C.study_exclusions(*t.by_age()), start)


def verified_cases(t: StudyTables, people: DataFrame, start: Column, pattern: str = V.TUBERCULOSIS_DX,
                   records: DataFrame | None = None) -> DataFrame:
    """Earliest primary inpatient record, confirmed by a regimen; one row per case."""
    first = C.keep(C.cases_filter_first(t.dx_recent if records is None else records, start, pattern), people)
    treated = C.treatment_records(t.rx_recent, first, after=start)
    return C.regimen_confirmed(C.regimen_flags(first, treated), duplicate=False)


def case_control_rows(t: StudyTables, start: str = V.CASE_CONTROL_START, pattern: str = V.TUBERCULOSIS_DX,
                      cases: DataFrame | None = None) -> DataFrame:
    """Cases and control records of adults of known sex, none of them between two doses."""
    begin = F.to_date(F.lit(start))
    people = cut_lineage(population(t, begin).select(*REGISTRY))
    records = M.inpatient_records(t.dx_recent, begin)
    cases = cut_lineage(verified_cases(t, people, begin, pattern, records) if cases is None else C.keep(cases, people))
    pool = M.control_pool(records, people, cases, begin, pattern)
    stacked = M.stack_case_control(cases.select("patient_id", "date"), pool.select("patient_id", "date"))
    known = people.where(F.col("sex").isin("M", "F") & (F.col("age") >= V.ADULT_AGE))
    rows = C.dose_status(stacked.join(known, "patient_id"))
    return C.exclude_between_doses(rows)


def matched_rows(rows: DataFrame, registry: DataFrame, **gaps) -> DataFrame:
    """Cases and their drawn controls, both dated by the case's admission."""
    matched = cut_lineage(M.match_controls(rows, **gaps))
    long = M.drawn_controls(matched)
    people = registry.withColumn("age", (F.col("age") - 1).cast("int")).select(*REGISTRY)
    controls = M.attach_registry(long, people).withColumnRenamed("case_id", "match")
    cases = rows.where("tb = 1").select("date", *REGISTRY, F.col("patient_id").alias("match"))
    out = cases.unionByName(controls.select(cases.columns)).withColumnRenamed("date", "admission_date")
    out = C.dose_status(out, "admission_date", strict=True).withColumn("tb", M.case_label())
    return out


def with_covariates(t: StudyTables, rows: DataFrame, brands: Sequence[str] = tuple(V.BRAND_ARMS)) -> DataFrame:
    """History per (patient, admission), contacts per (patient, set), infection, onset and age group."""
    rows = cut_lineage(rows)
    keys = ["patient_id", "admission_date"]
    own = rows.select(*keys).distinct()
    dx = P.comorbidity_index(P.history_flags(t.dx(), own, rules_named(t.class_rules, "dx"), anchor="admission_date"))
    rx = t.rx()
    classes = P.episode_flags(rx, own, rules_named(t.class_rules, "rx"), "bnf", V.EPISODE_LOOKBACK_DAYS, keys,
                              "admission_date", inclusive=True)
    items = P.episode_flags(rx, own, t.item_rules, "item_cd", V.EPISODE_LOOKBACK_DAYS, keys, "admission_date",
                            inclusive=True)
    contacts = T.window_counts(t.encounters(), rows, V.ENCOUNTER_CLASSES, V.UTILISATION_DAYS,
                               ["patient_id", "match"], anchor="admission_date")
    out = C.infection_before(rows, t.lab)
    for part, on in ((dx, keys), (classes, keys), (items, keys), (contacts, ["patient_id", "match"])):
        out = out.join(part, on)
    out = C.brand_arm(out, brands=brands)
    out = out.withColumns({"onset_time": C.onset_since_dose(), "agegroup": X.age_group(F.col("age"))})
    return cut_lineage(out)


def model_terms(df: DataFrame, adjusted: bool, absent: Sequence[str] = ()) -> dict[str, str]:
    """Brands, and with adjustment all covariates but those named absent."""
    brand = {c: c for c in X.present(df, ("brand_2", "brand_1"), absent)}
    if not adjusted:
        return brand
    more = [*V.SCORE_DX, *V.SCORE_RX, *V.SCORE_UTILISATION, "infection"]
    return {**brand, **{c: c for c in X.present(df, more, absent)}}


def populations(df: DataFrame) -> dict[str, DataFrame]:
    recent_out = cut_lineage(M.drop_recent_sets(df))
    out = {}
    for prefix, rows in (("", df), ("late_", recent_out)):
        out[f"{prefix}all"] = rows
        out[f"{prefix}male"] = rows.where(F.col("sex") == "M")
        out[f"{prefix}female"] = rows.where(F.col("sex") == "F")
        out[f"{prefix}adult"] = rows.where(F.col("age").between(V.ADULT_AGE, V.OLD_AGE - 1))
        out[f"{prefix}old"] = rows.where(F.col("age") >= V.OLD_AGE)
    return out


def model_book(spark: SparkSession, df: DataFrame) -> dict[str, DataFrame]:
    """Crude and adjusted models overall and by subgroup; adjusted ones without early onsets."""
    book = {}
    for name, rows in populations(df).items():
        for adjusted in (True,) if name.startswith("late_") else (False, True):
            fit = Y.clogit(rows, "tb", model_terms(rows, adjusted))
            book[f"{name}_{'adjusted' if adjusted else 'crude'}"] = coef_table(spark, fit)
            fit.close()
    return book


def table_book(spark: SparkSession, df: DataFrame) -> dict[str, DataFrame]:
    """Baseline by brand for cases and controls; brand by outcome, sex and age group with tests."""
    flags = X.present(df, [*V.TABLE_DX, "dx_crf", "dx_cancer_mets", *V.SCORE_DX, *V.SCORE_RX, "infection"])
    categorical: Mapping = {"sex": ["F", "M"], **{c: [0, 1] for c in flags}}
    book = {}
    for name, tb in (("cases", 1), ("controls", 0)):
        table = B.table_one(df.where(F.col("tb") == tb), "brand_arm", ["age", *V.SCORE_UTILISATION], categorical)
        book[f"baseline_{name}"], book[f"balance_{name}"] = table, B.smd(spark, table)
    for name, rows in (("brands", df), ("brands_late", M.drop_recent_sets(df))):
        table = B.contingency(rows, "brand_arm", [["tb"], ["tb", "sex"], ["tb", "agegroup"]])
        book[name], book[f"{name}_chisq"] = table, B.chisq_test(table)
    return book
