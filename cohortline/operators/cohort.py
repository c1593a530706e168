"""Study populations: exclusions, case definitions, regimens, arms, infection history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import fixed_values as V
from cohortline.functions.columns import any_of, find, flag, relabel, total
from cohortline.operators.timejoin import earliest_per_key, forward_interval, seen_before

RECORD_ORDER = ["date", "source", "ranking", "code", "rec_id"]


# --- exclusions ---------------------------------------------------------------

def exclude(df: DataFrame, ids: DataFrame, key: str = "patient_id") -> DataFrame:
    """Drop the listed ids; rows without an id are kept."""
    return df.join(ids.select(key), key, "left_anti")


def keep(df: DataFrame, ids: DataFrame, key: str = "patient_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def id_union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, sets).distinct()


def id_intersection(sets: Sequence[DataFrame], key: str = "patient_id") -> DataFrame:
    """Ids found in every set, by one shuffle instead of a chain of joins."""
    marked = [s.select(key, F.lit(i).alias("_set")) for i, s in enumerate(sets)]
    hits = reduce(DataFrame.unionAll, marked).groupBy(key).agg(F.count_distinct("_set").alias("_n"))
    return hits.where(F.col("_n") == len(sets)).select(key)


def died_before(cohort: DataFrame, date: str = "index_date2", death: str = "death_date") -> Column:
    """False, not NULL, for patients without a death date: they stay in the cohort."""
    return F.coalesce(F.col(death) < F.col(date), F.lit(False))


def exclude_early_death(cohort: DataFrame, date: str = "index_date2", death: str = "death_date",
                        key: str = "patient_id") -> DataFrame:
    """Drop every row of a patient who died before the given date.

    The registry holds one row per patient; the id list still goes through an anti join so that
    repeated rows of a patient leave together.
    """
    return exclude(cohort, cohort.where(died_before(cohort, date, death)).select(key), key)


def adults(cohort: DataFrame, age: str = "age", minimum: int = V.ADULT_AGE, correction: int = 1) -> DataFrame:
    """Correct the recorded age and keep adults."""
    return cohort.withColumn(age, (F.col(age) - correction).cast("int")).where(F.col(age) >= minimum)


def prior_diagnosis(history: DataFrame, recent: DataFrame, pattern: str, cutoff: Column | None = None,
                    anchors: DataFrame | None = None, anchor: str = "index_date",
                    key: str = "patient_id") -> DataFrame:
    """Ids with any matching historical record, or a matching recent one before the cut-off.

    The cut-off is a constant or, with ``anchors``, each patient's own anchor date.
    """
    old = history.where(find(F.col("code"), pattern)).select(key)
    hits = recent.where(find(F.col("code"), pattern))
    if anchors is None:
        new = hits.where(F.col("date") < cutoff).select(key)
    else:
        new = seen_before(hits, anchors, key, anchor).select(key)
        old = keep(old, anchors, key)
    return id_union(old, new)


def is_listed_drug(bnf: str = V.TB_DRUG_BNF, items: str = V.TB_DRUG_ITEMS_PRIOR) -> Column:
    """Drug class (case-sensitive) and item code (any case)."""
    return find(F.col("bnf"), bnf) & find(F.col("item_cd"), items, ignore_case=True)


def drug_records(rx: DataFrame, bnf: str = V.TB_DRUG_BNF, items: str = V.TB_DRUG_ITEMS_PRIOR) -> DataFrame:
    return rx.where(is_listed_drug(bnf, items))


def prior_drug(history: DataFrame, recent: DataFrame, cutoff: Column | None = None,
               anchors: DataFrame | None = None, anchor: str = "index_date", bnf: str = V.TB_DRUG_BNF,
               items: str = V.TB_DRUG_ITEMS_PRIOR, key: str = "patient_id") -> DataFrame:
    """As :func:`prior_diagnosis`, for dispensings."""
    old = drug_records(history, bnf, items).select(key)
    hits = drug_records(recent, bnf, items)
    if anchors is None:
        new = hits.where(F.col("disp_date") < cutoff).select(key)
    else:
        new = seen_before(hits, anchors, key, anchor, date="disp_date").select(key)
        old = keep(old, anchors, key)
    return id_union(old, new)


def reason_hits(records: DataFrame, tests: Mapping[str, Column], date: str = "date", key: str = "patient_id") -> DataFrame:
    """One row per patient with any hit: a bit for each test that a history record meets, and the first recent day of each.

    All tests are one pass and one aggregate, combined before the shuffle; ``records`` has a boolean ``_old``.
    """
    bits = [F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests.values())]
    marked = records.select(key, F.col(date).alias("_day"), "_old", F.coalesce(total(bits), F.lit(0)).cast("long").alias("_hits")).where("_hits <> 0")
    recent = lambda i: F.when(~F.col("_old") & (F.getbit("_hits", F.lit(i)) == 1), F.col("_day"))
    hits = marked.groupBy(key).agg(
        F.bit_or(F.when(F.col("_old"), F.col("_hits")).otherwise(F.lit(0))).alias("_before"), *[F.min(recent(i)).alias(f"_since_{i}") for i in range(len(tests))])
    return hits.select(key, *[
        F.struct((F.getbit("_before", F.lit(i)) == 1).alias("before"), F.col(f"_since_{i}").alias("since")).alias(name) for i, name in enumerate(tests)])


def mark_reasons(cohort: DataFrame, reasons: Mapping[str, DataFrame], cutoff: Column, key: str = "patient_id") -> DataFrame:
    """The cohort with a boolean ``_has_<name>`` for each reason: a history hit, or a recent one before the cut-off.

    Each table of :func:`reason_hits` is joined once, whatever the number of reasons it answers.
    """
    tables: dict[int, tuple[DataFrame, list[str]]] = {}
    for name, hits in reasons.items():
        tables.setdefault(id(hits), (hits, []))[1].append(name)
    out = cohort
    for i, (hits, names) in enumerate(tables.values()):
        own = hits.select(F.col(key).alias(f"_key{i}"), *[F.col(n).alias(f"_hit_{n}") for n in names])
        out = out.join(own, F.col(key) == F.col(f"_key{i}"), "left").drop(f"_key{i}")
    found = {f"_has_{n}": F.coalesce(F.col(f"_hit_{n}.before"), F.lit(False)) | F.coalesce(F.col(f"_hit_{n}.since") < cutoff, F.lit(False)) for n in reasons}
    return out.withColumns(found).drop(*[f"_hit_{n}" for n in reasons])


def without_reasons(cohort: DataFrame, reasons: Mapping[str, DataFrame], cutoff: Column, key: str = "patient_id") -> DataFrame:
    """The rows that no reason excludes."""
    return mark_reasons(cohort, reasons, cutoff, key).where(~any_of([F.col(f"_has_{n}") for n in reasons])).select(*cohort.columns)


def study_exclusions(dx: DataFrame, rx: DataFrame) -> dict[str, DataFrame]:
    """Prior disease, metastases and drugs from record tables with ``_old``, each of them read once."""
    diagnoses = reason_hits(dx, {"disease": find(F.col("code"), V.TUBERCULOSIS_DX), "metastatic": find(F.col("code"), V.METASTATIC_DX)})
    drugs = reason_hits(rx, {"drug": is_listed_drug()}, "disp_date")
    return {"disease": diagnoses, "metastatic": diagnoses, "drug": drugs}


def mixed_brand_ids(cohort: DataFrame, first: str = "brand_1st", second: str = "brand_2nd",
                    key: str = "patient_id") -> DataFrame:
    return cohort.where(F.col(first) != F.col(second)).select(key).distinct()


def attrition(cohort: DataFrame, reasons: Sequence[tuple[str, Column | DataFrame]],
              key: str = "patient_id") -> DataFrame:
    """Rows left after each named step: each reason is a predicate or a set of ids to drop.

    The registry is scanned once. Every row gets the number of the first step that drops it and
    the counts after each step follow from one aggregate.
    """
    marked = cohort
    dropped_at = F.lit(len(reasons) + 1)
    for i, (_, reason) in reversed(list(enumerate(reasons, start=1))):
        if isinstance(reason, DataFrame):
            ids = reason.select(F.col(key).alias(f"_id{i}")).distinct()
            marked = marked.join(ids, F.col(key) == F.col(f"_id{i}"), "left")
            reason = F.col(f"_id{i}").isNotNull()
        dropped_at = F.when(F.coalesce(reason, F.lit(False)), F.lit(i)).otherwise(dropped_at)
    per_step = marked.groupBy(dropped_at.alias("_dropped_at")).agg(
        F.count(F.lit(1)).alias("_n"))
    names = ["registry", *[n for n, _ in reasons]]
    left = per_step.agg(*[F.coalesce(F.sum(F.when(F.col("_dropped_at") > i, F.col("_n"))), F.lit(0)).alias(f"n{i}")
                          for i in range(len(names))])
    rows = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(f"n{i}").alias("n_rows"))
                     for i, n in enumerate(names)])
    return left.select(F.inline(rows))


# --- cases ----------------------------------------------------------------------

def primary_inpatient() -> Column:
    return find(F.col("source"), V.INPATIENT) & (F.col("ranking") == V.PRIMARY)


def cases_earliest_first(dx: DataFrame, cohort: DataFrame, pattern: str = V.TUBERCULOSIS_DX,
                         ranking: str | None = V.PRIMARY, anchor: str = "index_date",
                         key: str = "patient_id") -> DataFrame:
    """Cohort rule: the earliest matching record at or after the anchor, whatever its setting.

    Callers test the setting afterwards, so a patient whose earliest record is an outpatient one
    is not a case. Records are reduced to one per patient and day before they meet the anchors.
    """
    hits = dx.where(find(F.col("code"), pattern))
    if ranking is not None:
        hits = hits.where(find(F.col("ranking"), ranking))
    daily = earliest_per_key(hits, [key, "date"], RECORD_ORDER[1:])
    after = daily.join(cohort, key).where(F.col("date") >= F.col(anchor))
    return earliest_per_key(after, [key], RECORD_ORDER)


def cases_filter_first(dx: DataFrame, cutoff: Column, pattern: str = V.TUBERCULOSIS_DX,
                       key: str = "patient_id") -> DataFrame:
    """Case-control rule: primary inpatient records from the cut-off on, then the earliest."""
    hits = dx.where(find(F.col("code"), pattern) & (F.col("date") >= cutoff)
                    & (F.col("source") == V.INPATIENT) & (F.col("ranking") == V.PRIMARY))
    return earliest_per_key(hits, [key], RECORD_ORDER)


def treatment_records(rx: DataFrame, cases: DataFrame, days: int = V.TREATMENT_WINDOW_DAYS,
                      after: Column | None = None, ignore_case_recode: bool = False,
                      key: str = "patient_id") -> DataFrame:
    """Distinct (patient, diagnosis date, dispensing date, drug) within ``days`` of the diagnosis.

    The combination products are recoded to RIFI by a lower-case pattern, so upper-case codes keep
    their own prefix unless ``ignore_case_recode`` is set.
    """
    hits = drug_records(rx, items=V.TB_DRUG_ITEMS_TREATMENT)
    if after is not None:
        hits = hits.where(F.col("disp_date") > after)
    combined = find(F.col("item_cd"), V.RIFI_RECODE, ignore_case=ignore_case_recode)
    drug = F.when(combined, "RIFI").otherwise(F.substring("item_cd", 1, 4))
    return forward_interval(hits.withColumn("drug", drug), cases.select(key, "date"), days, ["drug"], key)


def regimen_flags(cases: DataFrame, treatment: DataFrame, key: str = "patient_id") -> DataFrame:
    """Case rows plus one 0/1 column per regimen drug."""
    names = {d: d.lower() for d in V.REGIMEN_DRUGS}
    seen = treatment.groupBy(key).agg(
        *[F.max(find(F.col("drug"), d).cast("int")).alias(n) for d, n in names.items()])
    return cases.join(seen, key, "left").fillna(0, subset=list(names.values()))


def regimen_confirmed(flags: DataFrame, duplicate: bool = True) -> DataFrame:
    """Rows on either accepted combination.

    With ``duplicate`` a patient on both combinations appears twice (cohort script), otherwise
    once (case-control script).
    """
    third = (F.col("stre") == 1) | (F.col("etha") == 1)
    separate = (F.col("pyra") == 1) & (F.col("ison") == 1) & (F.col("rifa") == 1) & third
    combined = (F.col("pyra") == 1) & (F.col("rifi") == 1) & third
    if not duplicate:
        return flags.where(separate | combined)
    times = flag(separate) + flag(combined)
    return flags.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).drop("_copy")


def outcome_in_followup(cases: DataFrame, study_end: Column, anchor: str = "index_date2",
                        death: str = "death_date") -> DataFrame:
    """Primary inpatient cases from the anchor to death, or to the study end for the living."""
    last = F.coalesce(F.col(death), study_end)
    return cases.where(F.col("date").between(F.col(anchor), last) & primary_inpatient())


def event_between_doses(cases: DataFrame, first: str = "index_date", second: str = "index_date2") -> DataFrame:
    return cases.where((F.col("date") >= F.col(first)) & (F.col("date") < F.col(second)) & primary_inpatient())


def attach_event(cohort: DataFrame, events: DataFrame, flag_name: str, date_name: str,
                 key: str = "patient_id") -> DataFrame:
    """0/1 flag and date of the event. Repeated event rows repeat the cohort row."""
    own = events.select(key, F.col("date").alias(date_name))
    joined = cohort.join(own, key, "left")
    return joined.withColumn(flag_name, F.col(date_name).isNotNull().cast("int"))


def negative_control_cases(dx_recent: DataFrame, dx_history: DataFrame, cohort: DataFrame,
                           pattern: str = V.APPENDICITIS_DX, key: str = "patient_id") -> DataFrame:
    """Earliest matching record first, then patients with a historical match are dropped."""
    earliest = cases_earliest_first(dx_recent, cohort, pattern, ranking=None, key=key)
    return exclude(earliest, dx_history.where(find(F.col("code"), pattern)), key)


# --- exposure --------------------------------------------------------------------

def treatment_arm(first: str = "brand_1st", second: str = "brand_2nd", vaccinated: str = "vaccinated",
                  arms: Mapping[str, str] = V.BRAND_ARMS) -> Column:
    """Arm name if both doses are of one brand, None-arm if unvaccinated, otherwise NULL."""
    same = (F.col(first) == F.col(second)) & (F.col(vaccinated) == 1)
    return F.when(F.col(vaccinated) == 0, V.UNEXPOSED_ARM).when(same, relabel(F.col(first), arms))


def dose_status(df: DataFrame, date: str = "date", first: str = "date_1st", second: str = "date_2nd",
                strict: bool = False) -> DataFrame:
    """Dose-one and dose-two flags at a date.

    ``strict`` counts dose one only from the day after it was given (analysis script); dose two
    counts from its own day in both scripts.
    """
    begun = F.col(first) < F.col(date) if strict else F.col(first) <= F.col(date)
    had_first = flag(begun)
    had_second = flag((had_first == 1) & (F.col(second) <= F.col(date)))
    return df.withColumns({"vaccinated": had_first, "second_dose": had_second})


def exclude_between_doses(df: DataFrame) -> DataFrame:
    return df.where(~((F.col("vaccinated") == 1) & (F.col("second_dose") == 0)))


def brand_arm(df: DataFrame, brand: str = "brand_1st", brands: Sequence[str] = tuple(V.BRAND_ARMS)) -> DataFrame:
    """Brand in use at the date and one 0/1 column per brand."""
    arm = F.when(F.col("vaccinated") == 1, F.col(brand)).otherwise(V.UNEXPOSED_ARM)
    own = {f"brand_{i}": flag((F.col("vaccinated") == 1) & (F.col(brand) == b)) for i, b in enumerate(brands, 1)}
    return df.withColumns({"brand_arm": arm, **own})


def onset_since_dose(date: str = "admission_date", first: str = "date_1st", second: str = "date_2nd") -> Column:
    """Days since the latest counted dose, for the vaccinated."""
    latest = F.when(F.col("second_dose") == 1, F.col(second)).otherwise(F.col(first))
    return F.when(F.col("vaccinated") == 1, F.datediff(F.col(date), latest))


def first_positive_test(lab: DataFrame, key: str = "patient_id") -> DataFrame:
    """First positive test per patient. A test without a date sorts first and stays dateless."""
    positive = lab.where(find(F.col("t_num"), V.POSITIVE_TEST_CODES) & (F.col("result") == V.POSITIVE_RESULT))
    dates = positive.groupBy(key).agg(F.min("date").alias("_date"), F.count_if(F.col("date").isNull()).alias("_open"))
    return dates.select(key, F.when(F.col("_open") == 0, F.col("_date")).alias("infection_date"))


def infection_history(cohort: DataFrame, lab: DataFrame, anchor: str = "index_date2",
                      key: str = "patient_id") -> DataFrame:
    """0/1 history up to the anchor day and, for a later first infection, its date."""
    joined = cohort.join(first_positive_test(lab, key), key, "left")
    before = F.col("infection_date") <= F.col(anchor)
    return joined.withColumns({
        "infection_his": flag(before),
        "infection_after": F.when(F.col("infection_date") > F.col(anchor), F.col("infection_date")),
    }).drop("infection_date")


def infection_before(df: DataFrame, lab: DataFrame, date: str = "admission_date", key: str = "patient_id") -> DataFrame:
    """0/1: first infection strictly before the date."""
    joined = df.join(first_positive_test(lab, key), key, "left")
    return joined.withColumn("infection", flag(F.col("infection_date") < F.col(date))).drop("infection_date")
