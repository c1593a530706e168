"""The cohort study end to end: population, outcomes, covariates, weights, models, tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.functions import columns as X
from cohortline.functions import fixed_values as V
from cohortline.functions.sizing import cut_lineage
from cohortline.operators import cohort as C
from cohortline.operators import describe as B
from cohortline.operators import followup as U
from cohortline.operators import phenotype as P
from cohortline.operators import propensity as Q
from cohortline.operators import rates as R
from cohortline.operators import survival as Y
from cohortline.operators import timejoin as T
from cohortline.operators.report import coef_table
from cohortline.sources.tables import StudyTables, clean_registry, rules_named

OUTCOMES = {"tb": "time_tb", "tb_late": "time_tb_late", "ap": "time_ap", "death": "time_death", "tb_wide": "time_tb_wide"}


def eligible(t: StudyTables) -> DataFrame:
    """Adults alive at the second index date without the disease, metastases or the drugs before."""
    people = C.adults(C.exclude_early_death(clean_registry(t.registry)))
    return C.without_reasons(people, C.study_exclusions(*t.by_age()), F.col("index_date"))


def outcomes(t: StudyTables, people: DataFrame, study_end: Column, pattern: str = V.TUBERCULOSIS_DX,
             duplicate: bool = True) -> DataFrame:
    """Event flags and dates: verified and wide, in follow-up and between the doses, and the
    negative control."""
    own = people.select("patient_id", "index_date", "index_date2", "death_date")
    cases = cut_lineage(C.cases_earliest_first(t.dx_recent, own, pattern))
    verified = C.regimen_confirmed(C.regimen_flags(cases, C.treatment_records(t.rx_recent, cases)), duplicate)
    control = C.negative_control_cases(t.dx_recent, t.dx_hist, own)
    out = people
    for events, flag_name, date_name in (
        (C.outcome_in_followup(verified, study_end), "tb", "tb_date"),
        (C.outcome_in_followup(cases, study_end), "tb_wide", "tb_wide_date"),
        (C.event_between_doses(verified), "tb_bet", "bet_date"),
        (C.event_between_doses(cases), "tb_bet_wide", "bet_wide_date"),
        (C.outcome_in_followup(control, study_end), "ap", "ap_date"),
    ):
        out = C.attach_event(out, events, flag_name, date_name)
    return out


def covariates(t: StudyTables, people: DataFrame, anchor: str = "index_date") -> DataFrame:
    """Disease and drug history, index and contacts, one row per patient."""
    own = people.select("patient_id", anchor).distinct()
    keys = ["patient_id", anchor]
    dx = P.history_flags(t.dx(), own, rules_named(t.class_rules, "dx"), anchor=anchor)
    rx = t.rx()
    classes = P.episode_flags(rx, own, rules_named(t.class_rules, "rx"), "bnf", V.EPISODE_LOOKBACK_DAYS, keys, anchor)
    items = P.episode_flags(rx, own, t.item_rules, "item_cd", V.EPISODE_LOOKBACK_DAYS, keys, anchor)
    contacts = T.window_counts(t.encounters(), own, V.ENCOUNTER_CLASSES, V.UTILISATION_DAYS, ["patient_id"], anchor=anchor)
    out = P.comorbidity_index(dx)
    for part in (classes.drop(anchor), items.drop(anchor), contacts):
        out = out.join(part, "patient_id")
    return out.drop(anchor)


def build_cohort(t: StudyTables, study_end: str = V.STUDY_END, pattern: str = V.TUBERCULOSIS_DX) -> DataFrame:
    """One wide row per patient (two where both regimens confirm a case)."""
    end = F.to_date(F.lit(study_end))
    people = cut_lineage(eligible(t))
    wide = outcomes(t, people, end, pattern).join(covariates(t, people), "patient_id")
    return cut_lineage(wide)


def analysis_frame(cohort: DataFrame, lab: DataFrame, study_end: str = V.STUDY_END,
                   arms: Mapping[str, str] = V.BRAND_ARMS) -> DataFrame:
    """Arm, infection history, censoring date and follow-up time per outcome."""
    end = F.to_date(F.lit(study_end))
    df = C.infection_history(cohort, lab).withColumn("arm", C.treatment_arm(arms=arms))
    df = U.risk_window_outcome(df, event="tb_date").withColumnsRenamed(
        {"event_date_late": "tb_late_date", "event_late": "tb_late"})
    df = df.withColumns({"crossover_date": U.late_crossover_date(), "death": U.death_flag()})
    variants = {"censor_tb": "tb_date", "censor_tb_wide": "tb_wide_date", "censor_death": None,
                "censor_ap": "ap_date", "censor_tb_late": "tb_late_date"}
    df = U.censor_dates(df, variants, end, ["death_date", "crossover_date", "infection_after"])
    return df.withColumns({c.replace("censor", "time"): U.followup_days(c) for c in variants})


def score_terms(df: DataFrame, with_sex: bool = True, absent: Sequence[str] = ()) -> dict[str, str]:
    """Covariates of the propensity model; the frame must hold all but those named absent."""
    names = [*V.SCORE_DX, *V.SCORE_UTILISATION, *V.SCORE_RX, "tb_bet", "infection_his"]
    terms = {"age": "age", **{c: c for c in X.present(df, names, absent)}}
    return {**terms, "male": "CAST(sex = 'M' AS double)"} if with_sex else terms


def weighted(df: DataFrame, arms: Sequence[str], with_sex: bool = True, absent: Sequence[str] = ()) -> DataFrame:
    """Rows with trimmed weights towards the unexposed arm."""
    scored = Q.propensity_scores(df, "arm", arms, score_terms(df, with_sex, absent))
    scored = cut_lineage(scored.withColumn("weight", Q.att_weight("arm", arms, V.UNEXPOSED_ARM)))
    return Q.trim_weights(scored, "weight", "arm", V.UNEXPOSED_ARM)


def baseline(df: DataFrame, weight: str | None = None, absent: Sequence[str] = ()) -> DataFrame:
    """Baseline table of all covariates but those named absent."""
    flags = X.present(df, [*V.TABLE_DX, *V.SCORE_DX, *V.SCORE_RX, "infection_his", "tb_bet"], absent)
    return B.table_one(df, "arm", ["age", *V.SCORE_UTILISATION],
                       {"sex": ["F", "M"], **{c: [0, 1] for c in flags}}, weight)


def subgroups(df: DataFrame) -> dict[str, tuple[DataFrame, bool, bool]]:
    """Name -> rows, whether sex enters the score, whether age enters the outcome model."""
    return {
        "all": (df, True, True),
        "old": (df.where(F.col("age") >= V.OLD_AGE), True, True),
        "adult": (df.where(F.col("age") < V.OLD_AGE), True, False),
        "male": (df.where(F.col("sex") == "M"), False, False),
        "female": (df.where(F.col("sex") == "F"), False, True),
    }


def rate_book(df: DataFrame) -> dict[str, DataFrame]:
    """Rates of every outcome, whole and by subgroup, one pass per outcome."""
    groups = {"agegroup": X.age_group(F.col("age")), "sex": X.with_levels(F.col("sex"), ["M", "F"])}
    return {f"rates_{event}": R.subgroup_rates(df, groups, event, time) for event, time in OUTCOMES.items()}


def model_book(spark: SparkSession, df: DataFrame, arms: Sequence[str]) -> dict[str, DataFrame]:
    """Coefficients and proportional-hazards tests of every model, and the baseline tables."""
    arm_terms = Y.dummies("arm", arms)
    by_arm = {"arm": list(arm_terms)}
    plain = baseline(df)
    book = {"baseline": plain, "differences": B.smd(spark, plain)}

    def add(name: str, rows: DataFrame, event: str, with_age: bool, strata: str | None = None, test: bool = True):
        terms = {**arm_terms, "age": "age"} if with_age else arm_terms
        fit = Y.cox(rows, OUTCOMES[event], event, terms, weight="weight", strata=strata)
        book[name] = coef_table(spark, fit)
        if test:
            book[f"{name}_zph"] = Y.zph_table(spark, Y.cox_zph(fit, {**by_arm, "age": ["age"]} if with_age else by_arm))
            book[f"{name}_zph_terms"] = Y.zph_table(spark, Y.cox_zph(fit))
            if fit.estimated.any():
                book[f"{name}_residuals"] = cut_lineage(Y.schoenfeld_residuals(fit))
        fit.close()

    for name, (rows, with_sex, with_age) in subgroups(df).items():
        rows = weighted(rows, arms, with_sex)
        book[f"{name}_weights"] = Q.weight_summary(rows, "weight", "arm")
        book[f"{name}_weighted"] = baseline(rows, "weight")
        book[f"{name}_balance"] = B.smd(spark, book[f"{name}_weighted"])
        add(name, rows, "tb", with_age)
        if name == "all":
            for event in ("ap", "tb_wide", "tb_late"):
                add(event, rows, event, True)
        if name == "old":
            add("old_by_age", rows, "tb", False, strata="age")
    # one row per patient; death competes with the event
    competing = U.competing_event(df, "tb", "death", OUTCOMES["tb"], OUTCOMES["death"], order=("tb_date", "tb_wide_date"))
    terms = {**arm_terms, **score_terms(df, with_sex=False)}
    fit = Y.fine_gray(competing, "etime", "estatus", terms)
    book["competing_risk"] = coef_table(spark, fit)
    fit.close()
    return book
