"""Case definitions, covariates, exposure, censoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.functions import columns as X
from cohortline.functions import fixed_values as V
from cohortline.functions.sizing import scratch_path
from cohortline.operators import cohort as C
from cohortline.operators import followup as U
from cohortline.operators import phenotype as P
from cohortline.operators import timejoin as T
from cohortline.plans.registry import query
from cohortline.sources import driver_views as D
from cohortline.sources import tables as S
from cohortline.sources.analysis_view import ARMS, analysis

TREATMENT = "(?i)" + V.TB_DRUG_ITEMS_TREATMENT
CODED = "^0[0-4]"  # wide code class, so that the small test tables hold enough events


def _own(spark, folder, *more):
    return D.patients(spark, folder).select("patient_id", *more)


def _cases_after(spark, folder):
    return C.cases_earliest_first(
        D.dx_recent(spark, folder), _own(spark, folder, "index_date", "index_date2", "death_date"), CODED)


CASES_AFTER = """
cases AS (SELECT * FROM (
  SELECT d.patient_id, d.rec_id, d.date, d.code, d.source, d.ranking, p.index_date, p.index_date2, p.death_date,
         row_number() OVER (PARTITION BY d.patient_id ORDER BY d.date, d.source, d.ranking, d.code, d.rec_id) AS rn
  FROM v_dx_recent d JOIN v_patients p USING (patient_id)
  WHERE regexp_matches(d.code, '^0[0-4]') AND regexp_matches(d.ranking, 'P') AND d.date >= p.index_date) WHERE rn = 1)"""
PRIMARY_IP = "regexp_matches(source, '1.IP') AND ranking = 'P'"


@query(f"""WITH {CASES_AFTER}
SELECT patient_id, rec_id, date, code, source, ranking FROM cases WHERE {PRIMARY_IP}""")
def incident_cases_after(spark, folder):
    """Earliest first, then primary inpatient."""
    return _cases_after(spark, folder).where(C.primary_inpatient()).select(
        "patient_id", "rec_id", "date", "code", "source", "ranking")


CASES_BEFORE = """
cases AS (SELECT patient_id, rec_id, date, code FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY date, source, ranking, code, rec_id) AS rn
  FROM v_dx_recent WHERE regexp_matches(code, '^01[0-8]') AND source = '1.IP' AND ranking = 'P') WHERE rn = 1)"""


def _cases_before(spark, folder):
    cutoff = F.to_date(F.lit(D.HISTORY_SPLIT))
    return C.cases_filter_first(D.dx_recent(spark, folder), cutoff)


@query(f"WITH {CASES_BEFORE} SELECT * FROM cases")
def incident_cases_before(spark, folder):
    """Primary inpatient first, then earliest."""
    return _cases_before(spark, folder).select("patient_id", "rec_id", "date", "code")


TREATED = f"""
dx0 AS (SELECT patient_id, min(date) AS date FROM v_dx WHERE regexp_matches(code, '^0[0-4]') GROUP BY 1),
treated AS (SELECT DISTINCT c.patient_id, c.date, r.disp_date,
    CASE WHEN regexp_matches(r.item_cd, '^rifi0[12]|^rifa05') THEN 'RIFI' ELSE substr(r.item_cd, 1, 4) END AS drug
  FROM dx0 c JOIN v_rx_dense r ON r.patient_id = c.patient_id AND r.disp_date >= c.date AND r.disp_date < c.date + 14
  WHERE regexp_matches(r.bnf, '^5.1.9') AND regexp_matches(r.item_cd, '{TREATMENT}'))"""


def _diagnosed(spark, folder):
    hits = D.dx(spark, folder).where(X.find(F.col("code"), CODED))
    return hits.groupBy("patient_id").agg(F.min("date").alias("date"))


@query(f"WITH {TREATED} SELECT * FROM treated")
def rx_within_14d(spark, folder):
    """Listed drugs dispensed in [diagnosis, diagnosis + 14)."""
    return C.treatment_records(D.rx_dense(spark, folder), _diagnosed(spark, folder))


# The test data rarely holds three drugs within two weeks, so the flag queries look at 1000 days.
FLAGS = TREATED.replace("c.date + 14", "c.date + 1000") + """,
flags AS (SELECT c.patient_id, c.date,
  CAST(count(*) FILTER (WHERE drug = 'PYRA') > 0 AS INTEGER) AS pyra, CAST(count(*) FILTER (WHERE drug = 'ETHA') > 0 AS INTEGER) AS etha,
  CAST(count(*) FILTER (WHERE drug = 'RIFA') > 0 AS INTEGER) AS rifa, CAST(count(*) FILTER (WHERE drug = 'ISON') > 0 AS INTEGER) AS ison,
  CAST(count(*) FILTER (WHERE drug = 'STRE') > 0 AS INTEGER) AS stre, CAST(count(*) FILTER (WHERE drug = 'RIFI') > 0 AS INTEGER) AS rifi
  FROM dx0 c LEFT JOIN treated t ON t.patient_id = c.patient_id GROUP BY 1, 2)"""


def _regimen(spark, folder):
    cases = _diagnosed(spark, folder)
    return C.regimen_flags(cases, C.treatment_records(D.rx_dense(spark, folder), cases, days=1000))


@query(f"WITH {FLAGS} SELECT * FROM flags")
def regimen_flags(spark, folder):
    return _regimen(spark, folder)


@query(f"""WITH {FLAGS}
SELECT * FROM flags WHERE pyra = 1 AND ison = 1 AND rifa = 1 AND (stre = 1 OR etha = 1)
UNION ALL SELECT * FROM flags WHERE pyra = 1 AND rifi = 1 AND (stre = 1 OR etha = 1)""")
def regimen_confirmed(spark, folder):
    """Accepted combinations; a patient on both appears twice."""
    return C.regimen_confirmed(_regimen(spark, folder))


@query(f"""WITH {CASES_AFTER}
SELECT patient_id, date, index_date2, death_date FROM cases
WHERE death_date IS NULL AND date >= index_date2 AND date <= DATE '1999-12-31' AND {PRIMARY_IP}
UNION ALL SELECT patient_id, date, index_date2, death_date FROM cases
WHERE death_date IS NOT NULL AND date >= index_date2 AND date <= death_date AND {PRIMARY_IP}""")
def outcome_in_followup(spark, folder):
    outcome = C.outcome_in_followup(_cases_after(spark, folder), F.to_date(F.lit(D.STUDY_END)))
    return outcome.select("patient_id", "date", "index_date2", "death_date")


@query(f"""WITH {CASES_AFTER}
SELECT p.patient_id, c.date AS date_bet, CAST(c.patient_id IS NOT NULL AS INTEGER) AS event_bet FROM v_patients p
LEFT JOIN (SELECT * FROM cases WHERE date >= index_date AND date < index_date2 AND {PRIMARY_IP}) c USING (patient_id)""")
def event_between_doses(spark, folder):
    between = C.event_between_doses(_cases_after(spark, folder))
    return C.attach_event(_own(spark, folder), between, "event_bet", "date_bet")


@query(f"""WITH first_hit AS (SELECT * FROM (
  SELECT d.patient_id, d.date, d.source, d.ranking, p.index_date2, p.death_date,
         row_number() OVER (PARTITION BY d.patient_id ORDER BY d.date, d.source, d.ranking, d.code, d.rec_id) AS rn
  FROM v_dx_recent d JOIN v_patients p USING (patient_id)
  WHERE regexp_matches(d.code, '^54[0-3]|^47[.]') AND d.date >= p.index_date) WHERE rn = 1),
ap AS (SELECT * FROM first_hit
  WHERE patient_id NOT IN (SELECT patient_id FROM v_dx_hist WHERE regexp_matches(code, '^54[0-3]|^47[.]'))
    AND {PRIMARY_IP} AND date BETWEEN index_date2 AND coalesce(death_date, DATE '1999-12-31'))
SELECT p.patient_id, ap.date AS date_ap, CAST(ap.patient_id IS NOT NULL AS INTEGER) AS ap
FROM v_patients p LEFT JOIN ap USING (patient_id)""")
def negative_control_outcome(spark, folder):
    people = _own(spark, folder, "index_date", "index_date2", "death_date")
    cases = C.negative_control_cases(D.dx_recent(spark, folder), D.dx_hist(spark, folder), people)
    outcome = C.outcome_in_followup(cases, F.to_date(F.lit(D.STUDY_END)))
    return C.attach_event(people.select("patient_id"), outcome, "ap", "date_ap")


# --- covariates ------------------------------------------------------------------

DX_RULES = S.rules_named(D.CODEBOOK, "dx")
RX_RULES = S.rules_named(D.CODEBOOK, "rx")


def _flag_sql(rules, hits, extra=""):
    return ", ".join(
        f"CAST(coalesce(bool_or(h.name = '{r.name}'{extra}), false) AS INTEGER) AS {r.name}" for r in rules)


DX_FLAGS = f"""
hits AS (SELECT d.patient_id, d.date, b.name FROM v_dx d JOIN v_codebook b
         ON regexp_matches(d.code, '(?i)' || b.regex) AND b.name LIKE 'dx%'),
flags AS (SELECT p.patient_id, p.index_date, {_flag_sql(DX_RULES, 'hits')}
  FROM v_patients p LEFT JOIN hits h ON h.patient_id = p.patient_id AND h.date < p.index_date GROUP BY 1, 2)"""


@query(f"WITH {DX_FLAGS} SELECT * FROM flags")
def codebook_flags_dx(spark, folder):
    """History flags per diagnosis rule, strictly before the index date."""
    return P.history_flags(D.dx(spark, folder), _own(spark, folder, "index_date"), DX_RULES)


@query(f"""WITH hits AS (SELECT r.patient_id, r.disp_date, r.disp_date + r.days AS end_date, b.name
  FROM v_rx r JOIN v_codebook b ON regexp_matches(r.bnf, '(?i)' || b.regex) AND b.name LIKE 'rx%')
SELECT p.patient_id, p.index_date, {_flag_sql(RX_RULES, 'hits')}
FROM v_patients p LEFT JOIN hits h ON h.patient_id = p.patient_id AND h.disp_date < p.index_date
  AND h.end_date >= p.index_date - 180 GROUP BY 1, 2""")
def codebook_flags_rx(spark, folder):
    """Drug-class flags for episodes overlapping the 180 days before the index date."""
    rx = S.with_end_date(D.rx(spark, folder))
    return P.episode_flags(rx, _own(spark, folder, "index_date"), RX_RULES, "bnf",
                           V.EPISODE_LOOKBACK_DAYS, ["patient_id", "index_date"])


ADMISSIONS = "adm AS (SELECT DISTINCT patient_id, date AS admission_date FROM v_enc WHERE source = '1.IP')"


def _admissions(spark, folder):
    enc = D.encounters(spark, folder).where(F.col("source") == V.INPATIENT)
    return enc.select("patient_id", F.col("date").alias("admission_date")).distinct()


@query(f"""WITH {ADMISSIONS},
hits AS (SELECT d.patient_id, d.date, b.name FROM v_dx d JOIN v_codebook b
         ON regexp_matches(d.code, '(?i)' || b.regex) AND b.name LIKE 'dx%')
SELECT a.patient_id, a.admission_date, {_flag_sql(DX_RULES, 'hits')}
FROM adm a LEFT JOIN hits h ON h.patient_id = a.patient_id AND h.date < a.admission_date GROUP BY 1, 2""")
def codebook_flags_per_admission(spark, folder):
    """History flags for every admission of every patient."""
    return P.history_flags(D.dx(spark, folder), _admissions(spark, folder), DX_RULES, anchor="admission_date")


@query(f"""WITH {ADMISSIONS},
hits AS (SELECT patient_id, disp_date, disp_date + days AS end_date,
  CASE WHEN regexp_matches(item_cd, '(?i)^rif[ai]0') THEN 'it_rif' WHEN regexp_matches(item_cd, '(?i)^ison') THEN 'it_iso'
       WHEN regexp_matches(item_cd, '(?i)^pyra|^etha|^stre') THEN 'it_oth' END AS name FROM v_rx_dense)
SELECT a.patient_id, a.admission_date, {_flag_sql(D.ITEM_CODEBOOK, 'hits')}
FROM adm a LEFT JOIN hits h ON h.patient_id = a.patient_id AND h.disp_date <= a.admission_date
  AND h.end_date >= a.admission_date - 180 GROUP BY 1, 2""")
def codebook_flags_items_per_admission(spark, folder):
    """Drug-item flags per admission; an episode starting on the day counts. The codebook is read from a file."""
    rx = S.with_end_date(D.rx_dense(spark, folder))
    base = scratch_path(spark)
    S.write_book({"items": spark.createDataFrame(D.ITEM_CODEBOOK, "name string, regex string")}, base)
    return P.episode_flags(rx, _admissions(spark, folder), S.read_codebook(spark, f"{base}/items"), "item_cd", V.EPISODE_LOOKBACK_DAYS,
                           ["patient_id", "admission_date"], anchor="admission_date", inclusive=True)


def _index_sql() -> str:
    """Weighted flags; the milder form counts where the graver one is absent."""
    graver = V.INDEX_SUPERSEDED_BY
    return " + ".join(f"{n} * {w}" + (f" * (1 - {graver[n]})" if n in graver else "") for n, w in V.INDEX_WEIGHTS.items())


@query(f"WITH {DX_FLAGS} SELECT patient_id, CAST({_index_sql()} AS INTEGER) AS cci FROM flags")
def comorbidity_index(spark, folder):
    flags = P.history_flags(D.dx(spark, folder), _own(spark, folder, "index_date"), DX_RULES)
    return P.comorbidity_index(flags).select("patient_id", "cci")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE regexp_matches(e.source, '{p}')) AS {n}"
                    for n, p in V.ENCOUNTER_CLASSES.items())


@query(f"""
SELECT p.patient_id, {_COUNTS} FROM v_patients p LEFT JOIN v_enc e
ON e.patient_id = p.patient_id AND e.date < p.index_date AND e.date > p.index_date - 365 GROUP BY 1""")
def utilisation_counts(spark, folder):
    """Contacts per class in the open year before the index date."""
    return T.window_counts(D.encounters(spark, folder), _own(spark, folder, "index_date"), V.ENCOUNTER_CLASSES,
                           V.UTILISATION_DAYS, ["patient_id"])


# --- exposure, infection, censoring --------------------------------------------------

@query("""
SELECT patient_id, CASE WHEN vaccinated = 0 THEN 'None' WHEN brand_1st = brand_2nd THEN brand_1st END AS arm,
  CASE WHEN vaccinated = 1 THEN brand_1st ELSE 'None' END AS brand_arm,
  CAST(vaccinated = 1 AND brand_1st = 'BrandA' AS INTEGER) AS brand_1,
  CAST(vaccinated = 1 AND brand_1st = 'BrandB' AS INTEGER) AS brand_2 FROM v_patients""")
def treatment_arm(spark, folder):
    people = D.patients(spark, folder).withColumn("arm", C.treatment_arm(arms=ARMS))
    return C.brand_arm(people, brands=list(ARMS)).select("patient_id", "arm", "brand_arm", "brand_1", "brand_2")


FIRST_TEST = """
pos AS (SELECT patient_id, min(date) AS infection_date FROM v_lab
        WHERE regexp_matches(t_num, '^213|^215|^216|^217') AND result = 'detected' GROUP BY 1)"""


@query(f"""WITH {FIRST_TEST}
SELECT p.patient_id, p.index_date2, CAST(coalesce(infection_date <= p.index_date2, false) AS INTEGER) AS infection_his,
  CASE WHEN infection_date > p.index_date2 THEN infection_date END AS infection_after,
  CAST(coalesce(infection_date < p.date_2nd, false) AS INTEGER) AS infection
FROM v_patients p LEFT JOIN pos USING (patient_id)""")
def infection_history(spark, folder):
    """First positive test relative to the second index date and, strictly, to dose two."""
    lab = D.lab(spark, folder)
    people = C.infection_history(_own(spark, folder, "index_date2", "date_2nd"), lab)
    return C.infection_before(people, lab, "date_2nd").drop("date_2nd")


EVENTS = f"""{FIRST_TEST},
ev AS (SELECT p.patient_id, min(d.date) AS event_date FROM v_patients p JOIN v_dx d
       ON d.patient_id = p.patient_id AND d.date >= p.index_date2 AND regexp_matches(d.code, '^0[0-4]') GROUP BY 1),
base AS (SELECT p.*, ev.event_date, CASE WHEN infection_date > p.index_date2 THEN infection_date END AS infection_after,
           CASE WHEN date_diff('day', p.index_date2, ev.event_date) >= 30 THEN ev.event_date END AS event_date_late,
           CASE WHEN vaccinated = 0 AND brand_1st IS NOT NULL THEN date_1st END AS crossover_date
         FROM v_patients p LEFT JOIN ev USING (patient_id) LEFT JOIN pos USING (patient_id)
         WHERE NOT coalesce(death_date < index_date2, false)),
cens AS (SELECT *, least(DATE '1999-12-31', event_date, death_date, crossover_date, infection_after) AS censor_event,
           least(DATE '1999-12-31', event_date_late, death_date, crossover_date, infection_after) AS censor_late,
           least(DATE '1999-12-31', death_date, crossover_date, infection_after) AS censor_death FROM base)"""
CENSORS = {"censor_event": "event_date", "censor_late": "event_date_late", "censor_death": None}


def _events(spark, folder):
    people = C.exclude_early_death(D.patients(spark, folder))
    hits = D.dx(spark, folder).where(X.find(F.col("code"), CODED))
    events = T.first_on_or_after(hits, people.select("patient_id", "index_date2"))
    people = people.join(events, "patient_id", "left")
    people = C.infection_history(people, D.lab(spark, folder))
    return U.risk_window_outcome(people).withColumn("crossover_date", U.late_crossover_date())


def _censored(spark, folder):
    return U.censor_dates(_events(spark, folder), CENSORS, F.to_date(F.lit(D.STUDY_END)),
                          ["death_date", "crossover_date", "infection_after"])


@query(f"""WITH {EVENTS}
SELECT patient_id, event_date_late, CAST(event_date_late IS NOT NULL AS INTEGER) AS event_late FROM base""")
def risk_window_outcome(spark, folder):
    return _events(spark, folder).select("patient_id", "event_date_late", "event_late")


@query(f"WITH {EVENTS} SELECT patient_id, crossover_date, censor_event, censor_late, censor_death FROM cens")
def censor_dates(spark, folder):
    return _censored(spark, folder).select("patient_id", "crossover_date", *CENSORS)


@query(f"""WITH {EVENTS}
SELECT patient_id, CAST(date_diff('day', index_date2, censor_event) + 1 AS INTEGER) AS time_event,
  CAST(date_diff('day', index_date2, censor_late) + 1 AS INTEGER) AS time_late,
  CAST(date_diff('day', index_date2, censor_death) + 1 AS INTEGER) AS time_death,
  CAST(coalesce(death_date > index_date2, false) AS INTEGER) AS death FROM cens""")
def followup_time(spark, folder):
    return _censored(spark, folder).select(
        "patient_id", U.followup_days("censor_event").alias("time_event"),
        U.followup_days("censor_late").alias("time_late"), U.followup_days("censor_death").alias("time_death"),
        U.death_flag().alias("death"))


@query(f"""WITH {EVENTS}, f AS (
  SELECT patient_id, CAST(event_date IS NOT NULL AS INTEGER) AS event,
    CAST(coalesce(death_date > index_date2, false) AS INTEGER) AS death,
    CAST(date_diff('day', index_date2, censor_event) + 1 AS INTEGER) AS t1,
    CAST(date_diff('day', index_date2, censor_death) + 1 AS INTEGER) AS t2 FROM cens)
SELECT patient_id, CASE WHEN event = 1 THEN t1 ELSE t2 END AS etime,
  CAST(CASE WHEN event = 1 THEN 1 ELSE 2 * death END AS INTEGER) AS estatus FROM f""")
def competing_event(spark, folder):
    df = _censored(spark, folder).withColumns({
        "status": F.col("event_date").isNotNull().cast("int"), "death": U.death_flag(),
        "time": U.followup_days("censor_event"), "time_death": U.followup_days("censor_death")})
    return U.competing_event(df).select("patient_id", "etime", "estatus")


STATUS = """
st AS (SELECT d.patient_id, d.rec_id, d.date, p.brand_1st, p.date_1st, p.date_2nd,
  CAST(coalesce(p.date_1st <= d.date, false) AS INTEGER) AS vaccinated,
  CAST(coalesce(p.date_1st <= d.date AND p.date_2nd <= d.date, false) AS INTEGER) AS second_dose,
  CAST(coalesce(p.date_1st < d.date, false) AS INTEGER) AS vaccinated_strict
  FROM v_dx_recent d JOIN v_patients p USING (patient_id) WHERE d.source = '1.IP')"""


def _status(spark, folder, strict):
    records = D.dx_recent(spark, folder).where(F.col("source") == V.INPATIENT).select("patient_id", "rec_id", "date")
    joined = T.attach_anchor(records, _own(spark, folder, "brand_1st", "date_1st", "date_2nd"))
    return C.dose_status(joined, strict=strict)


@query(f"""WITH {STATUS} SELECT patient_id, rec_id, date, vaccinated, second_dose FROM st
WHERE NOT (vaccinated = 1 AND second_dose = 0)""")
def vaccination_status(spark, folder):
    """Dose flags at each admission; records between the doses are dropped."""
    kept = C.exclude_between_doses(_status(spark, folder, strict=False))
    return kept.select("patient_id", "rec_id", "date", "vaccinated", "second_dose")


@query(f"""WITH {STATUS} SELECT patient_id, rec_id, vaccinated_strict AS vaccinated,
  CASE WHEN vaccinated_strict = 1 THEN CAST(date_diff('day',
    CASE WHEN vaccinated_strict = 1 AND date_2nd <= date THEN date_2nd ELSE date_1st END, date) AS INTEGER) END AS onset_time
FROM st""")
def onset_since_dose(spark, folder):
    """Days from the latest counted dose to the admission."""
    df = _status(spark, folder, strict=True)
    return df.select("patient_id", "rec_id", "vaccinated", C.onset_since_dose("date").alias("onset_time"))


@query("""WITH cuts AS (SELECT * FROM (VALUES (0, 50, 1), (50, 100, 2), (100, 150, 3), (150, 100000, 4)) t(lo, hi, period))
SELECT patient_id, arm, CAST(lo AS INTEGER) AS tstart, CAST(least(time, hi) AS INTEGER) AS tstop,
  CAST(period AS INTEGER) AS period, CAST(CASE WHEN time <= hi THEN status ELSE 0 END AS INTEGER) AS status
FROM v_analysis JOIN cuts ON time > lo""")
def split_followup(spark, folder):
    """Follow-up cut at 50, 100 and 150 days."""
    return U.split_followup(analysis(spark, folder).select("patient_id", "arm", "time", "status"))
