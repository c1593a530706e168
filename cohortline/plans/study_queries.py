"""The studies themselves as queries: their wide tables over the test tables, and the chain from scores to a fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.functions import fixed_values as V
from cohortline.functions.sizing import cut_lineage
from cohortline.operators import cohort as C
from cohortline.operators import propensity as Q
from cohortline.operators import survival as Y
from cohortline.plans import case_control_study, cohort_study
from cohortline.plans.case_control_queries import CASES, DATE_GAP, DRAWN
from cohortline.plans.cohort_queries import (
    CASES_AFTER, CODED, DX_RULES, FIRST_TEST, PRIMARY_IP, RX_RULES, TREATMENT, _flag_sql, _index_sql)
from cohortline.plans.basic_queries import ITEMS
from cohortline.plans.registry import query
from cohortline.plans.statistics_queries import (
    _ARM_CAT, _ARMS, ARM_TERMS, LEVELS, _arms_per, _estimates, _fit_sql, known_arm, rounded)
from cohortline.sources import driver_views as D
from cohortline.sources.analysis_view import ARMS
from cohortline.sources.tables import StudyTables


def study_tables(spark: SparkSession, folder: str) -> StudyTables:
    """The test tables as the tables of a study: months before the split, days after it."""
    split = F.to_date(F.lit(D.HISTORY_SPLIT))
    rx, enc = D.rx(spark, folder), D.encounters(spark, folder)
    month = lambda c: F.date_format(c, "yyyy-MM")
    return StudyTables(
        registry=D.patients(spark, folder),
        dx_hist=D.dx_hist(spark, folder), dx_recent=D.dx_recent(spark, folder),
        rx_hist=rx.where(F.col("disp_date") < split).withColumn("disp_ym", month("disp_date")).drop("disp_date"),
        rx_recent=rx.where(F.col("disp_date") >= split),
        enc_hist=enc.where(F.col("date") < split).withColumn("date_ym", month("date")).drop("date"),
        enc_recent=enc.where(F.col("date") >= split),
        lab=D.lab(spark, folder), class_rules=D.CODEBOOK, item_rules=D.ITEM_CODEBOOK)


_ITEM_HITS = " UNION ALL ".join(
    f"SELECT patient_id, disp_date, end_date, '{r.name}' AS name FROM rx WHERE regexp_matches(item_cd, '(?i){r.regex}')" for r in D.ITEM_CODEBOOK)
_DRUG_FLAGS = "(SELECT p.patient_id, {flags} FROM elig p LEFT JOIN {hits} h ON h.patient_id = p.patient_id AND h.disp_date < p.index_date AND h.end_date >= p.index_date - 180 GROUP BY 1)"
_SPLIT = f"DATE '{D.HISTORY_SPLIT}'"
_END = f"DATE '{D.STUDY_END}'"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE regexp_matches(e.source, '{p}')) AS {n}" for n, p in V.ENCOUNTER_CLASSES.items())
_REGIMEN = ", ".join(f"coalesce(max(CAST(drug = '{d}' AS INTEGER)), 0) AS {d.lower()}" for d in V.REGIMEN_DRUGS)
_PRIOR = """SELECT patient_id FROM v_dx_hist WHERE regexp_matches(code, '{0}') UNION SELECT d.patient_id FROM v_dx_recent d JOIN v_patients p USING (patient_id)
  WHERE regexp_matches(code, '{0}') AND d.date < p.index_date"""
_THIRD = "(stre = 1 OR etha = 1)"
_IN_FOLLOWUP = f"date BETWEEN index_date2 AND coalesce(death_date, {_END}) AND {PRIMARY_IP}"
_BETWEEN = f"date >= index_date AND date < index_date2 AND {PRIMARY_IP}"

WIDE = f"""
elig AS (SELECT * REPLACE (CAST(age - 1 AS INTEGER) AS age) FROM v_patients WHERE NOT coalesce(death_date < index_date2, false) AND age - 1 >= {V.ADULT_AGE}
  AND patient_id NOT IN ({_PRIOR.format(V.TUBERCULOSIS_DX)}) AND patient_id NOT IN ({_PRIOR.format(V.METASTATIC_DX)})
  AND patient_id NOT IN (SELECT r.patient_id FROM v_rx r JOIN v_patients p USING (patient_id)
     WHERE regexp_matches(bnf, '{V.TB_DRUG_BNF}') AND regexp_matches(item_cd, '{ITEMS}') AND (disp_date < {_SPLIT} OR disp_date < p.index_date))),
{CASES_AFTER},
regimen AS (SELECT c.patient_id, {_REGIMEN} FROM cases c LEFT JOIN (
    SELECT *, CASE WHEN regexp_matches(item_cd, '{V.RIFI_RECODE}') THEN 'RIFI' ELSE substr(item_cd, 1, 4) END AS drug FROM v_rx
    WHERE disp_date >= {_SPLIT} AND regexp_matches(bnf, '{V.TB_DRUG_BNF}') AND regexp_matches(item_cd, '{TREATMENT}')) r
  ON r.patient_id = c.patient_id AND r.disp_date >= c.date AND r.disp_date < c.date + {V.TREATMENT_WINDOW_DAYS} GROUP BY 1),
verified AS (SELECT cases.* FROM cases JOIN regimen USING (patient_id) WHERE pyra = 1 AND ison = 1 AND rifa = 1 AND {_THIRD}
  UNION ALL SELECT cases.* FROM cases JOIN regimen USING (patient_id) WHERE pyra = 1 AND rifi = 1 AND {_THIRD}),
control AS (SELECT * FROM (SELECT d.patient_id, d.date, d.source, d.ranking, p.index_date2, p.death_date,
    row_number() OVER (PARTITION BY d.patient_id ORDER BY d.date, d.source, d.ranking, d.code, d.rec_id) AS rn
    FROM v_dx_recent d JOIN v_patients p USING (patient_id) WHERE regexp_matches(d.code, '{V.APPENDICITIS_DX}') AND d.date >= p.index_date)
  WHERE rn = 1 AND patient_id NOT IN (SELECT patient_id FROM v_dx_hist WHERE regexp_matches(code, '{V.APPENDICITIS_DX}'))),
dxs AS (SELECT patient_id, code, date FROM v_dx_recent UNION ALL SELECT patient_id, code, CAST(date_ym || '-15' AS DATE) FROM v_dx_hist),
dx_hits AS (SELECT d.patient_id, d.date, b.name FROM dxs d JOIN v_codebook b ON regexp_matches(d.code, '(?i)' || b.regex) AND b.name LIKE 'dx%'),
dx_flags AS (SELECT p.patient_id, {_flag_sql(DX_RULES, 'hits')} FROM elig p LEFT JOIN dx_hits h ON h.patient_id = p.patient_id AND h.date < p.index_date GROUP BY 1),
rx AS (SELECT *, disp_date + days AS end_date FROM (SELECT patient_id, item_cd, bnf, days,
  CASE WHEN disp_date < {_SPLIT} THEN CAST(strftime(disp_date, '%Y-%m') || '-15' AS DATE) ELSE disp_date END AS disp_date FROM v_rx)),
rx_hits AS (SELECT r.*, b.name FROM rx r JOIN v_codebook b ON regexp_matches(r.bnf, '(?i)' || b.regex) AND b.name LIKE 'rx%'),
item_hits AS ({_ITEM_HITS}),
contacts AS (SELECT p.patient_id, {_COUNTS} FROM elig p LEFT JOIN v_enc e ON e.patient_id = p.patient_id AND e.date < p.index_date
  AND e.date > p.index_date - {V.UTILISATION_DAYS} GROUP BY 1),
wide AS (SELECT p.*, v.date AS tb_date, w.date AS tb_wide_date, b.date AS bet_date, x.date AS bet_wide_date, a.date AS ap_date,
    CAST(v.date IS NOT NULL AS INTEGER) AS tb, CAST(w.date IS NOT NULL AS INTEGER) AS tb_wide, CAST(b.date IS NOT NULL AS INTEGER) AS tb_bet,
    CAST(x.date IS NOT NULL AS INTEGER) AS tb_bet_wide, CAST(a.date IS NOT NULL AS INTEGER) AS ap,
    dx_flags.* EXCLUDE (patient_id), CAST({_index_sql()} AS INTEGER) AS cci, rxf.* EXCLUDE (patient_id), itf.* EXCLUDE (patient_id), contacts.* EXCLUDE (patient_id)
  FROM elig p LEFT JOIN (SELECT * FROM verified WHERE {_IN_FOLLOWUP}) v ON v.patient_id = p.patient_id
  LEFT JOIN (SELECT * FROM cases WHERE {_IN_FOLLOWUP}) w ON w.patient_id = p.patient_id
  LEFT JOIN (SELECT * FROM verified WHERE {_BETWEEN}) b ON b.patient_id = p.patient_id
  LEFT JOIN (SELECT * FROM cases WHERE {_BETWEEN}) x ON x.patient_id = p.patient_id
  LEFT JOIN (SELECT * FROM control WHERE {_IN_FOLLOWUP}) a ON a.patient_id = p.patient_id
  JOIN dx_flags ON dx_flags.patient_id = p.patient_id JOIN contacts ON contacts.patient_id = p.patient_id
  JOIN {_DRUG_FLAGS.format(flags=_flag_sql(RX_RULES, 'hits'), hits='rx_hits')} rxf ON rxf.patient_id = p.patient_id
  JOIN {_DRUG_FLAGS.format(flags=_flag_sql(D.ITEM_CODEBOOK, 'hits'), hits='item_hits')} itf ON itf.patient_id = p.patient_id)"""


def _cohort(spark: SparkSession, folder: str) -> DataFrame:
    return cohort_study.build_cohort(study_tables(spark, folder), D.STUDY_END, CODED)


@query(f"WITH {WIDE} SELECT * FROM wide")
def cohort_wide(spark, folder):
    """The cohort study's table: population, outcomes, covariates, contacts."""
    return _cohort(spark, folder)


_ITEMS_AT = " UNION ALL ".join(
    f"SELECT patient_id, disp_date, end_date, '{r.name}' AS name FROM rx WHERE regexp_matches(item_cd, '(?i){r.regex}')" for r in D.ITEM_CODEBOOK)
_AT = """{name} AS (SELECT k.patient_id, k.admission_date, {flags} FROM keys k LEFT JOIN {hits} h ON h.patient_id = k.patient_id
  AND h.disp_date <= k.admission_date AND h.end_date >= k.admission_date - 180 GROUP BY 1, 2)"""

CASE_CONTROL = f"""
{CASES},
pop AS (SELECT * REPLACE (CAST(age - 1 AS INTEGER) AS age) FROM v_patients WHERE NOT coalesce(brand_1st <> brand_2nd, false)
  AND patient_id NOT IN (SELECT patient_id FROM v_dx_hist WHERE regexp_matches(code, '{V.TUBERCULOSIS_DX}') OR regexp_matches(code, '{V.METASTATIC_DX}'))
  AND patient_id NOT IN (SELECT patient_id FROM v_rx WHERE regexp_matches(bnf, '{V.TB_DRUG_BNF}') AND regexp_matches(item_cd, '{ITEMS}') AND disp_date < {_SPLIT})),
own_cases AS (SELECT * FROM cases WHERE patient_id IN (SELECT patient_id FROM pop)),
own_pool AS (SELECT d.patient_id, d.date FROM v_dx_recent d JOIN pop USING (patient_id)
  LEFT JOIN (SELECT patient_id, min(date) AS first_date FROM v_dx_recent WHERE source = '1.IP' AND regexp_matches(code, '{CODED}')
             AND patient_id IN (SELECT patient_id FROM own_cases) GROUP BY 1) f ON f.patient_id = d.patient_id
  WHERE d.source = '1.IP' AND (f.first_date IS NULL OR d.date < f.first_date)),
cc AS (SELECT r.patient_id, r.date, r.tb, p.age, p.sex FROM (SELECT patient_id, date, 1 AS tb FROM own_cases UNION ALL SELECT patient_id, date, 0 FROM own_pool) r
  JOIN pop p USING (patient_id) WHERE sex IN ('M', 'F') AND age >= {V.ADULT_AGE}
  AND NOT (coalesce(date_1st <= r.date, false) AND NOT coalesce(date_2nd <= r.date, false))),
{DRAWN},
members AS (SELECT patient_id, date AS admission_date, sex, age, patient_id AS match FROM cc WHERE tb = 1
  UNION ALL SELECT control_id, date, sex, age, case_id FROM matched WHERE control_id <> case_id),
mine AS (SELECT m.patient_id, m.admission_date, m.sex, m.age, m.match, p.brand_1st, p.date_1st, p.brand_2nd, p.date_2nd, p.death_date,
    CAST(coalesce(p.date_1st < admission_date, false) AS INTEGER) AS vaccinated,
    CAST(coalesce(p.date_1st < admission_date AND p.date_2nd <= admission_date, false) AS INTEGER) AS second_dose,
    CAST(m.match = m.patient_id AS INTEGER) AS tb
  FROM members m JOIN v_patients p ON p.patient_id = m.patient_id),
keys AS (SELECT DISTINCT patient_id, admission_date FROM mine),
dxs AS (SELECT patient_id, code, date FROM v_dx_recent UNION ALL SELECT patient_id, code, CAST(date_ym || '-15' AS DATE) FROM v_dx_hist),
dx_hits AS (SELECT d.patient_id, d.date, b.name FROM dxs d JOIN v_codebook b ON regexp_matches(d.code, '(?i)' || b.regex) AND b.name LIKE 'dx%'),
dx_at AS (SELECT k.patient_id, k.admission_date, {_flag_sql(DX_RULES, 'hits')} FROM keys k
  LEFT JOIN dx_hits h ON h.patient_id = k.patient_id AND h.date < k.admission_date GROUP BY 1, 2),
rx AS (SELECT *, disp_date + days AS end_date FROM (SELECT patient_id, item_cd, bnf, days,
  CASE WHEN disp_date < {_SPLIT} THEN CAST(strftime(disp_date, '%Y-%m') || '-15' AS DATE) ELSE disp_date END AS disp_date FROM v_rx)),
rx_hits AS (SELECT r.*, b.name FROM rx r JOIN v_codebook b ON regexp_matches(r.bnf, '(?i)' || b.regex) AND b.name LIKE 'rx%'),
item_hits AS ({_ITEMS_AT}),
{_AT.format(name='rx_at', flags=_flag_sql(RX_RULES, 'hits'), hits='rx_hits')},
{_AT.format(name='it_at', flags=_flag_sql(D.ITEM_CODEBOOK, 'hits'), hits='item_hits')},
enc AS (SELECT patient_id, source, CASE WHEN date < {_SPLIT} THEN CAST(strftime(date, '%Y-%m') || '-15' AS DATE) ELSE date END AS date FROM v_enc),
contacts AS (SELECT o.patient_id, o.match, {_COUNTS} FROM mine o LEFT JOIN enc e ON e.patient_id = o.patient_id AND e.date < o.admission_date
  AND e.date > o.admission_date - {V.UTILISATION_DAYS} GROUP BY 1, 2),
{FIRST_TEST}"""


@query(f"""WITH {CASE_CONTROL}
SELECT mine.*, CAST(coalesce(infection_date < mine.admission_date, false) AS INTEGER) AS infection, dx_at.* EXCLUDE (patient_id, admission_date),
  CAST({_index_sql()} AS INTEGER) AS cci, rx_at.* EXCLUDE (patient_id, admission_date), it_at.* EXCLUDE (patient_id, admission_date),
  contacts.* EXCLUDE (patient_id, match), CASE WHEN vaccinated = 1 THEN brand_1st ELSE 'None' END AS brand_arm,
  CAST(coalesce(vaccinated = 1 AND brand_1st = 'BrandA', false) AS INTEGER) AS brand_1, CAST(coalesce(vaccinated = 1 AND brand_1st = 'BrandB', false) AS INTEGER) AS brand_2,
  CASE WHEN vaccinated = 1 THEN CAST(date_diff('day', CASE WHEN second_dose = 1 THEN date_2nd ELSE date_1st END, mine.admission_date) AS INTEGER) END AS onset_time,
  CASE WHEN age >= {V.OLD_AGE} THEN 'Old' WHEN age IS NOT NULL THEN 'Adult' END AS agegroup
FROM mine JOIN dx_at ON dx_at.patient_id = mine.patient_id AND dx_at.admission_date = mine.admission_date
  JOIN rx_at ON rx_at.patient_id = mine.patient_id AND rx_at.admission_date = mine.admission_date
  JOIN it_at ON it_at.patient_id = mine.patient_id AND it_at.admission_date = mine.admission_date
  JOIN contacts ON contacts.patient_id = mine.patient_id AND contacts.match = mine.match
  LEFT JOIN pos ON pos.patient_id = mine.patient_id""")
def case_control_wide(spark, folder):
    """The case-control study's table: population, matched sets, covariates at admission.

    Cases are taken before their regimens are verified, which are too rare in the test tables.
    """
    t = study_tables(spark, folder)
    cases = C.cases_filter_first(t.dx_recent, F.to_date(F.lit(D.HISTORY_SPLIT)), CODED)
    rows = cut_lineage(case_control_study.case_control_rows(t, D.HISTORY_SPLIT, CODED, cases))
    return case_control_study.with_covariates(t, case_control_study.matched_rows(rows, t.registry, date_gap=DATE_GAP), list(ARMS))


_TIMES = ", ".join(f"CAST(date_diff('day', index_date2, {c}) + 1 AS INTEGER) AS {c.replace('censor', 'time')}, {c}" for c in
                   ("censor_tb", "censor_tb_wide", "censor_death", "censor_ap", "censor_tb_late"))
_COMMON = f"{_END}, death_date, crossover_date, infection_after"


@query(f"""WITH {WIDE}, {FIRST_TEST},
base AS (SELECT wide.*, CASE WHEN vaccinated = 0 THEN 'None' WHEN brand_1st = brand_2nd THEN brand_1st END AS arm,
    CAST(coalesce(infection_date <= index_date2, false) AS INTEGER) AS infection_his,
    CASE WHEN infection_date > index_date2 THEN infection_date END AS infection_after,
    CASE WHEN date_diff('day', index_date2, tb_date) >= {V.RISK_WINDOW_DAYS} THEN tb_date END AS tb_late_date,
    CASE WHEN vaccinated = 0 AND brand_1st IS NOT NULL THEN date_1st END AS crossover_date
  FROM wide LEFT JOIN pos USING (patient_id)),
cens AS (SELECT *, least({_COMMON}, tb_date) AS censor_tb, least({_COMMON}, tb_wide_date) AS censor_tb_wide, least({_COMMON}) AS censor_death,
    least({_COMMON}, ap_date) AS censor_ap, least({_COMMON}, tb_late_date) AS censor_tb_late FROM base)
SELECT patient_id, arm, infection_his, infection_after, crossover_date, tb_late_date, CAST(tb_late_date IS NOT NULL AS INTEGER) AS tb_late,
  CAST(coalesce(death_date > index_date2, false) AS INTEGER) AS death, tb, tb_wide, ap, cci, ip, {_TIMES} FROM cens""")
def cohort_analysis_frame(spark, folder):
    """Arms, infection, censoring and times of every outcome."""
    frame = cohort_study.analysis_frame(_cohort(spark, folder), D.lab(spark, folder), D.STUDY_END, ARMS)
    times = [c for v in ("tb", "tb_wide", "death", "ap", "tb_late") for c in (f"time_{v}", f"censor_{v}")]
    return frame.select("patient_id", "arm", "infection_his", "infection_after", "crossover_date", "tb_late_date", "tb_late", "death",
                        "tb", "tb_wide", "ap", "cci", "ip", *times)


# --- scores, weights, trimming and the weighted model in one chain -----------------------------
# Two 0/1 terms and their product fit every cell, so a score is the arm's share of its cell.

SCORE_TERMS = {"male": "CAST(sex = 'M' AS double)", "old": "CAST(age >= 60 AS double)", "both": "CAST(sex = 'M' AND age >= 60 AS double)"}
_CELL = "sex = 'M' AS male, age >= 60 AS old"
SCORES = f"""
cell AS (SELECT *, {_CELL} FROM v_analysis WHERE arm IS NOT NULL),
score AS (SELECT *, count(*) OVER (PARTITION BY male, old) AS n, {", ".join(f"count(*) FILTER (WHERE arm = '{a}') OVER (PARTITION BY male, old) AS n_{a}" for a in LEVELS)} FROM cell),
raw AS (SELECT *, CASE arm WHEN 'None' THEN 1.0 WHEN 'BrandA' THEN n_None / n_BrandA ELSE n_None / n_BrandB END AS weight0 FROM score),
ranked AS (SELECT weight0, row_number() OVER (ORDER BY weight0) AS rn, count(*) OVER () AS m FROM raw WHERE arm <> 'None'),
spots AS (SELECT *, floor(m * 0.01 - 0.5) AS j1, floor(m * 0.99 - 0.5) AS j2 FROM ranked),
lim AS (SELECT max(weight0) FILTER (WHERE rn = CASE WHEN m * 0.01 - 0.5 = j1 AND j1 % 2 = 0 THEN j1 ELSE j1 + 1 END) AS low,
  max(weight0) FILTER (WHERE rn = CASE WHEN m * 0.99 - 0.5 = j2 AND j2 % 2 = 0 THEN j2 ELSE j2 + 1 END) AS high FROM spots),
trimmed AS (SELECT raw.* EXCLUDE (w), CASE WHEN arm = 'None' THEN weight0 ELSE greatest(least(weight0, high), low) END AS w FROM raw, lim)"""


def _scored(spark, folder):
    return Q.propensity_scores(known_arm(spark, folder), "arm", LEVELS, SCORE_TERMS)


@query(f"WITH {SCORES} SELECT patient_id, arm, {', '.join(f'round(n_{a} / n, 6) AS ps_{a}' for a in LEVELS)} FROM score")
def ps_scores_by_cell(spark, folder):
    """Fitted scores of a model that fits every cell."""
    return rounded(_scored(spark, folder).select("patient_id", "arm", *[f"ps_{a}" for a in LEVELS]))


@query(_fit_sql(f"{SCORES},\n" + _arms_per(f"(SELECT time AS t, status AS ev, w, {_ARM_CAT} AS cat FROM trimmed)", "0", "w"), _ARMS))
def cox_on_fitted_weights(spark, folder):
    """Scores, weights, trimming and the weighted model, each from the step before."""
    weighted = cut_lineage(_scored(spark, folder).withColumn("weight", Q.att_weight("arm", LEVELS, "None")))
    return _estimates(spark, Y.cox(Q.trim_weights(weighted, "weight", "arm", "None"), "time", "status", ARM_TERMS, weight="weight"))
