"""Case-control study: control pool, matching, matched sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.functions import fixed_values as V
from cohortline.functions.sizing import cut_lineage
from cohortline.operators import cohort as C
from cohortline.operators import matching as M
from cohortline.operators import timejoin as T
from cohortline.plans.registry import query
from cohortline.sources import driver_views as D

CODED = "^0[0-4]"  # wide code class, so that the small test tables hold enough cases
DATE_GAP = 20      # the test tables are sparse; the study allows one day
REGISTRY = ["patient_id", "age", "sex", "brand_1st", "date_1st", "brand_2nd", "date_2nd"]


def _cutoff():
    return F.to_date(F.lit(D.HISTORY_SPLIT))


def _inpatient(spark, folder):
    return M.inpatient_records(D.dx_recent(spark, folder), _cutoff())


def _cases(records):
    return C.cases_filter_first(records, _cutoff(), CODED)


CASES = """
cases AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY date, source, ranking, code, rec_id) AS rn
  FROM v_dx_recent WHERE regexp_matches(code, '^0[0-4]') AND source = '1.IP' AND ranking = 'P') WHERE rn = 1),
pool AS (SELECT d.* FROM v_dx_recent d
  JOIN v_patients p ON p.patient_id = d.patient_id
  LEFT JOIN (SELECT patient_id, min(date) AS first_date FROM v_dx_recent
             WHERE source = '1.IP' AND regexp_matches(code, '^0[0-4]')
               AND patient_id IN (SELECT patient_id FROM cases) GROUP BY 1) f ON f.patient_id = d.patient_id
  WHERE d.source = '1.IP' AND (f.first_date IS NULL OR d.date < f.first_date))"""


def _pool(spark, folder, records, cases):
    return M.control_pool(records, D.patients(spark, folder), cases, _cutoff(), CODED)


@query(f"WITH {CASES} SELECT patient_id, rec_id, date, code FROM pool")
def control_pool(spark, folder):
    """Inpatient records that may serve as controls."""
    records = _inpatient(spark, folder)
    return _pool(spark, folder, records, _cases(records)).select("patient_id", "rec_id", "date", "code")


STACK = CASES + """,
stack AS (SELECT r.*, age, sex, date_1st, date_2nd FROM (
    SELECT patient_id, date, 1 AS tb, code AS case_code FROM cases
    UNION ALL SELECT patient_id, date, 0, NULL FROM pool) r
  JOIN v_patients p USING (patient_id)
  WHERE sex IN ('M', 'F') AND age - 1 >= 18)"""


def _stack(spark, folder):
    """Cases and control records with registry columns, known sex, adults."""
    people = C.adults(D.patients(spark, folder).where(F.col("sex").isin("M", "F")))
    records = _inpatient(spark, folder)
    cases = cut_lineage(_cases(records).select("patient_id", "date", F.col("code").alias("case_code")))
    pool = _pool(spark, folder, records, cases).select("patient_id", "date")
    stacked = M.stack_case_control(cases, pool)
    return stacked.join(people.select("patient_id", "age", "sex", "date_1st", "date_2nd"), "patient_id")


@query(f"""WITH {STACK}
SELECT tb, sex, CAST(age - 1 AS INTEGER) AS age, count(*) AS n, count(case_code) AS n_coded,
  count(DISTINCT patient_id) AS n_patients, min(date) AS first_date FROM stack GROUP BY ALL""")
def case_control_stack(spark, folder):
    """Cases over control records; case-only columns are NULL for controls."""
    return _stack(spark, folder).groupBy("tb", "sex", "age").agg(
        F.count(F.lit(1)).alias("n"), F.count("case_code").alias("n_coded"),
        F.count_distinct("patient_id").alias("n_patients"), F.min("date").alias("first_date"))


def _draw(i: int) -> str:
    """The i-th number of a draw: a hashed one up to j, or j if that is taken."""
    j = f"(pool_size - least(pool_size, 10) + {i - 1})"
    number = f"CAST('0x' || substr(md5(concat_ws('|', '475', case_id, date, {j})), 1, 12) AS BIGINT) % ({j} + 1)"
    return f"""drawn{i} AS (SELECT * REPLACE (CASE WHEN {i} > pool_size THEN picks
  WHEN list_contains(picks, {number}) THEN list_append(picks, {j}) ELSE list_append(picks, {number}) END AS picks) FROM drawn{i - 1})"""


_DRAWS = ",\n".join(_draw(i) for i in range(1, 11))
#: From cases and control records ``cc`` to ``matched``.
DRAWN = f"""
cells AS (SELECT DISTINCT sex, age, date FROM cc WHERE tb = 1),
own AS (SELECT DISTINCT patient_id, sex, age, date FROM cc WHERE tb = 0),
pairs AS (SELECT DISTINCT c.sex, c.age, c.date, o.patient_id AS control_id FROM cells c
  JOIN own o ON o.sex = c.sex AND o.age = c.age AND abs(date_diff('day', o.date, c.date)) <= {DATE_GAP}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sex, age, date
    ORDER BY md5(concat_ws('|', '475', sex, age, date, control_id)), control_id) - 1 AS rnk,
  count(*) OVER (PARTITION BY sex, age, date) AS n FROM pairs),
drawn0 AS (SELECT c.patient_id AS case_id, c.sex, c.age, c.date, coalesce(t.n, 0) AS pool_size, CAST([] AS BIGINT[]) AS picks
  FROM cc c LEFT JOIN (SELECT DISTINCT sex, age, date, n FROM ranked) t ON t.sex = c.sex AND t.age = c.age AND t.date = c.date
  WHERE c.tb = 1),
{_DRAWS},
slots AS (SELECT case_id, sex, age, date, pool_size, CAST(s.m AS INTEGER) AS m, picks[s.m] AS rnk FROM drawn10 CROSS JOIN range(1, 11) s(m)),
matched AS (SELECT s.case_id, s.sex, s.age, s.date, CAST(s.pool_size AS BIGINT) AS pool_size, s.m, r.control_id
  FROM slots s LEFT JOIN ranked r ON r.sex = s.sex AND r.age = s.age AND r.date = s.date AND r.rnk = s.rnk)"""
MATCH = STACK + ",\ncc AS (SELECT patient_id, date, tb, CAST(age - 1 AS INTEGER) AS age, sex FROM stack)," + DRAWN


def _matched(spark, folder):
    return M.match_controls(cut_lineage(_stack(spark, folder)), date_gap=DATE_GAP)


@query(f"WITH {MATCH} SELECT * FROM matched")
def match_controls(spark, folder):
    """Up to ten controls of the same age and sex per case."""
    return _matched(spark, folder)


_SLOTS = ", ".join(f"max(CASE WHEN m = {i} THEN control_id END) AS M{i}" for i in range(1, 11))


@query(f"WITH {MATCH} SELECT case_id, sex, age, date, pool_size, {_SLOTS} FROM matched GROUP BY ALL")
def match_wide(spark, folder):
    return M.match_wide(_matched(spark, folder))


LONG = MATCH + """,
long AS (SELECT case_id, sex, age, date, pool_size, 'M' || m AS m, control_id FROM matched
         WHERE control_id <> case_id)"""


def _long(spark, folder):
    return M.match_long(M.match_wide(_matched(spark, folder)))


@query(f"WITH {LONG} SELECT * FROM long")
def match_long(spark, folder):
    """One row per drawn control; empty slots and self-matches are gone."""
    return _long(spark, folder)


@query(f"""WITH {LONG}
SELECT l.case_id, l.sex, l.age, l.date, l.m, l.control_id AS patient_id, p.brand_1st, p.date_1st, p.brand_2nd, p.date_2nd
FROM long l LEFT JOIN v_patients p ON p.patient_id = l.control_id AND p.sex = l.sex AND p.age - 1 = l.age""")
def matched_controls_attach(spark, folder):
    """Registry columns of the matched controls, joined on age, sex and id."""
    people = D.patients(spark, folder).select(*REGISTRY).withColumn("age", F.col("age") - 1)
    return M.attach_registry(_long(spark, folder), people).drop("pool_size")


@query(f"""WITH {LONG}
SELECT count(*) AS n_rows, count(DISTINCT control_id) AS n_controls, count(DISTINCT case_id) AS n_cases,
  count(*) FILTER (WHERE control_id IN (SELECT case_id FROM long)) AS n_control_is_case FROM long""")
def match_summary(spark, folder):
    return M.match_summary(_long(spark, folder))


SETS = LONG + """,
cc2 AS (SELECT case_id AS patient_id, date AS admission_date, age, sex, case_id AS match FROM
          (SELECT DISTINCT case_id, date, age, sex FROM matched)
        UNION ALL SELECT control_id, date, age, sex, case_id FROM long),
sets AS (SELECT c.*, CAST(match = c.patient_id AS INTEGER) AS tb,
    CAST(coalesce(p.date_1st < admission_date, false) AS INTEGER) AS vaccinated,
    CAST(coalesce(p.date_1st < admission_date AND p.date_2nd <= admission_date, false) AS INTEGER) AS second_dose,
    p.date_1st, p.date_2nd, p.brand_1st
  FROM cc2 c JOIN v_patients p ON p.patient_id = c.patient_id),
onset AS (SELECT *, CASE WHEN vaccinated = 1 THEN CAST(date_diff('day',
    CASE WHEN second_dose = 1 THEN date_2nd ELSE date_1st END, admission_date) AS INTEGER) END AS onset_time FROM sets)"""


def matched_sets(spark, folder):
    """Case and control rows of every matched set with dose status at the case's admission date."""
    stack = cut_lineage(_stack(spark, folder))
    drawn = M.drawn_controls(M.match_controls(stack, date_gap=DATE_GAP))
    cases = stack.where("tb = 1").select("patient_id", "date", "age", "sex", F.col("patient_id").alias("match"))
    controls = drawn.select(F.col("control_id").alias("patient_id"), "date", "age", "sex", F.col("case_id").alias("match"))
    rows = cases.unionByName(controls).withColumnRenamed("date", "admission_date")
    rows = rows.join(D.patients(spark, folder).select("patient_id", "brand_1st", "date_1st", "date_2nd"), "patient_id")
    rows = C.dose_status(rows, "admission_date", strict=True).withColumn("tb", M.case_label())
    rows = C.brand_arm(rows, brands=["BrandA", "BrandB"])
    return rows.withColumn("onset_time", C.onset_since_dose())


SENSITIVITY_DAYS = 300


@query(f"""WITH {SETS}
SELECT patient_id, admission_date, match, tb, vaccinated, second_dose, onset_time FROM onset
WHERE match NOT IN (SELECT match FROM onset WHERE tb = 1 AND onset_time < {SENSITIVITY_DAYS})""")
def sensitivity_sets(spark, folder):
    """Matched sets without those whose case fell ill soon after a dose."""
    kept = M.drop_recent_sets(matched_sets(spark, folder), SENSITIVITY_DAYS)
    return kept.select("patient_id", "admission_date", "match", "tb", "vaccinated", "second_dose", "onset_time")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE regexp_matches(e.source, '{p}')) AS {n}" for n, p in V.ENCOUNTER_CLASSES.items())


@query(f"""WITH {SETS}
SELECT s.patient_id, s.match, {_COUNTS} FROM sets s LEFT JOIN v_enc e
ON e.patient_id = s.patient_id AND e.date < s.admission_date AND e.date > s.admission_date - 365 GROUP BY 1, 2""")
def utilisation_counts_matched(spark, folder):
    """Contacts per (patient, matched set); a patient in several sets is counted in each."""
    return T.window_counts(D.encounters(spark, folder), matched_sets(spark, folder), V.ENCOUNTER_CLASSES, V.UTILISATION_DAYS,
                           ["patient_id", "match"], anchor="admission_date")
