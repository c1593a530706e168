"""Scans, column operations, predicates, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.functions import columns as X
from cohortline.functions import fixed_values as V
from cohortline.functions.sizing import scratch_path
from cohortline.operators import cohort as C
from cohortline.operators import matching as M
from cohortline.operators import timejoin as T
from cohortline.plans.registry import query
from cohortline.sources import driver_views as D
from cohortline.sources import tables as S

ITEMS = "(?i)" + V.TB_DRUG_ITEMS_PRIOR


@query("SELECT * FROM v_patients")
def scan_registry(spark, folder):
    return D.patients(spark, folder)


@query("""
SELECT year(date) AS year, source, ranking, count(*) AS n, count(DISTINCT patient_id) AS n_patients,
       min(date) AS first_date, max(date) AS last_date
FROM (SELECT patient_id, source, ranking, CAST(date_ym || '-15' AS DATE) AS date FROM v_dx_hist
      WHERE date_ym >= '1993' UNION ALL
      SELECT patient_id, source, ranking, date FROM v_dx_recent)
WHERE year(date) IN (1993, 1994, 1995, 1996) GROUP BY ALL""")
def scan_yearly_union(spark, folder):
    """History years and the recent table as one record table, by year; the history is stored by year and read in part."""
    base = scratch_path(spark)
    dated = D.dx_hist(spark, folder).withColumn("date", X.month_to_date(F.col("date_ym")))
    S.write_years(dated, base, "date")
    history = S.read_years(spark, base, [1993, 1994, 1995])
    recent = D.dx_recent(spark, folder).where(F.year("date") == 1996)
    records = X.fill_union(recent, history.select([c for c in recent.columns if c in history.columns]))
    return records.groupBy(F.year("date").cast("long").alias("year"), "source", "ranking").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("n_patients"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("""
SELECT a.patient_id, a.admission_date, count(e.rec_id) AS n_before
FROM (SELECT DISTINCT patient_id, date AS admission_date FROM v_enc WHERE source = '1.IP' AND date >= DATE '1997-06-01' AND date < DATE '1997-09-01') a
LEFT JOIN v_enc e ON e.patient_id = a.patient_id AND e.date < a.admission_date AND e.date > a.admission_date - 365 GROUP BY 1, 2""")
def yearly_lookback(spark, folder):
    """Contacts in the year before admissions of one summer, from a table stored by year of which two years are read."""
    base = scratch_path(spark)
    contacts = D.encounters(spark, folder)
    S.write_years(contacts, base, "date")
    day = lambda text: F.to_date(F.lit(text))
    inside = (F.col("source") == V.INPATIENT) & (F.col("date") >= day("1997-06-01")) & (F.col("date") < day("1997-09-01"))
    admissions = contacts.where(inside).select("patient_id", F.col("date").alias("admission_date")).distinct()
    records = S.read_lookback(spark, base, admissions, "admission_date", V.UTILISATION_DAYS)
    return T.window_counts(records, admissions, {"n_before": "."}, V.UTILISATION_DAYS, ["patient_id", "admission_date"], anchor="admission_date")


@query("""
SELECT patient_id, rec_id AS record, date AS event_date, 'lab' AS origin FROM v_lab
UNION ALL SELECT patient_id, rec_id, date, 'enc' FROM v_enc""")
def rename_align_union(spark, folder):
    """Rename by name, sanitise names and stack by position."""
    lab = D.lab(spark, folder).select("patient_id", "rec_id", "date", F.lit("lab").alias("origin"))
    lab = X.plain_names(lab.toDF("patient.id", "rec_id", "date", "origin").withColumnRenamed("rec_id", "record"))
    lab = lab.withColumnRenamed("date", "event_date")
    enc = D.encounters(spark, folder).select("patient_id", "rec_id", "date", F.lit("enc"))
    return X.align_union(lab.toDF("patient_id", "record", "event_date", "origin"), enc)


@query("""
SELECT patient_id, rec_id, date, source, CAST(NULL AS VARCHAR) AS t_num, CAST(NULL AS VARCHAR) AS result FROM v_enc
UNION ALL SELECT patient_id, rec_id, date, NULL, t_num, result FROM v_lab""")
def union_fill(spark, folder):
    """UNION ALL by name, missing columns NULL."""
    return X.fill_union(D.encounters(spark, folder), D.lab(spark, folder))


@query("""
SELECT patient_id, rec_id, date_ym, CAST(date_ym || '-15' AS DATE) AS date,
       CAST(CAST(date_ym || '-15' AS DATE) + 30 AS DATE) AS date_plus,
       CASE WHEN source = '4.GO' THEN NULL ELSE CAST(date_ym || '-15' AS DATE) END AS known_date
FROM v_dx_hist""")
def date_imputation(spark, folder):
    """Mid-month imputation, and blank strings read as unknown dates."""
    df = D.dx_hist(spark, folder).withColumn("date", X.month_to_date(F.col("date_ym")))
    text = F.when(F.col("source") == "4.GO", " ").otherwise(F.date_format("date", "yyyy-MM-dd"))
    return df.select("patient_id", "rec_id", "date_ym", "date", F.date_add("date", 30).alias("date_plus"),
                     X.blank_to_date(text).alias("known_date"))


@query("""
SELECT patient_id, CAST(vaccinated AS VARCHAR) AS vaccinated,
       CASE WHEN sex IN ('F', 'M') THEN sex END AS sex,
       CASE brand_1st WHEN 'BrandA' THEN 'A' WHEN 'BrandB' THEN 'B' END AS brand_1st,
       CAST(coalesce(brand_2nd = 'BrandB', false) AS INTEGER) AS second_is_b
FROM v_patients""")
def factor_cast(spark, folder):
    """Categorical columns: cast by name pattern, restrict to levels, relabel, dummy."""
    df = D.patients(spark, folder)
    df = X.cast_columns(df, X.columns_like(df, "vaccinated|sex"), "string")
    return df.select(
        "patient_id", "vaccinated", X.with_levels(F.col("sex"), ["F", "M"]).alias("sex"),
        X.relabel(F.col("brand_1st"), {"BrandA": "A", "BrandB": "B"}).alias("brand_1st"),
        X.flag(F.col("brand_2nd") == "BrandB").alias("second_is_b"))


@query("""
SELECT patient_id, CASE WHEN brand_1st IS NOT NULL AND brand_2nd IS NOT NULL THEN 1 ELSE 0 END AS both_doses,
       CASE WHEN death_date IS NULL THEN 'alive' ELSE 'dead' END AS vital,
       CASE WHEN vaccinated = 0 AND brand_1st IS NOT NULL THEN date_1st END AS date_re
FROM v_patients""")
def conditional_update(spark, folder):
    """Chained conditional updates; a new column starts NULL."""
    df = D.patients(spark, folder)
    df = X.conditional_update(df, "both_doses", F.col("brand_1st").isNotNull() & F.col("brand_2nd").isNotNull(), F.lit(1))
    df = X.conditional_update(df, "both_doses", F.col("both_doses").isNull(), F.lit(0))
    df = df.withColumn("vital", F.lit("alive"))
    df = X.conditional_update(df, "vital", F.col("death_date").isNotNull(), F.lit("dead"))
    df = X.conditional_update(df, "date_re", (F.col("vaccinated") == 0) & F.col("brand_1st").isNotNull(), F.col("date_1st"))
    return df.select("patient_id", "both_doses", "vital", "date_re")


@query("""
SELECT CASE WHEN age >= 60 THEN 'Old' ELSE 'Adult' END AS agegroup, sex, count(*) AS n,
       min(age) AS min_age, max(age) AS max_age FROM v_cohort GROUP BY ALL""")
def age_groups(spark, folder):
    adults = C.adults(C.exclude_early_death(D.patients(spark, folder)))
    return adults.groupBy(X.age_group(F.col("age")).alias("agegroup"), "sex").agg(
        F.count(F.lit(1)).alias("n"), F.min("age").alias("min_age"), F.max("age").alias("max_age"))


# --- exclusions ------------------------------------------------------------------

@query("SELECT * FROM v_cohort")
def exclude_early_death(spark, folder):
    """Early deaths and minors out; a patient without death date stays."""
    return C.adults(C.exclude_early_death(D.patients(spark, folder)))


@query("""
SELECT * FROM v_patients WHERE patient_id NOT IN (
    SELECT patient_id FROM v_patients WHERE brand_1st IS NOT NULL AND brand_2nd IS NOT NULL AND brand_1st <> brand_2nd)""")
def mixed_brand_exclusion(spark, folder):
    people = D.patients(spark, folder)
    return C.exclude(people, C.mixed_brand_ids(people))


@query("""
SELECT code, source, count(*) AS n, count(DISTINCT patient_id) AS n_patients, min(date) AS first_date
FROM v_dx_recent
WHERE regexp_matches(code, '^01[0-8]') AND regexp_matches(source, '1.IP') AND regexp_matches(ranking, 'P')
  AND date <= DATE '1999-12-31' GROUP BY ALL""")
def regex_phenotype(spark, folder):
    """Coded inpatient records up to a fixed calendar day, by code."""
    hits = D.dx_recent(spark, folder).where(
        X.find(F.col("code"), V.TUBERCULOSIS_DX) & X.find(F.col("source"), V.INPATIENT)
        & X.find(F.col("ranking"), V.PRIMARY) & (F.col("date") <= F.to_date(F.lit(D.STUDY_END))))
    return hits.groupBy("code", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("n_patients"),
        F.min("date").alias("first_date"))


@query(f"""
SELECT * FROM v_patients WHERE patient_id NOT IN (
    SELECT patient_id FROM v_rx WHERE regexp_matches(bnf, '^5.1.9') AND regexp_matches(item_cd, '{ITEMS}')
       AND disp_date < DATE '1999-01-01')""")
def regex_drug_exclusion(spark, folder):
    """Patients without a dispensing of the listed drugs before a fixed day."""
    cutoff = F.to_date(F.lit("1999-01-01"))
    rx = D.rx(spark, folder)
    old = rx.where(F.col("disp_date") < F.to_date(F.lit(D.HISTORY_SPLIT)))
    new = rx.where(F.col("disp_date") >= F.to_date(F.lit(D.HISTORY_SPLIT)))
    return C.exclude(D.patients(spark, folder), C.prior_drug(old, new, cutoff))


@query("""
SELECT patient_id FROM v_dx_hist WHERE regexp_matches(code, '^01[0-8]') AND patient_id IN (SELECT patient_id FROM v_patients)
UNION
SELECT d.patient_id FROM v_dx_recent d JOIN v_patients p USING (patient_id)
WHERE regexp_matches(code, '^01[0-8]') AND d.date < p.index_date""")
def exclusion_union(spark, folder):
    """Ids with a historical hit or a recent one before the patient's own index date."""
    return C.prior_diagnosis(D.dx_hist(spark, folder), D.dx_recent(spark, folder), V.TUBERCULOSIS_DX,
                             anchors=D.patients(spark, folder).select("patient_id", "index_date"))


@query("""
SELECT p.patient_id, p.age, p.sex FROM v_patients p
WHERE EXISTS (SELECT 1 FROM v_enc e WHERE e.patient_id = p.patient_id AND e.source = '2.AE')
  AND NOT EXISTS (SELECT 1 FROM v_lab l WHERE l.patient_id = p.patient_id AND l.result = 'detected')""")
def semi_anti_exclusion(spark, folder):
    """Membership and exclusion by id sets."""
    seen = D.encounters(spark, folder).where(F.col("source") == "2.AE")
    positive = D.lab(spark, folder).where(F.col("result") == V.POSITIVE_RESULT)
    people = D.patients(spark, folder).select("patient_id", "age", "sex")
    return C.exclude(C.keep(people, seen), positive)


@query(f"""
WITH tb AS (SELECT patient_id FROM v_dx_hist WHERE regexp_matches(code, '^01[0-8]')
            UNION SELECT d.patient_id FROM v_dx_recent d JOIN v_patients p USING (patient_id)
            WHERE regexp_matches(code, '^01[0-8]') AND d.date < p.index_date),
mets AS (SELECT patient_id FROM v_dx_hist WHERE regexp_matches(code, '^19[6-9]')
         UNION SELECT d.patient_id FROM v_dx_recent d JOIN v_patients p USING (patient_id)
         WHERE regexp_matches(code, '^19[6-9]') AND d.date < p.index_date),
drug AS (SELECT r.patient_id FROM v_rx r JOIN v_patients p USING (patient_id)
         WHERE regexp_matches(bnf, '^5.1.9') AND regexp_matches(item_cd, '{ITEMS}')
           AND (disp_date < DATE '1996-01-01' OR disp_date < p.index_date)),
s0 AS (SELECT * FROM v_patients),
s1 AS (SELECT * FROM s0 WHERE NOT coalesce(death_date < index_date2, false)),
s2 AS (SELECT * FROM s1 WHERE age - 1 >= 18),
s3 AS (SELECT * FROM s2 WHERE patient_id NOT IN (SELECT patient_id FROM tb)),
s4 AS (SELECT * FROM s3 WHERE patient_id NOT IN (SELECT patient_id FROM mets)),
s5 AS (SELECT * FROM s4 WHERE patient_id NOT IN (SELECT patient_id FROM drug))
SELECT 0 AS step_no, 'registry' AS step, count(*) AS n_rows FROM s0
UNION ALL SELECT 1, 'early death', count(*) FROM s1 UNION ALL SELECT 2, 'age', count(*) FROM s2
UNION ALL SELECT 3, 'prior disease', count(*) FROM s3 UNION ALL SELECT 4, 'metastatic', count(*) FROM s4
UNION ALL SELECT 5, 'prior drug', count(*) FROM s5""")
def attrition_flow(spark, folder):
    """Registry rows left after each step; each record table is read once for all reasons."""
    dx, rx = D.dx(spark, folder), D.rx(spark, folder)
    split = F.to_date(F.lit(D.HISTORY_SPLIT))
    reasons = C.study_exclusions(dx.withColumn("_old", F.col("date") < split), rx.withColumn("_old", F.col("disp_date") < split))
    people = C.mark_reasons(D.patients(spark, folder), reasons, F.col("index_date"))
    return C.attrition(people, [
        ("early death", C.died_before(people)),
        ("age", F.col("age") - 1 < V.ADULT_AGE),
        ("prior disease", F.col("_has_disease")),
        ("metastatic", F.col("_has_metastatic")),
        ("prior drug", F.col("_has_drug")),
    ])


# --- joins and first-per-group -----------------------------------------------------

@query("""
SELECT d.patient_id, d.rec_id, d.date, d.code, p.index_date, p.index_date2
FROM v_dx_recent d JOIN v_patients p USING (patient_id) WHERE d.date >= p.index_date""")
def merge_index_date(spark, folder):
    """Natural inner join of records with the patients' index dates."""
    records = D.dx_recent(spark, folder).select("patient_id", "rec_id", "date", "code")
    own = D.patients(spark, folder).select("patient_id", "index_date", "index_date2")
    return X.natural_join(records, own).where(F.col("date") >= F.col("index_date"))


@query("""
SELECT p.patient_id, p.index_date2, a.tb_date, b.tb_date_wide FROM v_patients p
LEFT JOIN (SELECT patient_id, min(date) AS tb_date FROM v_dx_recent
           WHERE regexp_matches(code, '^01[0-8]') AND source = '1.IP' AND ranking = 'P' GROUP BY 1) a USING (patient_id)
LEFT JOIN (SELECT patient_id, min(date) AS tb_date_wide FROM v_dx_recent
           WHERE regexp_matches(code, '^01[0-8]') GROUP BY 1) b USING (patient_id)""")
def left_join_event_dates(spark, folder):
    """Two event dates side by side; clashing names are settled before the join."""
    hits = D.dx_recent(spark, folder).where(X.find(F.col("code"), V.TUBERCULOSIS_DX))
    primary = (F.col("source") == V.INPATIENT) & (F.col("ranking") == V.PRIMARY)
    dates = hits.groupBy("patient_id").agg(
        F.min(F.when(primary, F.col("date"))).alias("tb_date"), F.min("date").alias("tb_date_wide"))
    return X.natural_join(D.patients(spark, folder).select("patient_id", "index_date2"), dates, "left")


@query("""
SELECT k.patient_id, k.admission_date, CAST(coalesce(bool_or(d.code IS NOT NULL), false) AS INTEGER) AS has_history
FROM (SELECT DISTINCT patient_id, date AS admission_date FROM v_enc WHERE source = '1.IP') k
LEFT JOIN v_dx d ON d.patient_id = k.patient_id AND d.date < k.admission_date AND regexp_matches(d.code, '^00[0-5]')
GROUP BY 1, 2""")
def full_join_unique_flag(spark, folder):
    """All (patient, admission) keys, each once, with a flag for an earlier hit."""
    keys = D.encounters(spark, folder).where(F.col("source") == V.INPATIENT).select(
        "patient_id", F.col("date").alias("admission_date")).distinct()
    hits = D.dx(spark, folder).where(X.find(F.col("code"), "^00[0-5]"))
    seen = T.seen_before(hits, keys, anchor="admission_date").withColumn("_hit", F.lit(1))
    return keys.join(seen, ["patient_id", "admission_date"], "left").select(
        "patient_id", "admission_date", F.coalesce("_hit", F.lit(0)).alias("has_history"))


@query("""
SELECT patient_id, drug, rec_id, disp_date, days FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id, drug ORDER BY disp_date, rec_id, days, item_cd) AS rn
  FROM (SELECT *, substr(item_cd, 1, 4) AS drug FROM v_rx_dense)) WHERE rn = 1""")
def distinct_keep_first(spark, folder):
    """First dispensing per patient and drug, with all its columns."""
    rx = D.rx_dense(spark, folder).withColumn("drug", F.substring("item_cd", 1, 4))
    first = T.earliest_per_key(rx, ["patient_id", "drug"], ["disp_date", "rec_id", "days", "item_cd"])
    return first.select("patient_id", "drug", "rec_id", "disp_date", "days")


@query("""
SELECT patient_id, rec_id, date, code, source, ranking FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY date, source, ranking, code, rec_id) AS rn
  FROM v_dx_recent WHERE regexp_matches(code, '^01[0-8]')) WHERE rn = 1""")
def earliest_event(spark, folder):
    hits = D.dx_recent(spark, folder).where(X.find(F.col("code"), V.TUBERCULOSIS_DX))
    return T.earliest_per_key(hits, ["patient_id"], C.RECORD_ORDER).select(
        "patient_id", "rec_id", "date", "code", "source", "ranking")


@query("""
SELECT d.patient_id, d.rec_id, d.date, d.code, f.index_date FROM v_dx_recent d
JOIN (SELECT patient_id, min(date) AS index_date FROM v_dx_recent
      WHERE source = '1.IP' AND regexp_matches(code, '^01[0-8]') GROUP BY 1) f USING (patient_id)
WHERE d.source = '1.IP' AND d.date < f.index_date""")
def first_event_window(spark, folder):
    """Inpatient records of a patient before the first coded one."""
    inpatient = D.dx_recent(spark, folder).where(F.col("source") == V.INPATIENT)
    before = M.first_event_window(inpatient, X.find(F.col("code"), V.TUBERCULOSIS_DX))
    return before.select("patient_id", "rec_id", "date", "code", "index_date")


@query("""
SELECT patient_id FROM v_enc WHERE source = '1.IP' AND year(date) = 1998
INTERSECT SELECT patient_id FROM v_dx WHERE regexp_matches(code, '^0')
INTERSECT SELECT patient_id FROM v_patients WHERE sex = 'F'""")
def pool_intersect(spark, folder):
    """Ids present in every one of several sets."""
    return C.id_intersection([
        D.encounters(spark, folder).where((F.col("source") == V.INPATIENT) & (F.year("date") == 1998)),
        D.dx(spark, folder).where(X.find(F.col("code"), "^0")),
        D.patients(spark, folder).where(F.col("sex") == "F"),
    ])
