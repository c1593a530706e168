"""Descriptive tables, rates, weights and model fits on the analysis frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.functions import columns as X
from cohortline.functions import fixed_values as V
from cohortline.functions.linear import pairs
from cohortline.operators import cohort as C
from cohortline.operators import describe as B
from cohortline.operators import phenotype as P
from cohortline.operators import propensity as Q
from cohortline.operators import rates as R
from cohortline.operators import report
from cohortline.operators import survival as Y
from cohortline.operators import timejoin as T
from cohortline.plans.case_control_queries import SETS, matched_sets
from cohortline.plans.cohort_queries import DX_RULES, RX_RULES, _cases_after
from cohortline.plans.registry import query
from cohortline.sources import driver_views as D
from cohortline.sources import tables as S
from cohortline.sources.analysis_view import analysis

LEVELS = ["None", "BrandA", "BrandB"]
AGE = "age / 100"
ARM_TERMS = Y.dummies("arm", LEVELS)
COX_TERMS = {**ARM_TERMS, "age": AGE}


def rounded(df, digits=6):
    """Doubles rounded for comparison; other columns unchanged."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def known_arm(spark, folder):
    return analysis(spark, folder).where(F.col("arm").isNotNull())


def study_frame(spark, folder):
    """Analysis frame with every covariate of the outcome models."""
    own = D.patients(spark, folder).select("patient_id", "index_date")
    flags = P.comorbidity_index(P.history_flags(D.dx(spark, folder), own, DX_RULES)).drop("index_date")
    drugs = P.episode_flags(S.with_end_date(D.rx(spark, folder)), own, RX_RULES, "bnf", V.EPISODE_LOOKBACK_DAYS,
                            ["patient_id", "index_date"]).drop("index_date")
    counts = T.window_counts(D.encounters(spark, folder), own, V.ENCOUNTER_CLASSES, V.UTILISATION_DAYS, ["patient_id"])
    frame = known_arm(spark, folder)
    for part in (flags, drugs, counts):
        frame = frame.join(part, "patient_id")
    frame = C.infection_history(frame, D.lab(spark, folder)).drop("infection_after")
    between = C.event_between_doses(_cases_after(spark, folder)).select("patient_id", "date")
    frame = C.attach_event(frame, between, "tb_bet", "bet_date").drop("bet_date")
    died = F.col("death_date") == F.col("censor_date")
    return frame.withColumn("estatus", F.when(F.col("status") == 1, 1).when(died, 2).otherwise(0))


ADJUSTMENT = [*V.SCORE_DX, *V.SCORE_RX, *V.SCORE_UTILISATION, "tb_bet", "infection_his"]


def adjusted_terms():
    return {"age": AGE, "female": "CAST(sex = 'F' AS double)", **{c: c for c in ADJUSTMENT}}


# --- rates -----------------------------------------------------------------------------

@query("""
SELECT arm, count(*) AS n, round(quantile_cont(time, 0.5), 6) AS median_time,
  round(quantile_cont(time, 0.25), 6) AS q25_time, round(quantile_cont(time, 0.75), 6) AS q75_time
FROM v_analysis WHERE arm IS NOT NULL GROUP BY 1""")
def followup_quantiles(spark, folder):
    return rounded(R.followup_quantiles(known_arm(spark, folder), ["arm"]))


def _rate_sql(source: str, keys: str, prefix: str = "") -> str:
    """Rates per group of ``source`` with the profile limits by Newton steps."""
    both = f"(SELECT {keys}, n_event, -1 AS side FROM grp UNION ALL SELECT {keys}, n_event, 1 FROM grp)"
    return f"""WITH RECURSIVE {prefix} grp AS (
  SELECT {keys}, CAST(count(*) FILTER (WHERE status = 1) AS BIGINT) AS n_event, count(*) AS n,
    quantile_cont(time, 0.5) AS median_time, quantile_cont(time, 0.25) AS q25_time,
    quantile_cont(time, 0.75) AS q75_time, round_even(sum(time) / 365.25, 1) AS person_years
  FROM {source} GROUP BY ALL HAVING count(*) FILTER (WHERE status = 1) > 0),
newton AS (
  SELECT {keys}, side, CAST(n_event AS DOUBLE) AS k, 0 AS i,
    CASE WHEN side < 0 THEN ln(n_event) - 1 - {V.CHI2_95_1DF / 2} / n_event
         ELSE ln(n_event) + sqrt({V.CHI2_95_1DF} / n_event) END AS theta FROM {both}
  UNION ALL
  SELECT {keys}, side, k, i + 1,
    theta - (k * ln(k) - k * theta - k + exp(theta) - {V.CHI2_95_1DF / 2}) / (exp(theta) - k)
  FROM newton WHERE i < 40),
ci AS (SELECT {keys}, max(exp(theta)) FILTER (WHERE side < 0) AS low, max(exp(theta)) FILTER (WHERE side > 0) AS high
       FROM newton WHERE i = 40 GROUP BY ALL),
res AS (SELECT grp.*, low, high, round_even(n_event / person_years * 10000, 2) AS rate,
    round_even(low / person_years * 10000, 2) AS rate_low, round_even(high / person_years * 10000, 2) AS rate_high
  FROM grp JOIN ci USING ({keys}))"""


_TEXT = r"""
regexp_replace(CAST(median_time AS VARCHAR), '[.]0$', '') || ' (' || regexp_replace(CAST(q25_time AS VARCHAR), '[.]0$', '')
  || ', ' || regexp_replace(CAST(q75_time AS VARCHAR), '[.]0$', '') || ')' AS followup_text,
regexp_replace(CAST(rate AS VARCHAR), '[.]0$', '') || '(' || regexp_replace(CAST(rate_low AS VARCHAR), '[.]0$', '')
  || ', ' || regexp_replace(CAST(rate_high AS VARCHAR), '[.]0$', '') || ')' AS rate_text"""
_RATES = f"n_event, n, median_time, q25_time, q75_time, person_years, rate, rate_low, rate_high, {_TEXT}"


@query(_rate_sql("(SELECT * FROM v_analysis WHERE arm IS NOT NULL)", "arm") + f" SELECT arm, {_RATES} FROM res")
def incidence_rates(spark, folder):
    """Events, person-years, rate and interval per arm."""
    return R.incidence_rates(known_arm(spark, folder))


@query(_rate_sql("(SELECT * FROM v_analysis WHERE arm IS NOT NULL)", "arm") + """
SELECT arm, n_event, round(low, 6) AS low, round(high, 6) AS high FROM res""")
def incidence_rate_ci(spark, folder):
    """Profile limits of the event count per arm, unrounded."""
    counts = known_arm(spark, folder).groupBy("arm").agg(F.count_if(F.col("status") == 1).alias("n_event"))
    counts = counts.where("n_event > 0")
    return rounded(counts.select("arm", "n_event", R.profile_limit(F.col("n_event"), -1).alias("low"),
                                 R.profile_limit(F.col("n_event"), 1).alias("high")))


@query(_rate_sql("long", "grouping, subgroup, arm", """long AS (
  SELECT 'all' AS grouping, 'all' AS subgroup, arm, time, status FROM v_analysis WHERE arm IS NOT NULL
  UNION ALL SELECT 'agegroup', CASE WHEN age >= 60 THEN 'Old' ELSE 'Adult' END, arm, time, status FROM v_analysis WHERE arm IS NOT NULL
  UNION ALL SELECT 'sex', sex, arm, time, status FROM v_analysis WHERE arm IS NOT NULL AND sex IN ('M', 'F')),""")
       + f" SELECT grouping, subgroup, arm, {_RATES} FROM res")
def subgroup_rates(spark, folder):
    """Rates of the whole, by age group and by sex from one pass."""
    return R.subgroup_rates(known_arm(spark, folder), {
        "agegroup": X.age_group(F.col("age")), "sex": X.with_levels(F.col("sex"), ["M", "F"])})


# --- baseline tables ----------------------------------------------------------------------

CONTINUOUS = ["age", "time"]
CATEGORICAL = {"sex": ["F", "M", "U"], "status": [0, 1], "death": [0, 1]}


def _table_sql(weight: str) -> str:
    parts = [f"""SELECT arm, '{v}' AS variable, CAST(NULL AS VARCHAR) AS level, count({v}) AS n, sum({weight}) AS total,
      sum({weight} * {v}) / sum({weight}) AS mean,
      sqrt((sum({weight} * {v} * {v}) / sum({weight}) - (sum({weight} * {v}) / sum({weight})) ** 2)
           * count({v}) / (count({v}) - 1)) AS sd, CAST(NULL AS DOUBLE) AS share FROM a GROUP BY arm"""
             for v in CONTINUOUS]
    for v, levels in CATEGORICAL.items():
        for level in levels:
            hit = f"WHERE {v} = '{level}'" if isinstance(level, str) else f"WHERE {v} = {level}"
            parts.append(f"""SELECT arm, '{v}', '{level}', count(*) FILTER ({hit}),
              coalesce(sum({weight}) FILTER ({hit}), 0), NULL, NULL,
              coalesce(sum({weight}) FILTER ({hit}), 0) / sum({weight}) FROM a GROUP BY arm""")
    union = "\nUNION ALL ".join(parts)
    return f"""WITH a AS (SELECT arm, CAST(age AS DOUBLE) AS age, CAST(time AS DOUBLE) AS time, sex, status, death, w,
  CAST(1 AS DOUBLE) AS one FROM v_analysis WHERE arm IS NOT NULL),
t1 AS ({union})"""


_TABLE_OUT = """SELECT arm, variable, level, n, round(total, 6) AS total, round(mean, 6) AS mean, round(sd, 6) AS sd,
  round(share, 6) AS share FROM t1"""


def _table(spark, folder, weight=None):
    return B.table_one(known_arm(spark, folder), "arm", CONTINUOUS, CATEGORICAL, weight)


@query(f"{_table_sql('one')} {_TABLE_OUT}")
def table_one(spark, folder):
    """Means, deviations and shares per arm."""
    return rounded(_table(spark, folder))


@query(f"{_table_sql('w')} {_TABLE_OUT}")
def weighted_table_one(spark, folder):
    return rounded(_table(spark, folder, "w"))


@query(f"""{_table_sql('one')},
arms AS (SELECT a.arm AS arm_a, b.arm AS arm_b FROM (SELECT DISTINCT arm FROM t1) a JOIN (SELECT DISTINCT arm FROM t1) b
         ON a.arm < b.arm),
num AS (SELECT x.variable, arm_a, arm_b, abs(x.mean - y.mean) / nullif(sqrt((x.sd ** 2 + y.sd ** 2) / 2), 0) AS smd
  FROM arms JOIN t1 x ON x.arm = arm_a AND x.level IS NULL JOIN t1 y ON y.arm = arm_b AND y.variable = x.variable AND y.level IS NULL),
bin AS (SELECT x.variable, arm_a, arm_b,
    abs(x.share - y.share) / nullif(sqrt((x.share * (1 - x.share) + y.share * (1 - y.share)) / 2), 0) AS smd
  FROM arms JOIN t1 x ON x.arm = arm_a AND x.level = '1' JOIN t1 y ON y.arm = arm_b AND y.variable = x.variable AND y.level = '1'),
sx AS (SELECT arm, max(share) FILTER (WHERE level = 'M') AS m, max(share) FILTER (WHERE level = 'U') AS u
       FROM t1 WHERE variable = 'sex' GROUP BY arm),
tri AS (SELECT 'sex' AS variable, arm_a, arm_b, x.m - y.m AS dm, x.u - y.u AS du,
    (x.m * (1 - x.m) + y.m * (1 - y.m)) / 2 AS vm, (x.u * (1 - x.u) + y.u * (1 - y.u)) / 2 AS vu,
    -(x.m * x.u + y.m * y.u) / 2 AS c
  FROM arms JOIN sx x ON x.arm = arm_a JOIN sx y ON y.arm = arm_b),
alls AS (SELECT * FROM num UNION ALL SELECT * FROM bin UNION ALL
  SELECT variable, arm_a, arm_b, sqrt((dm * dm * vu - 2 * dm * du * c + du * du * vm) / (vm * vu - c * c)) FROM tri)
SELECT variable, arm_a, arm_b, round(smd, 6) AS smd, round(avg(smd) OVER (PARTITION BY variable), 6) AS smd_mean FROM alls""")
def smd(spark, folder):
    """Standardised differences between the arms, per pair and averaged.

    A variable that does not vary in either arm has no difference (NULL) and stays out of the mean.
    """
    return rounded(B.smd(spark, _table(spark, folder)))


STRATA = [["status"], ["status", "sex"], ["status", "agegroup"]]


@query("""WITH a AS (SELECT arm, status, sex, CASE WHEN age >= 60 THEN 'Old' ELSE 'Adult' END AS agegroup
  FROM v_analysis WHERE arm IS NOT NULL),
cells AS (SELECT 'status' AS strata, CAST(status AS VARCHAR) AS stratum, arm, count(*) AS n FROM a GROUP BY ALL
  UNION ALL SELECT 'status+sex', status || ':' || sex, arm, count(*) FROM a GROUP BY ALL
  UNION ALL SELECT 'status+agegroup', status || ':' || agegroup, arm, count(*) FROM a GROUP BY ALL
  UNION ALL SELECT 'agegroup', agegroup, arm, count(*) FROM a WHERE arm <> 'BrandB' GROUP BY ALL),
grid AS (SELECT r.strata, stratum, arm, coalesce(n, 0) AS o, rt, ct, sum(coalesce(n, 0)) OVER (PARTITION BY r.strata) AS tot
  FROM (SELECT strata, arm, sum(n) AS rt FROM cells GROUP BY ALL) r
  JOIN (SELECT strata, stratum, sum(n) AS ct FROM cells GROUP BY ALL) c USING (strata)
  LEFT JOIN cells USING (strata, stratum, arm)),
dims AS (SELECT strata, count(DISTINCT arm) AS nr, count(DISTINCT stratum) AS nc FROM grid GROUP BY 1),
test AS (SELECT strata, CASE WHEN max(nr) = 2 AND max(nc) = 2
    THEN sum((abs(o - rt * ct / tot) - least(0.5, abs(o - rt * ct / tot))) ** 2 / (rt * ct / tot))
    ELSE sum((o - rt * ct / tot) ** 2 / (rt * ct / tot)) END AS chisq,
  (max(nr) - 1) * (max(nc) - 1) AS df
  FROM grid JOIN dims USING (strata) GROUP BY strata)
SELECT strata, round(chisq, 6) AS chisq, df, round(1 - CASE WHEN chisq = 0 THEN 0.0 ELSE list_sum(list_transform(range(0, 400),
    lambda n: exp((df / 2 + n) * ln(chisq / 2) - chisq / 2 - lgamma(df / 2 + n + 1)))) END, 6) AS p FROM test""")
def contingency_chisq(spark, folder):
    """Pearson statistic and p of arm against several stratifications; one of them is 2 x 2."""
    df = known_arm(spark, folder).withColumn("agegroup", X.age_group(F.col("age")))
    several = B.chisq_test(B.contingency(df, "arm", STRATA))
    square = B.chisq_test(B.contingency(df.where(F.col("arm") != "BrandB"), "arm", [["agegroup"]]))
    return rounded(several.unionAll(square))


@query("""WITH a AS (SELECT CASE WHEN age >= 60 THEN 'Old' ELSE 'Adult' END AS agegroup, sex, arm
  FROM v_analysis WHERE arm IS NOT NULL),
cells AS (SELECT 'sex' AS strata, sex AS stratum, arm AS level, count(*) AS n FROM a GROUP BY ALL
  UNION ALL SELECT 'sex+agegroup', sex || ':' || agegroup, arm, count(*) FROM a GROUP BY ALL)
SELECT strata, stratum, level, n, round(n / sum(n) OVER (PARTITION BY strata, stratum), 6) AS share FROM cells""")
def contingency_table(spark, folder):
    """Counts and shares of the arms within strata."""
    df = known_arm(spark, folder).withColumn("agegroup", X.age_group(F.col("age")))
    return rounded(B.contingency(df, "arm", [["sex"], ["sex", "agegroup"]]))


# --- weights -------------------------------------------------------------------------------

PS = {"None": "0.2 + (patient_id % 7) * 0.05", "BrandA": "0.1 + (patient_id % 11) * 0.03",
      "BrandB": "0.15 + (patient_id % 13) * 0.02"}
_PS_SQL = ", ".join(f"CAST({e} AS DOUBLE) AS ps_{a}" for a, e in PS.items())
WEIGHTS = f"""
ps AS (SELECT patient_id, arm, {_PS_SQL} FROM v_analysis WHERE arm IS NOT NULL),
wt AS (SELECT *, CASE arm WHEN 'None' THEN 1.0 WHEN 'BrandA' THEN ps_None / ps_BrandA ELSE ps_None / ps_BrandB END AS w FROM ps)"""


def _weighted(spark, folder):
    scores = known_arm(spark, folder).select(
        "patient_id", "arm", *[F.expr(f"CAST({e} AS DOUBLE)").alias(f"ps_{a}") for a, e in PS.items()])
    return scores.withColumn("w", Q.att_weight("arm", LEVELS, "None"))


@query(f"WITH {WEIGHTS} SELECT patient_id, arm, round(w, 6) AS w FROM wt")
def ps_weights(spark, folder):
    """Weights towards the focal arm from given scores."""
    return rounded(_weighted(spark, folder).select("patient_id", "arm", "w"))


@query(f"""WITH {WEIGHTS},
r AS (SELECT w, row_number() OVER (ORDER BY w) AS rn, count(*) OVER () AS n FROM wt WHERE arm <> 'None'),
q AS (SELECT *, floor(n * 0.01 - 0.5) AS j1, floor(n * 0.99 - 0.5) AS j2 FROM r),
lim AS (SELECT
  max(w) FILTER (WHERE rn = CASE WHEN n * 0.01 - 0.5 = j1 AND j1 % 2 = 0 THEN j1 ELSE j1 + 1 END) AS low,
  max(w) FILTER (WHERE rn = CASE WHEN n * 0.99 - 0.5 = j2 AND j2 % 2 = 0 THEN j2 ELSE j2 + 1 END) AS high FROM q)
SELECT patient_id, arm, round(CASE WHEN arm = 'None' THEN w ELSE greatest(least(w, high), low) END, 6) AS w
FROM wt, lim""")
def ps_trim_weights(spark, folder):
    """Weights pulled inside the 1 % and 99 % order statistics of the non-focal arms."""
    return rounded(Q.trim_weights(_weighted(spark, folder), "w", "arm", "None").select("patient_id", "arm", "w"))


@query(f"""WITH {WEIGHTS}
SELECT arm, count(*) AS n, round(min(w), 6) AS min_weight, round(max(w), 6) AS max_weight,
  round(avg(w), 6) AS mean_weight, round(stddev_samp(w) / avg(w), 6) AS cv, round(sum(w) ** 2 / sum(w * w), 6) AS ess
FROM wt GROUP BY arm""")
def weight_summary(spark, folder):
    return rounded(Q.weight_summary(_weighted(spark, folder), "w", "arm"))


@query()
def ps_scores(spark, folder):
    """Three logistic fits on the study covariates, in shared passes."""
    frame = study_frame(spark, folder)
    scored = Q.propensity_scores(frame, "arm", LEVELS, adjusted_terms())
    return scored.select("patient_id", "arm", *[f"ps_{a}" for a in LEVELS])


# --- survival ------------------------------------------------------------------------------

@query("""WITH per AS (SELECT arm AS stratum, time, count(*) AS n, sum(w) AS w, count(*) FILTER (WHERE status = 1) AS n_event,
    coalesce(sum(w) FILTER (WHERE status = 1), 0) AS w_event FROM v_analysis WHERE arm IS NOT NULL GROUP BY 1, 2),
risk AS (SELECT *, sum(n) OVER b AS n_risk, sum(w) OVER b AS w_risk FROM per
  WINDOW b AS (PARTITION BY stratum ORDER BY time DESC)),
ev AS (SELECT * FROM risk WHERE n_event > 0)
SELECT stratum, time, CAST(n_risk AS BIGINT) AS n_risk, n_event, round(w_risk, 6) AS w_risk, round(w_event, 6) AS w_event,
  round(w_event / w_risk, 6) AS hazard, round(sum(w_event / w_risk) OVER f, 6) AS cum_hazard,
  round(CASE WHEN bool_or(n_event = n_risk) OVER f THEN 0.0
        ELSE exp(sum(CASE WHEN n_event < n_risk THEN ln(1 - n_event / n_risk) END) OVER f) END, 6) AS survival
FROM ev WINDOW f AS (PARTITION BY stratum ORDER BY time)""")
def risk_set_table(spark, folder):
    """Risk sets, hazard and survival per arm and event day."""
    return rounded(Y.risk_set_table(known_arm(spark, folder), weight="w", strata="arm"))


FG = """
base AS (SELECT patient_id, time AS t, CASE WHEN status = 1 THEN 1 WHEN death_date = censor_date THEN 2 ELSE 0 END AS st
         FROM v_analysis WHERE arm IS NOT NULL),
per AS (SELECT t, count(*) AS n, count(*) FILTER (WHERE st = 0) AS c, count(*) FILTER (WHERE st = 1) AS d FROM base GROUP BY t),
risk AS (SELECT *, sum(n) OVER (ORDER BY t DESC) - (n - c) AS nr FROM per),
km AS (SELECT t, c, d, CASE WHEN bool_or(c > 0 AND c = nr) OVER (ORDER BY t) THEN 0.0
         ELSE exp(sum(CASE WHEN c = 0 THEN 0 WHEN c < nr THEN ln(1 - c / nr) END) OVER (ORDER BY t)) END AS g_after FROM risk),
km2 AS (SELECT *, coalesce(lag(g_after) OVER (ORDER BY t), 1.0) AS g FROM km),
lst AS (SELECT max(t) AS last FROM per WHERE d > 0),
cuts AS (SELECT t, g_after, lead(t) OVER (ORDER BY t) AS nxt FROM km2, lst WHERE c > 0 AND t < last),
dead AS (SELECT b.patient_id, b.t, k.g, last FROM base b JOIN km2 k USING (t), lst WHERE b.st = 2 AND b.t < last)"""


@query(f"""WITH {FG},
fg AS (
  SELECT patient_id, 0 AS fgstart, t AS fgstop, CAST(st = 1 AS INTEGER) AS fgstatus, 1.0 AS fgwt FROM base, lst
  WHERE NOT (st = 2 AND t < last)
  UNION ALL SELECT d.patient_id, 0, coalesce((SELECT min(t) FROM cuts WHERE cuts.t >= d.t), d.last), 0, 1.0 FROM dead d
  UNION ALL SELECT d.patient_id, c.t, coalesce(c.nxt, d.last), 0, c.g_after / d.g FROM dead d JOIN cuts c ON c.t >= d.t)
SELECT patient_id, CAST(fgstart AS INTEGER) AS fgstart, CAST(fgstop AS INTEGER) AS fgstop,
  CAST(fgstatus AS INTEGER) AS fgstatus, round(CAST(fgwt AS DOUBLE), 6) AS fgwt FROM fg""")
def fine_gray_rows(spark, folder):
    """Start/stop rows with censoring weights for the competing event."""
    died = F.col("death_date") == F.col("censor_date")
    frame = known_arm(spark, folder).select(
        "patient_id", F.col("time").alias("etime"),
        F.when(F.col("status") == 1, 1).when(died, 2).otherwise(0).alias("estatus"))
    return rounded(Y.fine_gray_rows(frame).select("patient_id", "fgstart", "fgstop", "fgstatus", "fgwt"))


def _score_sql(source: str, terms: dict[str, str], stratum: str, weight: str) -> str:
    """Score and information at zero coefficients, with Efron's ties, as (name, value) rows."""
    names = list(terms)
    k = len(names)
    x = [f"({e})" for e in terms.values()]
    mom = {"0": "1", **{f"1_{i}": x[i] for i in range(k)}, **{f"2_{i}_{j}": f"{x[i]} * {x[j]}" for i, j in pairs(k)}}
    sums = ", ".join(f"sum({weight} * {m}) AS p{n}, coalesce(sum({weight} * {m}) FILTER (WHERE ev = 1), 0) AS e{n}"
                     for n, m in mom.items())
    ex = ", ".join(f"coalesce(sum({weight} * {x[i]}) FILTER (WHERE ev = 1), 0) AS ex_{i}" for i in range(k))
    back = ", ".join(f"sum(p{n}) OVER b AS s{n}" for n in mom)
    mean = [f"(s1_{i} - r * e1_{i}) / (s0 - r * e0)" for i in range(k)]
    out = [f"SELECT 'score_{n}' AS name, round((SELECT sum(ex_{i}) FROM risk WHERE d > 0) - sum(wbar * {mean[i]}), 6) AS value FROM tied"
           for i, n in enumerate(names)]
    out += [f"SELECT 'info_{names[i]}_{names[j]}', round(sum(wbar * ((s2_{i}_{j} - r * e2_{i}_{j}) / (s0 - r * e0) - {mean[i]} * {mean[j]})), 6) FROM tied"
            for i, j in pairs(k)]
    union = "\nUNION ALL ".join(out)
    return f"""per AS (SELECT {stratum} AS s, t, {sums}, {ex}, coalesce(sum({weight}) FILTER (WHERE ev = 1), 0) AS ew,
    count(*) FILTER (WHERE ev = 1) AS d FROM {source} GROUP BY 1, 2),
risk AS (SELECT *, {back} FROM per WINDOW b AS (PARTITION BY s ORDER BY t DESC)),
tied AS (SELECT *, l / d AS r, ew / d AS wbar FROM (SELECT *, unnest(range(0, d)) AS l FROM risk WHERE d > 0))
{union}"""


def score_rows(spark, model):
    """Score and information at zero coefficients as (name, value) rows."""
    _, score, info = model.evaluate(0.0 * model.means)
    rows = [(f"score_{n}", float(score[i])) for i, n in enumerate(model.terms)]
    rows += [(f"info_{model.terms[i]}_{model.terms[j]}", float(info[i, j])) for i, j in pairs(model.k)]
    model.close()
    return rounded(spark.createDataFrame(rows, "name string, value double"))


_ARM_SQL = {"arm_BrandA": "CASE WHEN arm = 'BrandA' THEN 1 ELSE 0 END", "arm_BrandB": "CASE WHEN arm = 'BrandB' THEN 1 ELSE 0 END"}
_COX_SOURCE = "(SELECT arm, age / 100 AS age, CAST(floor(age / 20) AS INTEGER) AS band, time AS t, status AS ev, w FROM v_analysis WHERE arm IS NOT NULL)"


@query("WITH " + _score_sql(_COX_SOURCE, {**_ARM_SQL, "age": "age"}, "0", "w"))
def cox_score(spark, folder):
    """Partial-likelihood score and information of the weighted model at zero."""
    return score_rows(spark, Y.RiskModel(known_arm(spark, folder), "time", "status", COX_TERMS, weight="w"))


@query("WITH " + _score_sql(_COX_SOURCE, _ARM_SQL, "band", "w"))
def cox_stratified_score(spark, folder):
    """The same with a baseline per age band."""
    frame = known_arm(spark, folder).withColumn("band", F.floor(F.col("age") / 20).cast("int"))
    return score_rows(spark, Y.RiskModel(frame, "time", "status", ARM_TERMS, weight="w", strata="band"))


BRAND_TERMS = {"brand_1": "brand_1", "brand_2": "brand_2"}


@query(f"""WITH {SETS}, rowset AS (SELECT match, 1 AS t, tb AS ev,
  CASE WHEN vaccinated = 1 AND brand_1st = 'BrandA' THEN 1 ELSE 0 END AS brand_1,
  CASE WHEN vaccinated = 1 AND brand_1st = 'BrandB' THEN 1 ELSE 0 END AS brand_2,
  age / 100 AS age, tb AS tbx, CASE WHEN second_dose = 1 THEN 1 ELSE 0 END AS second_dose FROM onset), """
       + _score_sql("rowset", {"brand_1": "brand_1", "brand_2": "brand_2", "second_dose": "second_dose"}, "match", "1"))
def clogit_score(spark, folder):
    """Conditional-likelihood score and information of the matched sets at zero."""
    sets = matched_sets(spark, folder).withColumn("_t", F.lit(1))
    terms = {**BRAND_TERMS, "second_dose": "second_dose"}
    return score_rows(spark, Y.RiskModel(sets, "_t", "tb", terms, strata="match", matched=True))


def _coefficients(spark, fit):
    table = report.coef_table(spark, fit)
    fit.close()
    return table


@query()
def cox_weighted(spark, folder):
    """Weighted model with sandwich errors."""
    return _coefficients(spark, Y.cox(known_arm(spark, folder), "time", "status", COX_TERMS, weight="w"))


@query()
def cox_stratified(spark, folder):
    """A baseline per integer age, among the old."""
    old = known_arm(spark, folder).where(F.col("age") >= V.OLD_AGE)
    return _coefficients(spark, Y.cox(old, "time", "status", ARM_TERMS, weight="w", strata="age"))


@query()
def cox_split(spark, folder):
    """Model on follow-up split into periods, with entry times and a baseline per period."""
    from cohortline.operators.followup import split_followup
    rows = split_followup(known_arm(spark, folder).select("patient_id", "arm", "age", "w", "time", "status"))
    return _coefficients(spark, Y.cox(rows, "tstop", "status", COX_TERMS, weight="w", strata="period", entry="tstart"))


@query()
def cox_zph(spark, folder):
    """Proportional-hazards tests, the arm as one term."""
    fit = Y.cox(known_arm(spark, folder), "time", "status", COX_TERMS, weight="w")
    tests = Y.cox_zph(fit, {"arm": list(ARM_TERMS), "age": ["age"]})
    fit.close()
    return Y.zph_table(spark, tests)


@query()
def schoenfeld_residuals(spark, folder):
    """Scaled residuals behind the time plots."""
    return Y.schoenfeld_residuals(Y.cox(known_arm(spark, folder), "time", "status", COX_TERMS, weight="w"))


@query()
def fine_gray_fit(spark, folder):
    """Subdistribution model with the study covariates."""
    frame = study_frame(spark, folder)
    return _coefficients(spark, Y.fine_gray(frame, "time", "estatus", {**ARM_TERMS, **adjusted_terms()}))


@query()
def clogit(spark, folder):
    """Crude conditional logit on the matched sets."""
    return _coefficients(spark, Y.clogit(matched_sets(spark, folder), "tb", BRAND_TERMS))


@query()
def clogit_adjusted(spark, folder):
    """Conditional logit with history flags, drug flags, contacts and infection per admission."""
    sets = matched_sets(spark, folder).persist()
    keys = ["patient_id", "admission_date"]
    flags = P.comorbidity_index(P.history_flags(
        D.dx(spark, folder), sets.select(*keys).distinct(), DX_RULES, anchor="admission_date"))
    drugs = P.episode_flags(S.with_end_date(D.rx(spark, folder)), sets, RX_RULES, "bnf", V.EPISODE_LOOKBACK_DAYS,
                            keys, anchor="admission_date", inclusive=True)
    counts = T.window_counts(D.encounters(spark, folder), sets, V.ENCOUNTER_CLASSES, V.UTILISATION_DAYS,
                             ["patient_id", "match"], anchor="admission_date")
    frame = sets.join(flags, keys).join(drugs, keys).join(counts, ["patient_id", "match"])
    terms = {**BRAND_TERMS, **{c: c for c in ADJUSTMENT if c not in ("tb_bet", "infection_his")}}
    fit = Y.clogit(frame, "tb", terms)
    sets.unpersist()
    return _coefficients(spark, fit)


# --- fits with an oracle ------------------------------------------------------------------
# With two exclusive 0/1 terms a risk set is described by three weights, so SQL can run the same
# Newton steps over the event days.

NEWTON_STEPS = 15


def _fit_sql(per: str, terms: tuple[str, str]) -> str:
    """Estimates from a table ``tied`` of (c0, c1, c2, wbar) per tied rank and ``total`` of (x1, x2)."""
    den = "(c0 + c1 * exp(b1) + c2 * exp(b2))"
    return f"""WITH RECURSIVE {per},
newton AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2
  UNION ALL
  SELECT i + 1, b1 + (i22 * s1 - i12 * s2) / (i11 * i22 - i12 * i12), b2 + (i11 * s2 - i12 * s1) / (i11 * i22 - i12 * i12)
  FROM (SELECT i, b1, b2, max(x1) - sum(wbar * m1) AS s1, max(x2) - sum(wbar * m2) AS s2,
          sum(wbar * m1 * (1 - m1)) AS i11, sum(wbar * m2 * (1 - m2)) AS i22, -sum(wbar * m1 * m2) AS i12
        FROM (SELECT i, b1, b2, x1, x2, wbar, c1 * exp(b1) / {den} AS m1, c2 * exp(b2) / {den} AS m2
              FROM newton, tied, total WHERE i < {NEWTON_STEPS}) GROUP BY i, b1, b2)),
last AS (SELECT b1, b2, sum(wbar * m1 * (1 - m1)) AS i11, sum(wbar * m2 * (1 - m2)) AS i22, -sum(wbar * m1 * m2) AS i12
  FROM (SELECT b1, b2, wbar, c1 * exp(b1) / {den} AS m1, c2 * exp(b2) / {den} AS m2 FROM newton, tied
        WHERE i = {NEWTON_STEPS}) GROUP BY b1, b2)
SELECT '{terms[0]}' AS term, round(b1, 6) AS estimate, round(sqrt(i22 / (i11 * i22 - i12 * i12)), 6) AS std_error FROM last
UNION ALL SELECT '{terms[1]}', round(b2, 6), round(sqrt(i11 / (i11 * i22 - i12 * i12)), 6) FROM last"""


def _arms_per(source: str, stratum: str, weight: str) -> str:
    """Risk sets by category 0, 1, 2 of ``source`` (s, t, ev, cat, w)."""
    cats = ", ".join(f"coalesce(sum({weight}) FILTER (WHERE cat = {c}), 0) AS p{c}, "
                     f"coalesce(sum({weight}) FILTER (WHERE cat = {c} AND ev = 1), 0) AS e{c}" for c in range(3))
    back = ", ".join(f"sum(p{c}) OVER b AS r{c}" for c in range(3))
    return f"""per AS (SELECT {stratum} AS s, t, {cats}, count(*) FILTER (WHERE ev = 1) AS d FROM {source} GROUP BY 1, 2),
risk AS (SELECT *, {back} FROM per WINDOW b AS (PARTITION BY s ORDER BY t DESC)),
tied AS (SELECT r0 - l / d * e0 AS c0, r1 - l / d * e1 AS c1, r2 - l / d * e2 AS c2, (e0 + e1 + e2) / d AS wbar
  FROM (SELECT *, unnest(range(0, d)) AS l FROM risk WHERE d > 0)),
total AS (SELECT sum(e1) AS x1, sum(e2) AS x2 FROM per)"""


def _estimates(spark, fit):
    table = report.coef_table(spark, fit).select("term", "estimate", "std_error")
    fit.close()
    return rounded(table)


_ARM_CAT = "CASE arm WHEN 'None' THEN 0 WHEN 'BrandA' THEN 1 ELSE 2 END"
_ARMS = tuple(_ARM_SQL)


@query(_fit_sql(_arms_per(
    f"(SELECT time AS t, status AS ev, w, {_ARM_CAT} AS cat FROM v_analysis WHERE arm IS NOT NULL)", "0", "w"), _ARMS))
def cox_fit_by_arm(spark, folder):
    """Weighted model on the arm alone."""
    return _estimates(spark, Y.cox(known_arm(spark, folder), "time", "status", ARM_TERMS, weight="w"))


@query(_fit_sql(_arms_per(
    f"(SELECT age, time AS t, status AS ev, w, {_ARM_CAT} AS cat FROM v_analysis WHERE arm IS NOT NULL AND age >= 60)",
    "age", "w"), _ARMS))
def cox_fit_stratified(spark, folder):
    """Weighted model on the arm with a baseline per integer age, among the old."""
    old = known_arm(spark, folder).where(F.col("age") >= V.OLD_AGE)
    return _estimates(spark, Y.cox(old, "time", "status", ARM_TERMS, weight="w", strata="age"))


@query(_fit_sql(f"""{SETS},
{_arms_per("(SELECT match, 1 AS t, tb AS ev, CASE WHEN vaccinated = 0 THEN 0 WHEN brand_1st = 'BrandA' THEN 1 ELSE 2 END AS cat FROM onset)", "match", "1")}""",
                ("brand_1", "brand_2")))
def clogit_fit_crude(spark, folder):
    """Crude conditional logit of the matched sets."""
    return _estimates(spark, Y.clogit(matched_sets(spark, folder), "tb", BRAND_TERMS))


def _dead_weight(c: int) -> str:
    return f"g * coalesce(sum(k{c} / g) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query(_fit_sql(f"""{FG},
cat AS (SELECT b.t, b.st, {_ARM_CAT} AS cat FROM base b JOIN v_analysis USING (patient_id)),
per2 AS (SELECT t, {", ".join(f"count(*) FILTER (WHERE cat = {c}) AS p{c}, count(*) FILTER (WHERE cat = {c} AND st = 1) AS e{c}, count(*) FILTER (WHERE cat = {c} AND st = 2) AS k{c}" for c in range(3))}
  FROM cat GROUP BY t),
risk2 AS (SELECT t, e0, e1, e2, e0 + e1 + e2 AS d,
  {", ".join(f"sum(p{c}) OVER (ORDER BY t DESC) + {_dead_weight(c)} AS r{c}" for c in range(3))} FROM per2 JOIN km2 USING (t)),
tied AS (SELECT r0 - l / d * e0 AS c0, r1 - l / d * e1 AS c1, r2 - l / d * e2 AS c2, 1 AS wbar
  FROM (SELECT *, unnest(range(0, d)) AS l FROM risk2 WHERE d > 0)),
total AS (SELECT sum(e1) AS x1, sum(e2) AS x2 FROM per2)""", _ARMS))
def fine_gray_fit_by_arm(spark, folder):
    """Subdistribution model on the arm alone."""
    died = F.col("death_date") == F.col("censor_date")
    frame = known_arm(spark, folder).withColumn(
        "estatus", F.when(F.col("status") == 1, 1).when(died, 2).otherwise(0))
    return _estimates(spark, Y.fine_gray(frame, "time", "estatus", ARM_TERMS))


_PLAIN = _fit_sql(_arms_per(f"(SELECT time AS t, status AS ev, {_ARM_CAT} AS cat FROM v_analysis WHERE arm IS NOT NULL)", "0", "1"), _ARMS).split("\nSELECT '")[0]


@query(f"""{_PLAIN},
est AS (SELECT '{_ARMS[0]}' AS term, b1 AS b, sqrt(i22 / (i11 * i22 - i12 * i12)) AS se FROM last
  UNION ALL SELECT '{_ARMS[1]}', b2, sqrt(i11 / (i11 * i22 - i12 * i12)) FROM last),
lik AS (SELECT i, max(x1) * b1 + max(x2) * b2 - sum(wbar * ln(c0 + c1 * exp(b1) + c2 * exp(b2))) AS ll FROM newton, tied, total GROUP BY i, b1, b2),
settled AS (SELECT min(i) AS iterations FROM (SELECT i, ll, lag(ll) OVER (ORDER BY i) AS former FROM lik) WHERE abs(ll - former) <= 1e-9 * greatest(1, abs(ll))),
size AS (SELECT count(*) AS n, count(*) FILTER (WHERE status = 1) AS events FROM v_analysis WHERE arm IS NOT NULL)
SELECT term, round(b, 6) AS estimate, round(exp(b), 6) AS exp_estimate, round(se, 6) AS std_error, CAST(NULL AS DOUBLE) AS robust_se, round(b / se, 6) AS statistic,
  round(1 - list_sum(list_transform(range(0, 400), lambda k: exp((k + 0.5) * ln((b / se) ** 2 / 2) - (b / se) ** 2 / 2 - lgamma(k + 1.5)))), 6) AS p_value,
  round(exp(b - {V.Z_95} * se), 6) AS lower, round(exp(b + {V.Z_95} * se), 6) AS upper, n, events, CAST(iterations AS INTEGER) AS iterations, true AS converged
FROM est, settled, size""")
def coef_table(spark, folder):
    """Report rows of one crude fit, limits joined by term."""
    return rounded(_coefficients(spark, Y.cox(known_arm(spark, folder), "time", "status", ARM_TERMS)))


# --- diagnostics with an oracle: the same two terms at the estimates -----------------------------

_ARM_SOURCE = f"(SELECT time AS t, status AS ev, w, {_ARM_CAT} AS cat FROM v_analysis WHERE arm IS NOT NULL)"
_BY_ARM = _fit_sql(_arms_per(_ARM_SOURCE, "0", "w"), _ARMS).split("\nSELECT '")[0]
# a row per tied rank with the risk set's mean of each term, and the sums of a day
_AT_FIT = f"""{_BY_ARM},
ranks AS (SELECT t, l, d, (e0 + e1 + e2) / d AS wbar, e1, e2, r0 - l / d * e0 + (r1 - l / d * e1) * exp(b1) + (r2 - l / d * e2) * exp(b2) AS s0,
    (r1 - l / d * e1) * exp(b1) AS p1, (r2 - l / d * e2) * exp(b2) AS p2
  FROM (SELECT *, unnest(range(0, d)) AS l FROM risk WHERE d > 0), last),
days AS (SELECT t, max(d) AS d, sum(wbar / s0) AS a, sum(wbar / s0 * p1 / s0) AS a1, sum(wbar / s0 * p2 / s0) AS a2,
    sum((1 - l / d) * wbar / s0) AS q, sum((1 - l / d) * wbar / s0 * p1 / s0) AS q1, sum((1 - l / d) * wbar / s0 * p2 / s0) AS q2,
    sum(p1 / s0) / max(d) AS x1bar, sum(p2 / s0) / max(d) AS x2bar,
    max(e1) - sum(wbar * p1 / s0) AS u1, max(e2) - sum(wbar * p2 / s0) AS u2,
    sum(wbar * p1 / s0 * (1 - p1 / s0)) AS v11, sum(wbar * p2 / s0 * (1 - p2 / s0)) AS v22, -sum(wbar * p1 / s0 * p2 / s0) AS v12
  FROM ranks GROUP BY t)"""


@query(f"""{_AT_FIT},
rows_ AS (SELECT t, cat, ev, sum(w * w) AS w2 FROM {_ARM_SOURCE} GROUP BY ALL),
cum AS (SELECT t, sum(coalesce(a, 0)) OVER o AS ca, sum(coalesce(a1, 0)) OVER o AS ca1, sum(coalesce(a2, 0)) OVER o AS ca2, days.* EXCLUDE (t)
  FROM (SELECT DISTINCT t FROM rows_) LEFT JOIN days USING (t) WINDOW o AS (ORDER BY t)),
res AS (SELECT w2, CASE cat WHEN 0 THEN 1 WHEN 1 THEN exp(b1) ELSE exp(b2) END AS r, CAST(cat = 1 AS INT) AS x1, CAST(cat = 2 AS INT) AS x2, ev,
    ca + ev * coalesce(q - a, 0) AS h, ca1 + ev * coalesce(q1 - a1, 0) AS h1, ca2 + ev * coalesce(q2 - a2, 0) AS h2, x1bar, x2bar
  FROM rows_ JOIN cum USING (t), last),
res2 AS (SELECT w2, CASE WHEN ev = 1 THEN x1 - x1bar ELSE 0 END - r * (x1 * h - h1) AS g1, CASE WHEN ev = 1 THEN x2 - x2bar ELSE 0 END - r * (x2 * h - h2) AS g2 FROM res),
meat AS (SELECT sum(w2 * g1 * g1) AS m11, sum(w2 * g1 * g2) AS m12, sum(w2 * g2 * g2) AS m22 FROM res2),
inv AS (SELECT b1, b2, i22 / det AS n11, -i12 / det AS n12, i11 / det AS n22 FROM (SELECT *, i11 * i22 - i12 * i12 AS det FROM last))
SELECT '{_ARMS[0]}' AS term, round(b1, 6) AS estimate, round(sqrt(n11), 6) AS std_error,
  round(sqrt(n11 * n11 * m11 + 2 * n11 * n12 * m12 + n12 * n12 * m22), 6) AS robust_se FROM inv, meat
UNION ALL SELECT '{_ARMS[1]}', round(b2, 6), round(sqrt(n22), 6), round(sqrt(n12 * n12 * m11 + 2 * n12 * n22 * m12 + n22 * n22 * m22), 6) FROM inv, meat""")
def cox_sandwich_by_arm(spark, folder):
    """Weighted model on the arm with the sandwich errors."""
    fit = Y.cox(known_arm(spark, folder), "time", "status", ARM_TERMS, weight="w")
    table = report.coef_table(spark, fit).select("term", "estimate", "std_error", "robust_se")
    fit.close()
    return rounded(table)


_TRANSFORM = f"""{_AT_FIT},
leave AS (SELECT t, count(*) AS n FROM {_ARM_SOURCE} GROUP BY 1),
at_risk AS (SELECT t, sum(n) OVER (ORDER BY t DESC) AS n_risk FROM leave),
km AS (SELECT days.*, 1 - exp(coalesce(sum(CASE WHEN d < n_risk THEN ln(1 - d / n_risk) END)
    OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS g FROM days JOIN at_risk USING (t)),
gt AS (SELECT *, g - (SELECT sum(g * d) / sum(d) FROM km) AS gt FROM km)"""


@query(f"""{_TRANSFORM},
sums AS (SELECT sum(gt * u1) AS s1, sum(gt * u2) AS s2, sum(v11) AS a11, sum(v12) AS a12, sum(v22) AS a22, sum(gt * v11) AS b11, sum(gt * v12) AS b12,
    sum(gt * v22) AS b22, sum(gt * gt * v11) AS c11, sum(gt * gt * v12) AS c12, sum(gt * gt * v22) AS c22 FROM gt),
inv AS (SELECT *, a22 / (a11 * a22 - a12 * a12) AS n11, -a12 / (a11 * a22 - a12 * a12) AS n12, a11 / (a11 * a22 - a12 * a12) AS n22 FROM sums),
half AS (SELECT *, b11 * n11 + b12 * n12 AS k11, b11 * n12 + b12 * n22 AS k12, b12 * n11 + b22 * n12 AS k21, b12 * n12 + b22 * n22 AS k22 FROM inv),
left_ AS (SELECT s1, s2, c11 - (k11 * b11 + k12 * b12) AS l11, c12 - (k11 * b12 + k12 * b22) AS l12, c22 - (k21 * b12 + k22 * b22) AS l22 FROM half),
chi AS (SELECT (s1 * s1 * l22 - 2 * s1 * s2 * l12 + s2 * s2 * l11) / (l11 * l22 - l12 * l12) AS chisq FROM left_)
SELECT term, round(chisq, 6) AS chisq, CAST(2 AS INTEGER) AS df, round(exp(-chisq / 2), 6) AS p FROM chi, (VALUES ('arm'), ('GLOBAL')) v(term)""")
def cox_zph_by_arm(spark, folder):
    """Proportional-hazards test of the arm, two degrees of freedom."""
    fit = Y.cox(known_arm(spark, folder), "time", "status", ARM_TERMS, weight="w")
    tests = Y.cox_zph(fit, {"arm": list(ARM_TERMS)})
    fit.close()
    return rounded(Y.zph_table(spark, tests))


@query(f"""{_TRANSFORM},
ev AS (SELECT t, cat, count(*) AS n FROM {_ARM_SOURCE} WHERE ev = 1 GROUP BY ALL),
raw AS (SELECT CAST(t AS INTEGER) AS time, gt AS transformed, n, CAST(cat = 1 AS INT) - x1bar AS e1, CAST(cat = 2 AS INT) - x2bar AS e2 FROM ev JOIN gt USING (t))
SELECT time, round(transformed, 6) AS transformed, n, '{_ARMS[0]}' AS term, round(e1, 6) AS residual FROM raw
UNION ALL SELECT time, round(transformed, 6), n, '{_ARMS[1]}', round(e2, 6) FROM raw""")
def schoenfeld_by_arm(spark, folder):
    """Schoenfeld residuals of the arm; rows that agree in day and arm are one."""
    fit = Y.cox(known_arm(spark, folder), "time", "status", ARM_TERMS, weight="w")
    return rounded(Y.schoenfeld_residuals(fit).select("time", "transformed", "n", "term", "residual"))
