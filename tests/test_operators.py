"""Hand-made rows: boundaries, missing values, ties."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortline.functions import columns as X
from cohortline.functions.code_index import CodeIndex
from cohortline.functions.fixed_values import INDEX_WEIGHTS
from cohortline.functions.sizing import cut_lineage
from cohortline.operators import cohort as C
from cohortline.operators import describe as B
from cohortline.operators import followup as U
from cohortline.operators import matching as M
from cohortline.operators import phenotype as P
from cohortline.operators import rates as R
from cohortline.operators import timejoin as T
from cohortline.sources import tables as S
from cohortline.sources.tables import Rule

D0 = dt.date(2021, 6, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def anchors(spark, n, name="index_date"):
    return spark.createDataFrame([(i, D0) for i in range(n)], f"patient_id long, {name} date")


def test_look_back_is_strict(spark):
    dx = spark.createDataFrame([(0, day(-1), "011"), (1, day(0), "011"), (2, day(1), "011")],
                               "patient_id long, date date, code string")
    flags = P.history_flags(dx, anchors(spark, 4), [Rule("dx_a", "^01[0-8]")])
    assert [r["dx_a"] for r in flags.orderBy("patient_id").collect()] == [1, 0, 0, 0]


@pytest.mark.parametrize("inclusive,want", [(False, [0, 1, 1, 0]), (True, [0, 1, 1, 1])])
def test_episode_overlap(spark, inclusive, want):
    rows = [(0, "2.1", day(-200), 19), (1, "2.1", day(-200), 20), (2, "2.1", day(-200), 21), (3, "2.1", day(0), 1)]
    rx = S.with_end_date(spark.createDataFrame(rows, "patient_id long, bnf string, disp_date date, days int"))
    flags = P.episode_flags(rx, anchors(spark, 4), [Rule("rx_a", "^2.1")], "bnf", 180, ["patient_id", "index_date"],
                            inclusive=inclusive)
    assert [r["rx_a"] for r in flags.orderBy("patient_id").collect()] == want


def test_long_early_episode_is_not_hidden_by_a_short_late_one(spark):
    rows = [(0, "2.1", day(-400), 390), (0, "2.1", day(-300), 5)]
    rx = S.with_end_date(spark.createDataFrame(rows, "patient_id long, bnf string, disp_date date, days int"))
    flags = P.episode_flags(rx, anchors(spark, 1), [Rule("rx_a", "2")], "bnf", 180, ["patient_id", "index_date"])
    assert flags.first()["rx_a"] == 1


@pytest.mark.parametrize("ignore_case", [True, False])
def test_indexed_rules_agree_with_their_patterns(spark, ignore_case):
    """Prefixes, whole codes, classes, optional characters and what only a regular expression can say."""
    patterns = ["^00[1-5]", "^01|^003", "9$", "^rif[ai]0", "^RIFA1[16]", "^2[.]1$", "^2[.]1[0-2]?$", "^5.1", "^a?b", "^x?", "^[^0]1", "^0[0-9][0-9]$", "^ISON1[012]|^ison0[1-9]",
                "^(12|34)", "^V\\.7", "^é", "^0", "^k"]
    codes = [f"{i:03d}" for i in range(60)] + ["rifa01", "RIFI02", "Rifa11", "rifA16", "RIFA11", "2.1", "2.10", "2.13", "2.1x", "5x1", "b", "ab", "AB1", "ISON10", "ison03", "iSoN12", "12", "34a",
                                               "v.7", "V.71", "é1", "É1", "", None, "\u212a1", "K1", "k", "01"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "row int, code string")
    got = {(r["row"], r["_rule"]) for r in CodeIndex.of(patterns, ignore_case).matches(df, "code").collect()}
    want = set()
    for n, p in enumerate(patterns):
        want |= {(r["row"], n) for r in df.where(F.col("code").rlike(f"(?i){p}" if ignore_case else p)).collect()}
    assert got == want and {n for _, n in want} >= set(range(16))


def test_rules_prune_the_scan(spark, tmp_path):
    dx = spark.createDataFrame([(i % 5, day(-i), f"{i:03d}") for i in range(200)], "patient_id long, date date, code string")
    dx.write.parquet(f"{tmp_path}/dx")
    stored = spark.read.parquet(f"{tmp_path}/dx")
    flags = P.history_flags(stored, anchors(spark, 5), [Rule("dx_a", "^01[0-8]"), Rule("dx_b", "^15|^RIF")])
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = flags._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.count("FileScan parquet") == 1
    assert "GreaterThanOrEqual(code,01" in plan and "LessThan(code," in plan and "GreaterThanOrEqual(code,R" in plan
    assert [r["dx_a"] for r in flags.orderBy("patient_id").collect()] == [1] * 5


def test_many_rules(spark):
    """A thousand rules are one pass, each right."""
    dx = spark.createDataFrame([(i % 7, day(-1), f"{i:03d}") for i in range(0, 1000, 3)], "patient_id long, date date, code string")
    rules = [Rule(f"dx_{i}", f"^{i:03d}") for i in range(1000)]
    rows = {r["patient_id"]: r.asDict() for r in P.history_flags(dx, anchors(spark, 7), rules).collect()}
    for i in range(1000):
        assert {p for p in rows if rows[p][f"dx_{i}"]} == ({i % 7} if i % 3 == 0 else set())


def test_fourteen_day_window(spark):
    cases = spark.createDataFrame([(0, D0)], "patient_id long, date date")
    rx = spark.createDataFrame([(0, "ISON01", "5.1.9", day(n)) for n in (-1, 0, 13, 14)],
                               "patient_id long, item_cd string, bnf string, disp_date date")
    got = C.treatment_records(rx, cases)
    assert sorted(r["disp_date"] for r in got.collect()) == [day(0), day(13)]


def test_year_of_contacts_is_open_at_both_ends(spark):
    enc = spark.createDataFrame([(0, day(n), "1.IP") for n in (-365, -364, -1, 0)], "patient_id long, date date, source string")
    got = T.window_counts(enc, anchors(spark, 2), {"ip": "1.IP", "ae": "2.AE"}, 365, ["patient_id"])
    assert {r["patient_id"]: (r["ip"], r["ae"]) for r in got.collect()} == {0: (2, 0), 1: (0, 0)}


def test_duplicate_anchors_count_again(spark):
    enc = spark.createDataFrame([(0, day(-3), "1.IP")], "patient_id long, date date, source string")
    twice = anchors(spark, 1).unionAll(anchors(spark, 1))
    assert T.window_counts(enc, twice, {"ip": "1.IP"}, 365, ["patient_id"]).first()["ip"] == 2


def test_risk_window_starts_on_day_thirty(spark):
    df = spark.createDataFrame([(0, D0, day(29)), (1, D0, day(30)), (2, D0, None)],
                               "patient_id long, index_date2 date, event_date date")
    got = U.risk_window_outcome(df).orderBy("patient_id").collect()
    assert [r["event_late"] for r in got] == [0, 1, 0]
    assert [r["event_date_late"] for r in got] == [None, day(30), None]


def test_dates(spark):
    df = spark.createDataFrame([("2019-07", ""), (None, "2020-01-02")], "m string, d string")
    got = df.select(X.month_to_date(F.col("m")).alias("m"), X.blank_to_date(F.col("d")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(dt.date(2019, 7, 15), None), (None, dt.date(2020, 1, 2))]


def test_combination_recode_is_case_sensitive(spark):
    cases = spark.createDataFrame([(i, D0) for i in range(3)], "patient_id long, date date")
    rx = spark.createDataFrame([(0, "RIFA05", "5.1.9", D0), (1, "rifa05", "5x1x9", D0), (2, "RIFI01", "5.1.9", D0)],
                               "patient_id long, item_cd string, bnf string, disp_date date")
    got = {r["patient_id"]: r["drug"] for r in C.treatment_records(rx, cases).collect()}
    assert got == {0: "RIFA", 1: "RIFI", 2: "RIFI"}
    loose = {r["patient_id"]: r["drug"] for r in C.treatment_records(rx, cases, ignore_case_recode=True).collect()}
    assert loose == {0: "RIFI", 1: "RIFI", 2: "RIFI"}


def test_graver_form_supersedes(spark):
    df = spark.createDataFrame([(1, 1, 0, 1), (1, 0, 1, 0), (0, 0, 1, 1)],
                               "dx_dm_com0 int, dx_dm_com1 int, dx_liver_mild int, dx_liver_modsev int")
    absent = [c for c in INDEX_WEIGHTS if c not in df.columns]
    assert [r["cci"] for r in P.comorbidity_index(df, absent=absent).collect()] == [2 + 3, 1 + 1, 3]
    with pytest.raises(ValueError, match="dx_mi"):
        P.comorbidity_index(df)


def test_exclusions_keep_unknown(spark):
    df = spark.createDataFrame([(1, D0, None), (2, D0, day(-1)), (3, D0, D0), (None, D0, None)],
                               "patient_id long, index_date2 date, death_date date")
    got = {r["patient_id"] for r in C.exclude_early_death(df).collect()}
    assert got == {1, 3, None}


def test_order_of_filter_and_first(spark):
    dx = spark.createDataFrame(
        [(0, 1, day(1), "011", "2.AE", "P"), (0, 2, day(2), "011", "1.IP", "P"), (1, 3, day(3), "012", "1.IP", "P")],
        "patient_id long, rec_id long, date date, code string, source string, ranking string")
    after = C.cases_earliest_first(dx, anchors(spark, 2)).where(C.primary_inpatient())
    before = C.cases_filter_first(dx, F.lit(D0))
    assert {r["rec_id"] for r in after.collect()} == {3}
    assert {r["rec_id"] for r in before.collect()} == {2, 3}


def test_both_regimens(spark):
    df = spark.createDataFrame([(0, 1, 1, 1, 1, 0, 1), (1, 1, 0, 0, 0, 1, 1), (2, 1, 1, 1, 0, 0, 0)],
                               "patient_id long, pyra int, ison int, rifa int, stre int, etha int, rifi int")
    assert sorted(r["patient_id"] for r in C.regimen_confirmed(df).collect()) == [0, 0, 1]
    assert sorted(r["patient_id"] for r in C.regimen_confirmed(df, duplicate=False).collect()) == [0, 1]


def test_dose_status(spark):
    df = spark.createDataFrame([(D0, D0, day(5)), (day(5), D0, day(5)), (day(1), D0, None), (D0, None, None)],
                               "date date, date_1st date, date_2nd date")
    loose = [tuple(r)[3:] for r in C.dose_status(df).collect()]
    assert loose == [(1, 0), (1, 1), (1, 0), (0, 0)]
    assert [r["vaccinated"] for r in C.dose_status(df, strict=True).collect()] == [0, 1, 1, 0]
    assert C.exclude_between_doses(C.dose_status(df)).count() == 2


def test_dateless_first_positive_test(spark):
    lab = spark.createDataFrame([(0, None, "213", "detected"), (0, day(-5), "213", "detected"),
                                 (1, day(0), "2170", "detected"), (2, day(-5), "214", "detected"), (3, day(3), "216", "detected")],
                                "patient_id long, date date, t_num string, result string")
    got = C.infection_history(anchors(spark, 4, "index_date2"), lab).orderBy("patient_id").collect()
    assert [r["infection_his"] for r in got] == [0, 1, 0, 0]
    assert [r["infection_after"] for r in got] == [None, None, None, day(3)]


def test_treatment_arm(spark):
    df = spark.createDataFrame([("Sinovac", "Sinovac", 1), ("Sinovac", "BioNTech/Fosun", 1), ("Sinovac", "Sinovac", 0),
                                ("Other", "Other", 1), (None, None, 1)], "brand_1st string, brand_2nd string, vaccinated int")
    assert [r[0] for r in df.select(C.treatment_arm()).collect()] == ["CoronaVac", None, "None", None, None]


def test_split_followup_boundaries(spark):
    df = spark.createDataFrame([(0, 50, 1), (1, 51, 1), (2, 151, 0)], "patient_id long, time int, status int")
    got = sorted(tuple(r) for r in U.split_followup(df).select("patient_id", "tstart", "tstop", "status").collect())
    assert got == [(0, 0, 50, 1), (1, 0, 50, 0), (1, 50, 51, 1),
                   (2, 0, 50, 0), (2, 50, 100, 0), (2, 100, 150, 0), (2, 150, 151, 0)]


def test_quantile_type_seven_and_zero_events(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("a", 3, 0), ("a", 10, 0), ("b", 5, 0)],
                               "arm string, time int, status int")
    q = {r["arm"]: r for r in R.followup_quantiles(df, ["arm"]).collect()}
    assert (q["a"]["q25_time"], q["a"]["median_time"]) == (1.75, 2.5)
    assert [r["arm"] for r in R.incidence_rates(df).collect()] == ["a"]


@pytest.mark.parametrize("n", [1, 5, 474, 10**7])
def test_profile_limits_solve_the_profile(spark, n):
    import math
    low, high = spark.range(1).select(R.profile_limit(F.lit(n), -1), R.profile_limit(F.lit(n), 1)).first()
    assert low < n < high
    for m in (low, high):
        assert 2 * (n * math.log(n / m) - (n - m)) == pytest.approx(3.841458820694124, rel=1e-4)


def test_chisq_with_and_without_correction(spark):
    df = spark.createDataFrame([("x", 0, "M")] * 10 + [("x", 1, "F")] * 5 + [("y", 0, "F")] * 3 + [("y", 1, "M")] * 12,
                               "arm string, tb int, sex string")
    table = B.contingency(df, "arm", [["tb"], ["tb", "sex"]])
    got = {r["strata"]: r for r in B.chisq_test(table).collect()}
    want = (abs(10 * 12 - 5 * 3) - 15) ** 2 * 30 / (15 * 15 * 13 * 17)
    assert got["tb"]["chisq"] == pytest.approx(want) and got["tb"]["df"] == 1
    # the second table has empty cells: all of x or y in each column
    assert got["tb+sex"]["chisq"] == pytest.approx(30.0) and got["tb+sex"]["df"] == 3


def test_tails_as_columns(spark):
    """Against the finite sums, from far below the mean to far above it."""
    from cohortline.functions.tails import chi2_tail, chi2_upper, normal_tail, normal_two_sided

    cases = [(x, k) for k in (1, 2, 3, 4, 5, 8, 31, 100, 401) for x in (0.0, 1e-9, 0.3, 0.999 * k, float(k), k + 2.0, k + 2.1, 1.5 * k, 3.0 * k + 20, 900.0)]
    df = spark.createDataFrame(cases, "x double, k int")
    for r in df.withColumn("p", chi2_tail(F.col("x"), F.col("k"))).collect():
        assert r["p"] == pytest.approx(chi2_upper(r["x"], r["k"]), rel=1e-7, abs=1e-12), r
    odd = spark.createDataFrame([(None, 1), (2.0, None), (2.0, 0), (-1.0, 2)], "x double, k int").select(chi2_tail(F.col("x"), F.col("k")).alias("p"))
    assert [r["p"] for r in odd.collect()] == [None, None, None, 1.0]
    z = spark.createDataFrame([(v,) for v in (-5.0, -1.96, 0.0, 0.5, 9.0)], "z double").select("z", normal_tail(F.col("z")).alias("p"))
    for r in z.collect():
        assert r["p"] == pytest.approx(normal_two_sided(r["z"]), rel=1e-7)


def test_attrition_counts_in_order(spark):
    df = spark.createDataFrame([(i, i) for i in range(10)], "patient_id long, age int")
    ids = spark.createDataFrame([(1,), (8,), (8,), (9,)], "patient_id long")
    got = [(r["step"], r["n_rows"]) for r in C.attrition(df, [("young", F.col("age") < 3), ("listed", ids)]).collect()]
    assert got == [("registry", 10), ("young", 7), ("listed", 5)]


def test_reasons_from_one_pass(spark):
    """History counts whatever its date, recent records before the cut-off; rows of unknown id stay."""
    people = spark.createDataFrame([(i, D0) for i in range(6)] + [(None, D0), (7, None), (8, None)], "patient_id long, index_date date")
    old = spark.createDataFrame([(0, "011", "2019-01"), (7, "011", "2019-01"), (5, "999", "2019-01"), (None, "011", "2019-01")], "patient_id long, code string, date_ym string")
    new = spark.createDataFrame([(1, day(-1), "012"), (2, D0, "012"), (3, day(-1), "196"), (3, day(-2), "011"), (8, day(-1), "011"), (4, None, "011")],
                                "patient_id long, date date, code string")
    tests = {"tb": X.find(F.col("code"), "^01"), "mets": X.find(F.col("code"), "^19")}
    hits = C.reason_hits(S.both_ages(old, new, ["code"], "date"), tests, "date")
    marked = C.mark_reasons(people, {"tb": hits, "mets": hits}, F.col("index_date"))
    got = {r["patient_id"]: (r["_has_tb"], r["_has_mets"]) for r in marked.collect()}
    assert got == {0: (True, False), 1: (True, False), 2: (False, False), 3: (True, True), 4: (False, False), 5: (False, False), None: (False, False), 7: (True, False), 8: (False, False)}
    kept = C.without_reasons(people, {"tb": hits, "mets": hits}, F.col("index_date"))
    assert kept.columns == people.columns
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 3  # people and each record table once
    ids = C.exclude(people, C.prior_diagnosis(old, new, "^01", anchors=people))
    assert sorted(kept.collect(), key=str) == sorted(C.exclude(ids, C.prior_diagnosis(old, new, "^19", anchors=people)).collect(), key=str)


def test_union_helpers(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(2, 3.0)], "k int, u double")
    assert X.fill_union(a, b).count() == 2 and X.fill_union(a, b).columns == ["k", "v", "u"]
    assert X.plain_names(a.toDF("a.b", "1c")).columns == ["a_b", "x1c"]
    with pytest.raises(ValueError):
        X.natural_join(a, b.select(F.col("u").alias("z")))


# --- matching -------------------------------------------------------------------------

COHORT = "patient_id long, date date, age int, sex string, tb int"


def test_small_pool_is_padded(spark):
    rows = [(0, D0, 50, "M", 1)] + [(i, day(1), 50, "M", 0) for i in (1, 2, 3)]
    rows += [(4, day(2), 50, "M", 0), (5, D0, 51, "M", 0), (6, D0, 50, "F", 0)]
    got = M.match_controls(spark.createDataFrame(rows, COHORT)).collect()
    assert len(got) == 10 and {r["pool_size"] for r in got} == {3}
    assert sorted(r["control_id"] for r in got if r["control_id"] is not None) == [1, 2, 3]
    wide = M.match_wide(M.match_controls(spark.createDataFrame(rows, COHORT)))
    assert wide.first()["M10"] is None and wide.count() == 1


def test_case_without_pool_keeps_its_row(spark):
    got = M.match_controls(spark.createDataFrame([(0, D0, 50, "M", 1), (1, D0, 20, "M", 0)], COHORT)).collect()
    assert len(got) == 10 and {(r["pool_size"], r["control_id"]) for r in got} == {(0, None)}


def _skewed(n_cases, n_controls):
    rows = [(i, D0, 50, "M", 1) for i in range(n_cases)]
    rows += [(1000 + i % n_controls, day(i % 3 - 1), 50, "M", 0) for i in range(3 * n_controls)]
    return rows


def test_hot_cell(spark, monkeypatch):
    """One cell holds everything: K distinct controls per case, the same picks however it is split."""
    df = spark.createDataFrame(_skewed(40, 500), COHORT)
    whole = sorted(tuple(r) for r in M.match_controls(df).collect())
    monkeypatch.setattr(M, "POOL_ROWS_PER_TASK", 3)
    split = sorted(tuple(r) for r in M.match_controls(df.repartition(7)).collect())
    assert whole == split
    picks = {}
    for r in M.match_controls(df).collect():
        picks.setdefault(r["case_id"], set()).add(r["control_id"])
        assert r["pool_size"] == 500
    assert all(len(p) == 10 for p in picks.values())


def test_draws_are_independent_and_uniform(spark):
    """Two cases of one pool share as many controls as two independent draws, and every control is drawn as often."""
    cases, pool, k = 400, 80, 10
    df = spark.createDataFrame(_skewed(cases, pool), COHORT)
    picks = {}
    for r in M.match_controls(df).collect():
        picks.setdefault(r["case_id"], []).append(r["control_id"])
    sets = [set(p) for p in picks.values()]
    assert len(sets) == cases and all(len(s) == k for s in sets)
    overlaps = [len(a & b) for i, a in enumerate(sets) for b in sets[i + 1:]]
    # hypergeometric: mean k * k / n, variance mean * (1 - k / n) * (n - k) / (n - 1)
    mean, variance = k * k / pool, k * k / pool * (1 - k / pool) * (pool - k) / (pool - 1)
    assert sum(overlaps) / len(overlaps) == pytest.approx(mean, rel=0.02)
    assert sum((x - mean) ** 2 for x in overlaps) / len(overlaps) == pytest.approx(variance, rel=0.1)
    drawn = [sum(1000 + c in s for s in sets) for c in range(pool)]
    expected = cases * k / pool
    # draws without replacement vary by (1 - k / n) of the multinomial's chi-square of pool - 1 degrees
    assert sum((x - expected) ** 2 / expected for x in drawn) < 1.5 * (pool - 1) * (1 - k / pool)
    neighbours = [len({c, c + 1} & s) == 2 for s in sets for c in range(1000, 1000 + pool - 1)]
    assert sum(neighbours) / len(neighbours) == pytest.approx(k * (k - 1) / (pool * (pool - 1)), rel=0.15)


def test_small_pools_are_drawn_whole(spark):
    for size in (1, 2, 9, 10, 11):
        rows = [(0, D0, 50, "M", 1)] + [(100 + i, day(1), 50, "M", 0) for i in range(size)]
        got = [r["control_id"] for r in M.match_controls(spark.createDataFrame(rows, COHORT)).orderBy("m").collect()]
        drawn = [c for c in got if c is not None]
        assert len(got) == 10 and len(drawn) == len(set(drawn)) == min(size, 10) and None not in got[:min(size, 10)]


def test_pools_are_not_written(spark, monkeypatch):
    """Overlapping pools of 41 cells: what is written grows with the records and the draws, not with the pools' rows."""
    rows = [(i, day(i), 50, "M", 1) for i in range(41)] + [(1000 + i, day(i % 41), 50, "M", 0) for i in range(4000)]
    written = []
    monkeypatch.setattr(M, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    got = M.match_controls(spark.createDataFrame(rows, COHORT), date_gap=20)
    sizes = {r["date"]: r["pool_size"] for r in got.collect()}
    assert sizes[day(20)] == 4000 and sum(sizes.values()) > 100_000
    assert max(t.count() for t in written) < 10_000


def test_pool_members_once_whatever_their_records(spark):
    """Repeated, missing and unknown values: a patient is in a pool once, an unknown one as well."""
    rows = [(0, D0, 50, "M", 1), (0, D0, 50, "M", 1), (None, day(1), 50, "M", 1), (9, None, 50, "M", 1), (8, D0, None, "M", 1), (7, D0, 50, None, 1)]
    rows += [(1, day(n), 50, "M", 0) for n in (-3, -1, 0, 0, 2, 9)] + [(None, D0, 50, "M", 0), (None, D0, 50, "M", 0), (2, None, 50, "M", 0), (3, D0, None, "M", 0), (4, D0, 50, None, 0)]
    got = M.match_controls(spark.createDataFrame(rows, COHORT), date_gap=2).collect()
    of = lambda case: sorted((r["pool_size"], str(r["control_id"])) for r in got if r["case_id"] == case)
    assert of(0) == sorted([(2, "None"), (2, "1")] * 2 + [(2, "None")] * 16)
    assert of(None) == sorted([(2, "1")] + [(2, "None")] * 9)
    assert all(of(c) == [(0, "None")] * 10 for c in (9, 8, 7)) and len(got) == 60


def test_match_respects_gaps_and_self_matches(spark):
    rows = [(0, D0, 50, "M", 1), (0, day(-1), 50, "M", 0), (1, day(-2), 49, "M", 0), (2, day(2), 51, "M", 0), (3, day(3), 50, "M", 0)]
    got = M.match_controls(spark.createDataFrame(rows, COHORT), age_gap=1, date_gap=2)
    assert {r["control_id"] for r in got.collect()} == {0, 1, 2, None}
    long = M.match_long(M.match_wide(got))
    assert sorted(r["control_id"] for r in long.collect()) == [1, 2]


def test_several_match_variables_intersect_patients(spark):
    schema = COHORT + ", place string"
    rows = [(0, D0, 50, "M", 1, "a"), (1, D0, 50, "M", 0, "a"), (2, D0, 50, "M", 0, "b"), (3, D0, 50, "F", 0, "a"),
            (4, D0, 50, "M", 0, "b"), (4, D0, 50, "F", 0, "a")]
    got = M.match_controls(spark.createDataFrame(rows, schema), match_vars=["sex", "place"])
    assert sorted(r["control_id"] for r in got.collect() if r["control_id"] is not None) == [1, 4]


def test_drop_recent_sets(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 0, None), (2, 1, 30), (2, 0, 5), (3, 1, None)],
                               "match int, tb int, onset_time int")
    assert sorted({r["match"] for r in M.drop_recent_sets(df).collect()}) == [2, 3]


# --- sources and sinks ------------------------------------------------------------------

def test_years_codebook_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2018), (2, 2019), (3, 2021)], "patient_id int, year int")
    S.write_table(df, f"{tmp_path}/rx", ["year"])
    years = S.read_years(spark, f"{tmp_path}/rx", [2018, 2019, 2020])
    assert sorted(r[0] for r in years.collect()) == [1, 2]
    assert "PartitionFilters: [year" in years._jdf.queryExecution().executedPlan().toString()
    rules = spark.createDataFrame([("dx_a", "^01"), ("rx_b", "^2[.]1")], "name string, regex string")
    S.write_book({"rules": rules, "years": df}, f"{tmp_path}/book")
    book = S.read_codebook(spark, f"{tmp_path}/book/rules")
    assert sorted(r.name for r in book) == ["dx_a", "rx_b"] and [r.name for r in S.rules_named(book, "rx")] == ["rx_b"]
    S.write_book({"years": df}, f"{tmp_path}/bundle", "parquet")
    assert S.read_bundle(spark, f"{tmp_path}/bundle", ["years"])["years"].count() == 3


def test_years_are_stored_and_pruned(spark, tmp_path):
    rows = [(i % 9, dt.date(2015 + i % 8, 1 + i % 12, 5), "011") for i in range(400)] + [(1, None, "x")]
    S.write_years(spark.createDataFrame(rows, "patient_id long, date date, code string"), f"{tmp_path}/dx", "date")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    some = S.read_years(spark, f"{tmp_path}/dx", [2016, 2018])
    assert "PartitionFilters: [year" in plan(some) and some.count() == sum(r[1] is not None and r[1].year in (2016, 2018) for r in rows)
    own = spark.createDataFrame([(1, dt.date(2018, 3, 1)), (2, dt.date(2018, 9, 1)), (3, None)], "patient_id long, index_date date")
    near = S.read_lookback(spark, f"{tmp_path}/dx", own, "index_date", 365)
    assert "dynamicpruning" in plan(near)
    assert near.columns == ["patient_id", "date", "code"]
    assert near.count() == sum(r[1] is not None and r[1].year in (2017, 2018) for r in rows)
    assert S.read_lookback(spark, f"{tmp_path}/dx", own.where("patient_id = 3"), "index_date", 365).count() == 0


def test_books_are_versions(spark, tmp_path):
    """A book that breaks off half way leaves the former one in place."""
    from cohortline.operators import report

    base = str(tmp_path / "book")
    good = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    with pytest.raises(FileNotFoundError):
        report.read_book(spark, base, "one")
    first = report.result_book({"one": good, "two": good.limit(1)}, base, "parquet")
    broken = good.select(F.raise_error(F.lit("no")).alias("k"))
    with pytest.raises(Exception, match="no"):
        report.result_book({"one": good.limit(0), "two": broken}, base, "parquet")
    assert report.read_book(spark, base, "one").count() == 2 and report.book_versions(spark, base).count() == 2
    second = report.result_book({"one": good.limit(1)}, base)
    assert second > first and report.read_book(spark, base, "one").collect()[0]["v"] in ("a", "b")
    assert report.read_book(spark, base, "two", first).count() == 1
    with pytest.raises(FileNotFoundError, match="two"):
        report.read_book(spark, base, "two")


def test_registry_is_cleaned(spark):
    raw = spark.createDataFrame([(1, " ", "2021-05-01"), (2, "2021-07-01", None), (3, "unknown", "")], "`patient.id` long, `death.date` string, `date.of.dose` string")
    got = S.clean_registry(raw)
    assert got.columns == ["patient_id", "death_date", "date_of_dose"]
    assert [tuple(r)[1:] for r in got.orderBy("patient_id").collect()] == [(None, dt.date(2021, 5, 1)), (dt.date(2021, 7, 1), None), (None, None)]


def test_hash_text_is_portable(spark):
    got = spark.range(1).select(M._hash_text(F.lit(475), F.lit("M"), F.lit(D0))).first()[0]
    assert got == duckdb.sql("select md5(concat_ws('|', '475', 'M', DATE '2021-06-01'))").fetchall()[0][0]


def test_lineage_folder(spark):
    from cohortline.functions import sizing

    def session(master, **settings):
        conf = type("Conf", (), {"get": lambda self, key, default=None: settings.get(key, default)})()
        context = type("Context", (), {"master": master, "applicationId": "app-1"})
        return type("Session", (), {"conf": conf, "sparkContext": context})

    named = {"spark.checkpoint.dir": "hdfs://shared/ckpt/", "spark.sql.warehouse.dir": "file:/home/x/spark-warehouse"}
    assert sizing.shared_folder(session("yarn", **named)) == "hdfs://shared/ckpt/_cohortline/app-1"
    warehouse = {"spark.sql.warehouse.dir": "file:/home/x/spark-warehouse"}
    assert sizing.shared_folder(session("local[8]", **warehouse)) == "file:/home/x/spark-warehouse/_cohortline/app-1"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        sizing.shared_folder(session("yarn", **warehouse))
    assert sizing.shared_folder(session("yarn", **{"spark.sql.warehouse.dir": "s3a://lake/wh"})) == "s3a://lake/wh/_cohortline/app-1"
    df = spark.createDataFrame([(1, None), (2, "a")], "k int, v string")
    assert sorted(sizing.cut_lineage(df).collect()) == sorted(df.collect())


def test_contingency_drops_only_own_gaps(spark):
    rows = [("a", 1, "F"), ("a", 0, None), ("b", 1, None), ("b", 1, "M"), (None, 1, "F"), ("b", None, "F")]
    df = spark.createDataFrame(rows, "arm string, tb int, sex string")
    table = {(r["strata"], r["stratum"], r["level"]): r["n"] for r in B.contingency(df, "arm", [["tb"], ["tb", "sex"]]).collect()}
    assert table == {("tb", "1", "a"): 1, ("tb", "0", "a"): 1, ("tb", "1", "b"): 2, ("tb+sex", "1:F", "a"): 1, ("tb+sex", "1:M", "b"): 1}


def test_missing_covariates_are_an_error(spark):
    df = spark.createDataFrame([(1, 1)], "patient_id long, dx_mi int")
    with pytest.raises(ValueError, match="dx_chf"):
        P.comorbidity_index(df)
    others = [c for c in INDEX_WEIGHTS if c != "dx_mi"]
    assert P.comorbidity_index(df, absent=others).first()["cci"] == 1


def test_long_codebooks_and_short_histories(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_RULES", 2)
    rules = [Rule(f"dx_{i}", f"^{i}") for i in range(5)]
    records = spark.createDataFrame([(1, "3x", "2020-01-01"), (1, "0y", "2020-01-02")], "patient_id long, code string, date string")
    anchors = spark.createDataFrame([(1, "2020-02-01"), (2, "2020-02-01")], "patient_id long, index_date string")
    rows = {r["patient_id"]: [r[f"dx_{i}"] for i in range(5)] for r in P.history_flags(records, anchors, rules).collect()}
    assert rows == {1: [1, 0, 0, 1, 0], 2: [0, 0, 0, 0, 0]}
    history = spark.createDataFrame([(1, "2019-07", "h")], "patient_id long, date_ym string, only_here string")
    recent = spark.createDataFrame([(2, "c")], "patient_id long, code string").withColumn("date", F.to_date(F.lit("2021-01-05")))
    both = S.combine_history(history, recent, "date_ym", "date")
    assert both.columns == recent.columns
    assert sorted((r["patient_id"], r["code"], str(r["date"])) for r in both.collect()) == [(1, None, "2019-07-15"), (2, "c", "2021-01-05")]


def test_anchored_patterns_reach_the_scan(spark, tmp_path):
    assert X.literal_prefixes("^01[0-8]") == ["01"] and X.literal_prefixes("^54[0-3]|^47[.]") == ["54", "47"]
    assert X.literal_prefixes("^5.1.9") == ["5"] and X.literal_prefixes("^ab?c|^x") == ["a", "x"]
    assert X.literal_prefixes("^a?|^b") is None and X.literal_prefixes("01") is None and X.literal_prefixes("^(a|b)") is None
    codes = [f"{i:03d}" for i in range(1000)] + ["01", "", "540x", "a1", None]
    spark.createDataFrame([(c,) for c in codes], "code string").write.parquet(str(tmp_path / "codes"))
    df = spark.read.parquet(str(tmp_path / "codes"))
    for pattern in ("^01[0-8]", "^54[0-3]|^47[.]", "^0|^9[0-1]", "^54", "1$"):
        assert df.where(X.find(F.col("code"), pattern)).count() == df.where(F.col("code").rlike(pattern)).count()
    mixed = spark.createDataFrame([(c,) for c in ["rifa01", "RIFA01", "Rifi02", "rIfa", "ISON1", "ison09", "is", "ri", "540", "", None, "xrifa01"]], "code string")
    for pattern in ("^rif[ai]0", "^ISON1|^ison0[1-9]", "^r", "^54[0-3]|^RIFA", "a01$"):
        want = mixed.where(F.col("code").rlike(f"(?i){pattern}")).count()
        assert want and mixed.where(X.find(F.col("code"), pattern, ignore_case=True)).count() == want
    folded = df.where(X.find(F.col("code"), "^ri[fg]", ignore_case=True))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(code,RI)" in folded
    plan = df.where(X.find(F.col("code"), "^01[0-8]"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(code,01)" in plan and "LessThan(code,02)" in plan


def test_overlap_is_linear_and_has_no_range_join(spark):
    episodes = spark.createDataFrame([(1, day(-300), day(-100)), (1, day(-10), day(-5)), (1, day(0), day(9)), (None, day(-9), day(9)), (2, None, day(9))],
                                     "patient_id long, disp_date date, end_date date")
    own = spark.createDataFrame([(1, day(0)), (1, day(-150)), (1, day(200)), (1, None), (2, day(0)), (None, day(0)), (1, day(0))], "patient_id long, index_date date")
    got = {}
    for inclusive in (False, True):
        out = T.episode_overlap(episodes, own, {"x": F.lit(True)}, 100, ["patient_id", "index_date"], inclusive=inclusive)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        got[inclusive] = {(r["patient_id"], r["index_date"]): r["x"] for r in out.collect()}
    assert got[False] == {(1, day(0)): 1, (1, day(-150)): 1, (1, day(200)): 0, (1, None): 0, (2, day(0)): 0, (None, day(0)): 0}
    late = T.episode_overlap(episodes, own, {"x": F.lit(True)}, 191, ["patient_id", "index_date"])
    assert {r["index_date"]: r["x"] for r in late.collect() if r["patient_id"] == 1}[day(200)] == 1
    assert got[True] == got[False]


def test_episode_flags_shuffle_a_days_rules_once(spark):
    """rows of a patient's day and rule go straight to the patient's anchors, not by way of a table with a column for each rule."""
    rows = [(0, "2.1", day(-9), 5), (0, "2.2", day(-9), 200), (0, "2.12", day(-400), 1), (1, "2.2", day(-3), 9), (1, "2.1", day(-90), 1)]
    rx = S.with_end_date(spark.createDataFrame(rows, "patient_id long, bnf string, disp_date date, days int"))
    rules = [Rule("rx_a", "^2[.]1$"), Rule("rx_b", "^2[.][1-2]"), Rule("rx_c", "^9")]
    flags = P.episode_flags(rx, anchors(spark, 3), rules, "bnf", 60, ["patient_id", "index_date"])
    plan = flags._jdf.queryExecution().executedPlan().toString()
    assert "Pivot" not in plan and plan.count("Exchange hashpartitioning(patient_id") == 2 and plan.count("Exchange hashpartitioning(_key") == 1
    assert [(r["rx_a"], r["rx_b"], r["rx_c"]) for r in flags.orderBy("patient_id").collect()] == [(1, 1, 0), (0, 1, 0), (0, 0, 0)]


def test_episodes_out_of_reach_of_all_anchors_end_at_the_scan(spark, tmp_path):
    """only episodes that may overlap some anchor's look-back are joined and shuffled; the flags stay those of all episodes."""
    schema = "patient_id long, bnf string, disp_date date, end_date date"
    rows = [(p, "2.1", day(s), None if s == -30 else day(s + n)) for p in (0, 1, None) for s in (-500, -290, -181, -30, 0, 20, 90) for n in (1, 25, 300)]
    rows += [(1, "2.1", None, day(5)), (0, None, day(-5), day(5)), (0, "2.1", day(-40), day(-60))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "rx"))
    rx = spark.read.parquet(str(tmp_path / "rx"))
    for days in ((0,), (0, 20, None), (None,), ()):
        own = spark.createDataFrame([(p, None if d is None else day(d)) for p in (0, 1, 2, None) for d in days], "patient_id long, index_date date")
        for inclusive in (False, True):
            flags = P.episode_flags(rx, own, [Rule("rx_a", "^2.1")], "bnf", 180, ["patient_id", "index_date"], inclusive=inclusive)
            want = {(p, a): int(any(q == p and p is not None and code == "2.1" and a and s and e and (s < a or inclusive and s == a) and (a - e).days <= 180
                                    for q, code, s, e in rows)) for p, a in own.collect()}
            assert {(r["patient_id"], r["index_date"]): r["rx_a"] for r in flags.collect()} == want
            if days == (0,):
                plan = flags._jdf.queryExecution().optimizedPlan().toString()
                below = plan[plan.rindex("Filter"):]
                assert f"<= {day(0)})" in below and f">= {day(-180)})" in below and "parquet" in below
