import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortline.functions.order_statistics import nearest_even_rank, order_statistics
from cohortline.functions.tails import chi2_upper, normal_two_sided
from cohortline.operators import survival as Y
from cohortline.operators.followup import split_followup
from cohortline.operators.propensity import att_weight, propensity_scores, trim_limits, trim_weights
from cohortline.operators.report import coef_table
from tests import dense


@pytest.fixture(scope="module")
def people():
    rng = np.random.default_rng(7)
    n = 400
    arm = rng.choice(["None", "A", "B"], n, p=[0.5, 0.3, 0.2])
    age = rng.integers(20, 80, n)
    hidden = rng.exponential(40 * np.exp(-0.4 * (arm == "A") - 0.01 * (age - 50)), n)
    death = rng.exponential(120, n)
    cens = rng.integers(10, 60, n)
    time = np.ceil(np.minimum(np.minimum(hidden, death), cens)).astype(int)
    status = np.where(hidden <= np.minimum(death, cens), 1, np.where(death <= cens, 2, 0))
    return pd.DataFrame({
        "id": np.arange(n), "arm": arm, "age": age / 10.0, "band": age // 20, "time": time,
        "cause": status, "status": (status == 1).astype(int), "w": rng.choice([0.5, 1.0, 1.7], n)})


def design(pdf, levels=("A", "B"), age=True):
    cols = [(pdf["arm"] == lvl).to_numpy(float) for lvl in levels]
    return np.column_stack(cols + ([pdf["age"].to_numpy(float)] if age else []))


TERMS = {**Y.dummies("arm", ["None", "A", "B"]), "age": "age"}


def test_weighted_cox_with_ties(spark, people):
    beta, naive, robust, _ = dense.newton(design(people), people["time"], people["status"], people["w"].to_numpy())
    fit = Y.cox(spark.createDataFrame(people), "time", "status", TERMS, weight="w")
    assert np.allclose(fit.beta, beta, atol=1e-7)
    assert np.allclose(fit.naive, naive, rtol=1e-6)
    assert np.allclose(fit.robust, robust, rtol=1e-6)
    assert fit.events == people["status"].sum() and fit.n == len(people)
    table = {r["term"]: r for r in coef_table(spark, fit).collect()}
    assert table["age"]["exp_estimate"] == pytest.approx(np.exp(beta[2]))
    assert table["age"]["lower"] == pytest.approx(np.exp(beta[2] - 1.959963984540054 * np.sqrt(robust[2, 2])), rel=1e-6)
    fit.close()


def test_stratified_cox(spark, people):
    beta, naive, robust, _ = dense.newton(design(people, age=False), people["time"], people["status"],
                                          people["w"].to_numpy(), strata=people["band"].to_numpy())
    fit = Y.cox(spark.createDataFrame(people), "time", "status", Y.dummies("arm", ["None", "A", "B"]), "w", "band")
    assert np.allclose(fit.beta, beta, atol=1e-7)
    assert np.allclose(fit.robust, robust, rtol=1e-6)


def test_many_terms_use_the_row_pass(spark, people):
    pdf = people.copy()
    rng = np.random.default_rng(1)
    extra = {f"z{i}": rng.normal(size=len(pdf)) for i in range(8)}
    pdf = pdf.assign(**extra)
    x = np.column_stack([design(pdf), *extra.values()])
    beta, naive, robust, _ = dense.newton(x, pdf["time"], pdf["status"], pdf["w"].to_numpy())
    terms = {**TERMS, **{c: c for c in extra}}
    fit = Y.cox(spark.createDataFrame(pdf), "time", "status", terms, weight="w")
    assert not fit.model.second_order
    assert np.allclose(fit.beta, beta, atol=1e-7)
    assert np.allclose(fit.naive, naive, rtol=1e-6)
    assert np.allclose(fit.robust, robust, rtol=1e-6)


def test_split_followup_changes_nothing(spark, people):
    whole = Y.cox(spark.createDataFrame(people), "time", "status", TERMS, weight="w")
    parts = split_followup(spark.createDataFrame(people), cuts=[10, 25], time="time", status="status")
    split = Y.cox(parts, "tstop", "status", TERMS, weight="w", entry="tstart")
    assert np.allclose(whole.beta, split.beta, atol=1e-7)
    assert np.allclose(whole.naive, split.naive, rtol=1e-6)
    rows = parts.toPandas()
    beta, naive, robust, _ = dense.newton(design(rows), rows["tstop"].to_numpy(), rows["status"].to_numpy(),
                                          rows["w"].to_numpy(), start=rows["tstart"].to_numpy())
    assert np.allclose(split.beta, beta, atol=1e-7)
    assert np.allclose(split.robust, robust, rtol=1e-6)


def test_proportional_hazards_score_test(spark, people):
    want = dense.zph(design(people), people["time"].to_numpy(), people["status"].to_numpy(), people["w"].to_numpy())
    fit = Y.cox(spark.createDataFrame(people), "time", "status", TERMS, weight="w")
    got = Y.cox_zph(fit)
    assert np.allclose([g[1] for g in got], want, rtol=1e-6)
    grouped = Y.cox_zph(fit, {"arm": ["arm_A", "arm_B"], "age": ["age"]})
    assert [g[2] for g in grouped] == [2, 1, 3]
    assert grouped[-1][1] == pytest.approx(want[-1], rel=1e-6)


def test_schoenfeld_residuals_sum_to_zero_without_weights(spark, people):
    fit = Y.cox(spark.createDataFrame(people), "time", "status", TERMS)
    rows = Y.schoenfeld_residuals(fit).toPandas()
    sums = (rows["residual"] * rows["n"]).groupby(rows["term"]).sum()
    assert np.allclose(sums, 0, atol=1e-5)
    assert (rows.groupby("term")["n"].sum() == fit.events).all()
    mean = (rows["scaled"] * rows["n"]).groupby(rows["term"]).sum() / fit.events
    assert np.allclose(mean[fit.terms], fit.beta, atol=1e-4)


def test_fine_gray_equals_the_expanded_model(spark, people):
    df = spark.createDataFrame(people)
    short = Y.fine_gray(df, "time", "cause", TERMS)
    rows = Y.fine_gray_rows(df, "time", "cause")
    long = Y.cox(rows, "fgstop", "fgstatus", TERMS, weight="fgwt", entry="fgstart")
    assert np.allclose(short.beta, long.beta, atol=1e-7)
    assert np.allclose(short.naive, long.naive, rtol=1e-6)
    g = dense.censoring_left(people["time"].to_numpy(), people["cause"].to_numpy())
    expanded = rows.toPandas()
    assert expanded.groupby("id")["fgstart"].min().eq(0).all()
    late = expanded[expanded["fgstart"] > 0]
    after = {t: g[min(u for u in g if u > t)] for t in late["fgstart"].unique()}
    own = people.set_index("id").loc[late["id"], "time"].to_numpy()
    want = np.array([after[s] / g[t] for s, t in zip(late["fgstart"], own)])
    assert np.allclose(late["fgwt"], want)
    # every interval of a subject starts where the one before it stops
    ordered = expanded.sort_values(["id", "fgstart"])
    previous = ordered.groupby("id")["fgstop"].shift()
    assert (ordered["fgstart"][previous.notna()] == previous.dropna()).all()


def test_fine_gray_clustered_variance(spark, people):
    """Sandwich per subject from the expanded rows."""
    df = spark.createDataFrame(people)
    fit = Y.fine_gray(df, "time", "cause", TERMS)
    rows = Y.fine_gray_rows(df, "time", "cause").toPandas()
    w = rows["fgwt"].to_numpy()
    _, _, info, resid, _ = dense.cox_terms(fit.beta, design(rows), rows["fgstop"].to_numpy(),
                                           rows["fgstatus"].to_numpy(), w, start=rows["fgstart"].to_numpy())
    per_subject = pd.DataFrame(resid * w[:, None]).groupby(rows["id"].to_numpy()).sum().to_numpy()
    inv = np.linalg.inv(info)
    assert np.allclose(fit.robust, inv @ per_subject.T @ per_subject @ inv, rtol=1e-6)


def test_clogit_pairs_have_a_closed_form(spark):
    rows = [(i, 1, 1) for i in range(12)] + [(i, 0, 0) for i in range(12)]
    rows += [(100 + i, 1, 0) for i in range(5)] + [(100 + i, 0, 1) for i in range(5)]
    rows += [(200 + i, t, 1) for i in range(4) for t in (0, 1)]
    df = spark.createDataFrame(rows, "match int, tb int, x int")
    fit = Y.clogit(df, "tb", {"x": "x"})
    assert fit.beta[0] == pytest.approx(np.log(12 / 5), abs=1e-7)
    assert fit.naive[0, 0] == pytest.approx(1 / 12 + 1 / 5, rel=1e-6)


def test_clogit_many_controls(spark):
    rng = np.random.default_rng(3)
    n = 60 * 6
    pdf = pd.DataFrame({"match": np.arange(n) // 6, "tb": (np.arange(n) % 6 == 0).astype(int),
                        **{f"x{i}": rng.normal(size=n) + 0.3 * (np.arange(n) % 6 == 0) for i in range(10)}})
    x = pdf[[f"x{i}" for i in range(10)]].to_numpy()
    beta, naive, _, _ = dense.newton(x, np.ones(n), pdf["tb"].to_numpy(), strata=pdf["match"].to_numpy())
    fit = Y.clogit(spark.createDataFrame(pdf), "tb", {f"x{i}": f"x{i}" for i in range(10)})
    assert np.allclose(fit.beta, beta, atol=1e-7)
    assert np.allclose(fit.naive, naive, rtol=1e-6)


def _exchanges(df):
    """Shuffles of a plan outside of what is cached."""
    lines, hidden, found = df._jdf.queryExecution().executedPlan().toString().split("\n"), None, []
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if hidden is not None and depth > hidden:
            continue
        hidden = depth if "InMemoryRelation" in line else None
        if "Exchange" in line:
            found.append(line.strip())
    return found


def test_sets_stay_where_they_are(spark, monkeypatch):
    """With more sets than may be broadcast, an iteration of a matched fit moves no rows, and the estimates are the same."""
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame(rng.normal(size=(2000, 10)), columns=[f"x{i}" for i in range(10)]).assign(match=np.arange(2000) // 5, tb=(np.arange(2000) % 5 == 0).astype(int))
    df, terms = spark.createDataFrame(pdf), {f"x{i}": f"x{i}" for i in range(10)}
    want = Y.clogit(df, "tb", terms)
    calls = []
    real = Y.sum_vectors_of
    monkeypatch.setattr(Y, "sum_vectors_of", lambda *a: calls.append(len(a)) or real(*a))
    assert np.allclose(Y.clogit(df, "tb", terms).beta, want.beta)
    assert set(calls) == {2} and len(calls) <= 8  # both sums of a step are one job
    monkeypatch.setattr(Y, "MAX_DAY_ROWS", 10)
    model = Y.RiskModel(df.withColumn("_t", F.lit(1)), "_t", "tb", terms, strata="match", matched=True)
    day = model.day_table(np.zeros(10))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for it
    joined = model._with_hazard(np.zeros(10), day, ["h"])
    assert _exchanges(day) == [] and _exchanges(joined) == []
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 2000
    got = model.fit()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert np.allclose(got.beta, want.beta, atol=1e-9)


def test_whole_days_only(spark, people):
    with pytest.raises(ValueError):
        Y.cox(spark.createDataFrame(people), "age", "status", TERMS)


def test_propensity_scores_match_separate_fits(spark, people):
    df = spark.createDataFrame(people).withColumn("flat", F.lit(1))
    terms = {c: c for c in ("age", "band", "w", "flat")}
    got = propensity_scores(df, "arm", ["None", "A", "B"], terms).toPandas().sort_values("id")
    x = people[["age", "band", "w"]].to_numpy(float)
    fits = {arm: dense.logistic(x, (people["arm"] == arm).to_numpy(float)) for arm in ("None", "A", "B")}
    for arm, fitted in fits.items():
        assert np.allclose(got[f"ps_{arm}"], fitted / sum(fits.values()), atol=1e-6)
    assert np.allclose(got[[f"ps_{a}" for a in fits]].sum(axis=1), 1)


def test_propensity_fits_share_passes(spark, people, monkeypatch):
    """Three arms, a repeated term and a term that parts one arm off: as many passes as one fit takes, and no error."""
    from cohortline.operators import propensity

    calls = []
    real = propensity.sum_vectors
    monkeypatch.setattr(propensity, "sum_vectors", lambda *a: calls.append(1) or real(*a))
    df = spark.createDataFrame(people)
    propensity_scores(df, "arm", ["None", "A", "B"], {"age": "age", "again": "2 * age", "band": "band"})
    assert 3 <= len(calls) <= 12
    parted = propensity_scores(df, "arm", ["None", "A", "B"], {"own": "CAST(arm = 'A' AS double)"}).withColumn("weight", att_weight("arm", ["None", "A", "B"], "None"))
    rows = parted.toPandas()
    assert (rows.loc[rows["arm"] == "None", "weight"] == 1).all() and (rows.loc[rows["arm"] == "A", "ps_A"] > 0.999).all()


def test_weight_without_a_score(spark):
    df = spark.createDataFrame([("None", 0.4, 0.0), ("A", 0.4, 0.0), ("A", 0.4, 0.8)], "arm string, ps_None double, ps_A double")
    assert [r[0] for r in df.select(att_weight("arm", ["None", "A"], "None")).collect()] == [1.0, None, 0.5]


def test_att_weights_and_trimming(spark, people):
    rng = np.random.default_rng(5)
    pdf = people.assign(ps_None=rng.uniform(0.1, 0.9, 400), ps_A=rng.uniform(0.1, 0.9, 400), ps_B=rng.uniform(0.1, 0.9, 400))
    df = spark.createDataFrame(pdf).withColumn("w", att_weight("arm", ["None", "A", "B"], "None"))
    low, high = trim_limits(df, "w", "arm", "None")
    own = pdf["ps_None"] / np.where(pdf["arm"] == "A", pdf["ps_A"], pdf["ps_B"])
    others = np.sort(own[pdf["arm"] != "None"])
    assert low == others[nearest_even_rank(len(others), 0.01) - 1]
    assert high == others[nearest_even_rank(len(others), 0.99) - 1]
    out = trim_weights(df, "w", "arm", "None").toPandas()
    assert (out.loc[out["arm"] == "None", "w"] == 1).all()
    assert out.loc[out["arm"] != "None", "w"].between(low, high).all()


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.lognormal(0, 4, 3000), np.zeros(1000), np.full(500, 2.5)])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    ranks = [1, 45, 1000, 1001, 2250, 4455, 4500]
    assert order_statistics(df, "v", ranks) == [np.sort(values)[r - 1] for r in ranks]


@pytest.mark.parametrize("n,p,rank", [(100, 0.01, 1), (250, 0.01, 2), (350, 0.01, 4), (7, 0.5, 4), (10, 0.99, 10)])
def test_nearest_even_rank(n, p, rank):
    # n p - 1/2 = 0.5, 2 (even: stays), 3 (odd: next), 3, 9.4
    assert nearest_even_rank(n, p) == rank


def test_tail_probabilities():
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert chi2_upper(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_upper(5.991464547107979, 2) == pytest.approx(0.05)
    assert chi2_upper(7.814727903251179, 3) == pytest.approx(0.05)
    assert chi2_upper(9.487729036781154, 4) == pytest.approx(0.05)


def small_frame(spark, n=600):
    make = np.random.default_rng(8)
    rows = [(int(make.integers(1, 40)), int(make.random() < 0.4), float(make.normal()), int(make.integers(0, 2)), 0) for _ in range(n)]
    return spark.createDataFrame(rows, "time int, status int, x double, z int, none int")


def test_aliased_terms_have_no_estimate(spark):
    df = small_frame(spark)
    plain = Y.cox(df, "time", "status", {"x": "x", "z": "z"})
    fit = Y.cox(df, "time", "status", {"x": "x", "c": "none", "z": "z", "copy": "2 * x - 3"})
    assert fit.converged and fit.estimated.tolist() == [True, False, True, False]
    assert np.allclose(fit.beta[[0, 2]], plain.beta, atol=1e-8) and np.isnan(fit.beta[[1, 3]]).all()
    table = {r["term"]: r for r in coef_table(spark, fit).collect()}
    assert table["c"]["estimate"] is None and table["c"]["lower"] is None and abs(table["z"]["estimate"] - plain.beta[1]) < 1e-8
    assert {r[0]: r[2] for r in Y.cox_zph(fit)} == {"x": 1, "c": 0, "z": 1, "copy": 0, "GLOBAL": 2}


def test_fit_without_events(spark):
    df = small_frame(spark).withColumn("status", F.lit(0))
    for fit in (Y.cox(df, "time", "status", {"x": "x"}), Y.cox(df.limit(0), "time", "status", {"x": "x"})):
        row = coef_table(spark, fit).first()
        assert row["estimate"] is None and row["events"] == 0 and not row["converged"]
        assert Y.cox_zph(fit) == [("x", None, 0, None), ("GLOBAL", None, 0, None)]


def test_separation_is_marked(spark):
    df = small_frame(spark).withColumn("z", F.col("status"))
    with pytest.warns(UserWarning, match="not settled"):
        fit = Y.cox(df, "time", "status", {"z": "z"})
    assert not fit.converged


@pytest.mark.parametrize("second_order", [True, False])
def test_ties_dealt_out_give_the_same(spark, monkeypatch, second_order):
    if not second_order:
        monkeypatch.setattr(Y, "MAX_SECOND_ORDER", 0)
    df = small_frame(spark).withColumn("time", F.ceil(F.col("time") / 20).cast("int"))
    monkeypatch.setattr(Y, "TIE_CHUNK", 7)
    fits = []
    for limit in (Y.MAX_TIED_EVENTS, 0):
        monkeypatch.setattr(Y, "MAX_TIED_EVENTS", limit)
        fits.append(Y.cox(df, "time", "status", {"x": "x", "z": "z"}))
    assert np.allclose(fits[0].beta, fits[1].beta, atol=1e-9) and np.allclose(fits[0].naive, fits[1].naive, atol=1e-9)


def test_one_day_with_a_million_events_is_spread(spark):
    df = spark.range(1_000_000).select(F.lit(5).alias("time"), F.lit(1).alias("status"), (F.col("id") % 2).alias("z"))
    model = Y.RiskModel(df, "time", "status", {"z": "z"})
    day = model.day_table(np.zeros(1))
    chunks = model._ties_apart(day.drop("a1", "a2", "b11", "b12", "b22", "ll"))
    assert chunks.count() == 1
    ranks = spark.range(1).selectExpr("explode(sequence(0L, 999999L, 4096L)) AS lo").repartition(8, "lo")
    assert ranks.select(F.spark_partition_id()).distinct().count() > 1
    want = sum(1 / (1e6 - l) for l in range(1_000_000))
    assert abs(chunks.first()["a1"] - want) < 1e-9 * want
    model.close()


def test_many_matched_sets_keep_their_ties(spark, monkeypatch):
    """a set holds few tied events, so however many sets there are no iteration deals them out."""
    df = spark.range(900).selectExpr("id % 90 AS s", "1 AS t", "CAST(id < 90 OR id % 7 = 0 AS int) AS ev", "id * 37 % 11 % 3 AS x")
    fits, shuffles = [], []
    for limit in (Y.MAX_TIED_EVENTS, 0):
        monkeypatch.setattr(Y, "MAX_TIED_EVENTS", limit)
        model = Y.RiskModel(df, "t", "ev", {"x": "x"}, strata="s", matched=True)
        shuffles.append(model.day_table(np.zeros(1))._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        fits.append(model.fit())
        model.close()
    assert shuffles[0] == shuffles[1]
    assert np.allclose(fits[0].beta, fits[1].beta, atol=1e-9) and np.allclose(fits[0].naive, fits[1].naive, atol=1e-9)
