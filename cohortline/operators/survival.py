"""Proportional-hazards models from sums per day of follow-up.

Follow-up time is a whole number of days, so a table with one row per (stratum, day) is small for
a pooled model, whatever the number of patients, and one row per set for a matched model. Every
evaluation of the partial likelihood is one map-side-combined aggregate into that table, followed
by running sums along the days of each stratum. The driver only sees the k-vector and the k x k
matrix of the Newton step.

Ties use Efron's approximation; weights are case weights with a sandwich variance.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortline.functions.linear import gram_part, independent, pairs, sum_vectors_of, symmetric, weighted_gram
from cohortline.functions.sizing import broadcast_if_small, cut_lineage, marked
from cohortline.functions.tails import chi2_upper, normal_two_sided

MAX_DAY_ROWS = 200_000
MAX_SET_ROWS = 10_000
MAX_CURVE_DAYS = 2_000      # each day carries the later change points
MAX_SECOND_ORDER = 8      # up to here the second-order sums are part of the day table
TIE_CHUNK = 4096
MAX_TIED_EVENTS = 100_000    # with more events, tied ranks are visited in rows of their own

# log hazard of one standard deviation beyond which an estimate counts as infinite
INFINITE = 9.0

# running sums along the days of a stratum
AT_OR_AFTER = "OVER (PARTITION BY s ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
UP_TO = "OVER (PARTITION BY s ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BEFORE = "OVER (PARTITION BY s ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
WHOLE = "OVER (PARTITION BY s)"

# Efron sums over the ranks l = 0..d-1 of a day's tied events, visited in chunks. With
# D = s0 - (l/d) e0: a1 = sum 1/D, a2 = sum (l/d)/D; b11, b12, b22 the same over D squared with
# (l/d) to the power 0, 1, 2; ll = sum log D.
TIE_ZERO = "named_struct('a1', 0D, 'a2', 0D, 'b11', 0D, 'b12', 0D, 'b22', 0D, 'll', 0D)"
_RANK = """named_struct(
  'a1', z.a1 + 1 / (s0 - l / d * e0), 'a2', z.a2 + l / d / (s0 - l / d * e0),
  'b11', z.b11 + 1 / pow(s0 - l / d * e0, 2), 'b12', z.b12 + l / d / pow(s0 - l / d * e0, 2),
  'b22', z.b22 + pow(l / d / (s0 - l / d * e0), 2), 'll', z.ll + ln(s0 - l / d * e0))"""
TIE_SUMS = (f"aggregate(sequence(0L, d - 1, {TIE_CHUNK}L), {TIE_ZERO}, (y, lo) -> "
            f"aggregate(sequence(lo, least(lo + {TIE_CHUNK - 1}, d - 1)), y, (z, l) -> {_RANK}))")
WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def _number(value: float) -> str:
    """SQL text of a double."""
    return f"({float(value)!r}D)"


def dummies(column: str, levels: Sequence[str]) -> dict[str, str]:
    """0/1 terms, as SQL expressions, for every level but the first, the reference."""
    return {f"{column}_{lvl}": f"CAST({column} = '{lvl}' AS double)" for lvl in levels[1:]}


@dataclass
class CoxFit:
    """Estimates of a fit. ``model`` keeps the cached rows for diagnostics until ``close``."""

    terms: list[str]
    beta: np.ndarray
    naive: np.ndarray
    robust: np.ndarray | None
    loglik: float
    n: int
    events: int
    iterations: int
    converged: bool
    estimated: np.ndarray       # terms that vary apart from the earlier ones; the others have no estimate
    model: RiskModel = field(repr=False)

    @property
    def variance(self) -> np.ndarray:
        return self.naive if self.robust is None else self.robust

    def close(self) -> CoxFit:
        self.model.close()
        return self


class RiskModel:
    """Rows of a survival model and their per-day sums at a coefficient vector.

    ``terms`` maps the name of each coefficient to the SQL expression of its covariate.
    """

    def __init__(self, df: DataFrame, time: str, status: str, terms: Mapping[str, str], weight: str | None = None,
                 strata: str | None = None, entry: str | None = None, competing: bool = False,
                 matched: bool = False):
        kinds = dict(df.dtypes)
        for c in filter(None, (time, entry)):
            if kinds[c] not in WHOLE_NUMBERS:
                raise ValueError(f"{c} must hold whole days")
        if competing and (entry or weight):
            raise ValueError("competing risks take neither entry times nor weights")
        self.terms = list(terms)
        self.k = len(self.terms)
        self.x = [f"x{i}" for i in range(self.k)]
        self.has_entry = entry is not None
        self.competing = competing
        self.second_order = self.k <= MAX_SECOND_ORDER
        self._cached: list[DataFrame] = []
        self.split_ties = MAX_TIED_EVENTS

        w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        stratum = F.lit(0) if strata is None else F.col(strata)
        rows = df.select(
            stratum.alias("s"), F.col(time).cast("int").alias("t"),
            *([F.col(entry).cast("int").alias("t0")] if entry else []),
            F.col(status).cast("int").alias("ev"), w.alias("w"),
            *[F.expr(terms[n]).cast("double").alias(c) for n, c in zip(self.terms, self.x)],
        ).dropna()
        self.matched = matched
        if not matched:
            # rows that agree in everything but the weight act as one
            keys = [c for c in rows.columns if c != "w"]
            rows = rows.groupBy(*keys).agg(
                F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"))
            rows = cut_lineage(rows)
        else:
            rows = cut_lineage(rows.withColumns({"n": F.lit(1).cast("long"), "w2": F.col("w") * F.col("w")}))
            largest = rows.groupBy("s").count().agg(F.max("count")).first()[0] or 0
            if largest <= MAX_SET_ROWS:
                # small sets stay in one place through all iterations, since everything is summed and joined by set; a
                # large one is summed from everywhere. The number is fixed, so that both sides of a join have the same.
                rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s")
                # a set's tied ranks are few and stay with it, however many events there are in all
                self.split_ties = None
        facts = rows.agg(
            F.sum("n"), F.sum(F.when(F.col("ev") == 1, F.col("n"))), F.sum("w"),
            *[F.sum(F.col("w") * F.col(c)) for c in self.x]).first()
        self.n, self.events = int(facts[0] or 0), int(facts[1] or 0)
        self.means = np.array([v / facts[2] if facts[2] else 0.0 for v in facts[3:]])
        # terms are centred once, for the numbers' sake and to keep the later plans narrow
        kept = [c for c in rows.columns if c not in self.x]
        self.rows = self._keep(rows.selectExpr(
            *kept, *[f"{c} - {_number(m)} AS {c}" for c, m in zip(self.x, self.means)]).persist())
        #: Rows of a day table; they are the same at every coefficient vector.
        self.days = self.rows.agg(F.count_distinct("s", "t")).first()[0] + (self.rows.agg(F.count_distinct("s", "t0")).first()[0] if entry else 0)
        self.censoring = self._censoring_km() if competing else None

    # -- helpers ------------------------------------------------------------------

    def close(self) -> None:
        for df in self._cached:
            df.unpersist()

    def _keep(self, df: DataFrame) -> DataFrame:
        self._cached.append(df)
        return df

    def _scored(self, beta: np.ndarray) -> DataFrame:
        """Rows with their linear predictor and weighted relative hazard."""
        eta = " + ".join(f"{_number(b)} * {c}" for b, c in zip(beta, self.x))
        return self.rows.selectExpr("*", f"{eta} AS eta").selectExpr("*", "w * exp(eta) AS r")

    def _censoring_km(self) -> DataFrame:
        """Left-continuous Kaplan-Meier of censoring per (stratum, day); events precede censoring."""
        per_day = self.rows.groupBy("s", "t").agg(
            F.sum("n").alias("n"), F.sum(F.when(F.col("ev") == 0, F.col("n")).otherwise(0)).alias("c"))
        return self._keep(censoring_curve(per_day).select("s", "t", "g").persist())

    # -- per-day table ----------------------------------------------------------------

    def day_table(self, beta: np.ndarray, second_order: bool | None = None) -> DataFrame:
        """One row per (stratum, day): risk-set sums S, sums E over the day's events, tie sums.

        Columns: s0, s1_i (s2_i_j) at risk; e0, e1_i (e2_i_j) events; d events, wbar their mean
        weight, ex_i weighted event terms; a1, a2, b11, b12, b22 and ll the sums over tied ranks.
        """
        second = self.second_order if second_order is None else second_order
        k = self.k
        moments = {"0": "1"} | {f"1_{i}": f"x{i}" for i in range(k)}
        if second:
            moments |= {f"2_{i}_{j}": f"x{i} * x{j}" for i, j in pairs(k)}
        scored = self._scored(beta)
        event, sign = "if(ev = 1, 1D, 0D)", "1"
        if self.has_entry:
            # a row counts at risk on days in (t0, t]: its sums are taken off again from t0 backwards
            scored = scored.selectExpr(
                "* EXCEPT (t, t0)", "inline(array(struct(t AS t, 1D AS sign), struct(t0 AS t, -1D AS sign)))")
            event, sign = "if(ev = 1 AND sign > 0, 1D, 0D)", "sign"
        sums = [f"sum({sign} * r * {m}) AS p{n}" for n, m in moments.items()]
        sums += [f"sum({event} * r * {m}) AS e{n}" for n, m in moments.items()]
        if self.competing:
            sums += [f"sum(if(ev = 2, r * {m}, 0D)) AS c{n}" for n, m in moments.items()]
        sums += [f"sum({event} * w * x{i}) AS ex_{i}" for i in range(k)]
        sums += [f"sum({event} * w) AS ew", f"sum({event} * w * eta) AS eeta",
                 f"CAST(sum({event} * n) AS bigint) AS d", f"CAST(sum({sign} * n) AS bigint) AS n_exit"]
        day = scored.groupBy("s", "t").agg(*[F.expr(e) for e in sums])

        at_risk = {n: f"sum(p{n}) {AT_OR_AFTER}" for n in moments}
        own = ["s", "t", *[f"e{n}" for n in moments], *[f"ex_{i}" for i in range(k)], "ew", "eeta", "d", "n_exit"]
        if self.competing:
            day = day.join(self.censoring, ["s", "t"])
            own.append("g")
            at_risk = {n: f"{e} + g * coalesce(sum(c{n} / g) {BEFORE}, 0D)" for n, e in at_risk.items()}
        day = day.selectExpr(*own, *[f"{e} AS s{n}" for n, e in at_risk.items()],
                             f"sum(n_exit) {AT_OR_AFTER} AS n_risk", "if(d > 0, ew / d, 0D) AS wbar")
        if self.split_ties is None or self.events <= self.split_ties:
            day = day.selectExpr("*", f"if(d > 0, {TIE_SUMS}, {TIE_ZERO}) AS tie")
            return day.selectExpr("* EXCEPT (tie)", "tie.*")
        return self._ties_apart(day)

    @staticmethod
    def _ties_apart(day: DataFrame) -> DataFrame:
        """Tie sums from rows of ``TIE_CHUNK`` ranks, dealt out over all tasks and summed by day."""
        names = ["a1", "a2", "b11", "b12", "b22", "ll"]
        tasks = day.sparkSession.sparkContext.defaultParallelism
        chunks = day.where("d > 0").selectExpr("s", "t", "s0", "e0", "d", f"explode(sequence(0L, d - 1, {TIE_CHUNK}L)) AS lo")
        chunks = chunks.repartition(tasks, "s", "t", "lo")
        ranks = f"aggregate(sequence(lo, least(lo + {TIE_CHUNK - 1}, d - 1)), {TIE_ZERO}, (z, l) -> {_RANK})"
        sums = chunks.selectExpr("s", "t", f"{ranks} AS tie").groupBy("s", "t").agg(*[F.sum(f"tie.{n}").alias(n) for n in names])
        return day.join(sums, ["s", "t"], "left").fillna(0.0, names)

    # -- partial likelihood ----------------------------------------------------------

    def _mean_term(self, i: int) -> str:
        """Sum over tied ranks of the risk-set mean of term i."""
        return f"(a1 * s1_{i} - a2 * e1_{i})"

    def _mean_product(self, i: int, j: int) -> str:
        """Sum over tied ranks of the product of the risk-set means of terms i and j."""
        return (f"(b11 * s1_{i} * s1_{j} - b12 * (s1_{i} * e1_{j} + e1_{i} * s1_{j})"
                f" + b22 * e1_{i} * e1_{j})")

    def _second_moment(self, i: int, j: int) -> str:
        return f"(a1 * s2_{i}_{j} - a2 * e2_{i}_{j})"

    def evaluate(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log partial likelihood, score and information at ``beta``."""
        k = self.k
        day = self.day_table(beta)
        if self.second_order:
            value = ["sum(eeta - wbar * ll)"]
            value += [f"sum(ex_{i} - wbar * {self._mean_term(i)})" for i in range(k)]
            value += [f"sum(wbar * ({self._second_moment(i, j)} - {self._mean_product(i, j)}))" for i, j in pairs(k)]
            row = [v or 0.0 for v in day.selectExpr(*value).first()]
            return row[0], np.array(row[1:k + 1]), symmetric(row[k + 1:], k)
        # sets lie in one place, so their day table costs no shuffle and need not be kept
        return self._evaluate_wide(beta, day if self.matched else day.persist())

    def _evaluate_wide(self, beta: np.ndarray, day: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
        """The same for many terms: the second moments come from one pass over the rows, each
        weighted by the hazard it was exposed to, instead of k(k+1)/2 sums per day."""
        k = self.k
        s1, e1, ex = ([f"{p}_{i}" for i in range(k)] for p in ("s1", "e1", "ex"))

        def batch_vector(b):
            a1, a2, b11, b12, b22, wbar = (b[c].to_numpy()[:, None] for c in ("a1", "a2", "b11", "b12", "b22", "wbar"))
            s, e = b[s1].to_numpy(), b[e1].to_numpy()
            score = (b[ex].to_numpy() - wbar * (a1 * s - a2 * e)).sum(axis=0)
            cross = s.T @ (wbar * b12 * e)
            spread = s.T @ (wbar * b11 * s) - cross - cross.T + e.T @ (wbar * b22 * e)
            loglik = (b["eeta"] - b["wbar"] * b["ll"]).sum()
            return np.concatenate([[loglik], score, spread.ravel()])

        # the day table's sums and the pass over the rows are one job
        exposed = self._with_hazard(beta, day, ["h"])
        sums, gram = sum_vectors_of((day.where("d > 0"), 1 + k + k * k, batch_vector), gram_part(exposed, "r * exposure_h", self.x))
        info = gram.reshape(k, k) - sums[k + 1:].reshape(k, k)
        day.unpersist()
        return float(sums[0]), sums[1:k + 1], info

    def _with_hazard(self, beta: np.ndarray, day: DataFrame, names: Sequence[str]) -> DataFrame:
        """Scored rows with the hazard each one was exposed to (``exposure_*``).

        ``h`` is the plain hazard; ``m_i`` the hazard times the risk-set mean of term i. On its own
        event day a row carries only its tied share. A subject with the competing event stays
        exposed, with a weight, on the days after it.
        """
        # everybody of a matched set is followed for the same time, so its set alone finds a row's hazard
        by = ["s"] if self.matched else ["s", "t"]
        columns = list(by)
        for n in names:
            i = n[2:]
            step = "wbar * a1" if n == "h" else f"wbar * (b11 * s1_{i} - b12 * e1_{i})"
            tie = "wbar * a2" if n == "h" else f"wbar * (b12 * s1_{i} - b22 * e1_{i})"
            columns += [f"sum({step}) {UP_TO} AS cum_{n}", f"{tie} AS tie_{n}"]
            if self.competing:
                columns.append(f"(sum(g * {step}) {WHOLE} - sum(g * {step}) {UP_TO}) / g AS after_{n}")
        if len(names) > 1:
            columns += [f"if(d > 0, {self._mean_term(i)} / d, 0D) AS xbar_{i}" for i in range(self.k)]
        hazard, fits = day.selectExpr(*columns), self.days <= MAX_DAY_ROWS
        joined = self._scored(beta).join(marked(hazard, fits), by)
        exposure = {n: f"cum_{n} - if(ev = 1, tie_{n}, 0D)" for n in names}
        if self.competing:
            exposure = {n: f"{e} + if(ev = 2, after_{n}, 0D)" for n, e in exposure.items()}
        if self.has_entry:
            start = hazard.selectExpr("s", "t AS t0", *[f"cum_{n} AS pre_{n}" for n in names])
            joined = joined.join(marked(start, fits), ["s", "t0"])
            exposure = {n: f"{e} - pre_{n}" for n, e in exposure.items()}
        return joined.selectExpr("*", *[f"{e} AS exposure_{n}" for n, e in exposure.items()])

    def fit(self, max_iter: int = 20, eps: float = 1e-9, robust: bool = False) -> CoxFit:
        """Newton-Raphson with step halving from zero.

        Terms without variation of their own at zero are left out and have no estimate. Without events nothing has. A fit
        that has not settled, or whose information vanishes on the way, is marked and warned of.
        """
        k = self.k
        if not self.events:
            none = np.full((k, k), np.nan)
            return CoxFit(self.terms, np.full(k, np.nan), none, none if robust else None, np.nan, self.n, 0, 0, False,
                          np.zeros(k, bool), self)
        beta = np.zeros(k)
        loglik, score, info = self.evaluate(beta)
        kept = independent(info)
        own = np.ix_(kept, kept)
        converged, iteration = not kept.any(), 0
        while not converged and iteration < max_iter:
            iteration += 1
            try:
                step = np.zeros(k)
                step[kept] = np.linalg.solve(info[own], score[kept])
            except np.linalg.LinAlgError:
                break
            for _ in range(20):
                new = self.evaluate(beta + step)
                if new[0] >= loglik - eps * max(1.0, abs(loglik)):
                    break
                step = step / 2
            else:
                break
            change = abs(new[0] - loglik)
            beta, (loglik, score, info) = beta + step, new
            converged = change <= eps * max(1.0, abs(loglik))
        far = kept & (np.abs(beta) * self._spreads() > INFINITE)
        if far.any():
            converged = False
        if not converged:
            names = [t for t, x in zip(self.terms, far) if x]
            warnings.warn(f"the fit has not settled{': no finite estimate for ' + ', '.join(names) if names else ''}", stacklevel=2)
        naive = np.full((k, k), np.nan)
        if kept.any():
            naive[own] = np.linalg.pinv(info[own], hermitian=True)
        sandwich = None
        if robust:
            sandwich = np.full((k, k), np.nan)
            if kept.any():
                sandwich[own] = naive[own] @ self._meat(beta)[own] @ naive[own]
        beta = np.where(kept, beta, np.nan)
        return CoxFit(self.terms, beta, naive, sandwich, loglik, self.n, self.events, iteration, converged, kept, self)

    def _spreads(self) -> np.ndarray:
        """Standard deviation of each term."""
        row = self.rows.agg(F.sum("w"), *[F.sum(F.col("w") * F.col(c) * F.col(c)) for c in self.x]).first()
        return np.sqrt(np.array([v / row[0] for v in row[1:]]))

    def _meat(self, beta: np.ndarray) -> np.ndarray:
        """Sum of squared weighted score residuals."""
        day = self.day_table(beta, second_order=False)
        joined = self._with_hazard(beta, day, ["h", *[f"m_{i}" for i in range(self.k)]])
        residuals = [
            f"if(ev = 1, x{i} - xbar_{i}, 0D) - exp(eta) * (x{i} * exposure_h - exposure_m_{i})"
            for i in range(self.k)]
        return weighted_gram(joined, "w2", residuals)


def cox(df: DataFrame, time: str, status: str, terms: Mapping[str, str], weight: str | None = None,
        strata: str | None = None, entry: str | None = None) -> CoxFit:
    """Weighted proportional hazards; a sandwich variance goes with weights."""
    model = RiskModel(df, time, status, terms, weight=weight, strata=strata, entry=entry)
    return model.fit(robust=weight is not None)


def clogit(df: DataFrame, case: str, terms: Mapping[str, str], sets: str = "match") -> CoxFit:
    """Conditional logistic regression for sets with one case each.

    With one case per set the conditional likelihood is the partial likelihood of a model
    stratified by set in which everybody is followed for the same time.
    """
    model = RiskModel(df.withColumn("_t", F.lit(1)), "_t", case, terms, strata=sets, matched=True)
    return model.fit()


def fine_gray(df: DataFrame, time: str, status: str, terms: Mapping[str, str]) -> CoxFit:
    """Subdistribution hazard of status 1 with competing status 2, without expanding rows.

    A subject with the competing event stays at risk with the weight G(t-)/G(T-) of the censoring
    curve; that is one more running sum per day. The sandwich variance is per subject.
    """
    return RiskModel(df, time, status, terms, competing=True).fit(robust=True)


# --- tables -------------------------------------------------------------------------

def censoring_curve(per_day: DataFrame) -> DataFrame:
    """Add ``g`` = G(t-) and ``g_after`` = G(t) per (s, t) from counts ``n`` leaving and ``c`` censored.

    Events and deaths of a day precede its censorings.
    """
    later = Window.partitionBy("s").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy("s").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    at_risk = F.sum("n").over(later) - (F.col("n") - F.col("c"))
    stay = F.when(F.col("c") == 0, 0.0).when(F.col("c") < F.col("at_risk"), F.log(1 - F.col("c") / F.col("at_risk")))
    curve = per_day.withColumn("at_risk", at_risk).withColumn("_log", stay)
    gone = F.max(F.col("_log").isNull().cast("int")).over(upto)
    after = F.when(gone == 1, 0.0).otherwise(F.exp(F.sum("_log").over(upto)))
    curve = curve.withColumn("g_after", after)
    before = F.lag("g_after", 1, 1.0).over(Window.partitionBy("s").orderBy("t"))
    return curve.withColumn("g", before).drop("_log")


def risk_set_table(df: DataFrame, time: str = "time", status: str = "status", weight: str | None = None,
                   strata: str | None = None) -> DataFrame:
    """Per (stratum, event day): at risk and events, plain and weighted, hazard and survival."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    s = F.lit("all") if strata is None else F.col(strata)
    event = F.col(status) == 1
    per_day = df.where(s.isNotNull()).groupBy(s.alias("stratum"), F.col(time).alias("time")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"),
        F.count_if(event).alias("n_event"), F.coalesce(F.sum(F.when(event, w)), F.lit(0.0)).alias("w_event"))
    later = Window.partitionBy("stratum").orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    table = per_day.withColumns({"n_risk": F.sum("n").over(later), "w_risk": F.sum("w").over(later)})
    table = table.where("n_event > 0").withColumn("hazard", F.col("w_event") / F.col("w_risk"))
    upto = Window.partitionBy("stratum").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumn("_stay", F.when(F.col("n_event") < F.col("n_risk"),
                                             F.log(1 - F.col("n_event") / F.col("n_risk"))))
    gone = F.max(F.col("_stay").isNull().cast("int")).over(upto)
    return table.withColumns({
        "cum_hazard": F.sum("hazard").over(upto),
        "survival": F.when(gone == 1, 0.0).otherwise(F.exp(F.sum("_stay").over(upto))),
    }).select("stratum", "time", "n_risk", "n_event", "w_risk", "w_event", "hazard", "cum_hazard", "survival")


def fine_gray_rows(df: DataFrame, time: str = "etime", status: str = "estatus", strata: str | None = None) -> DataFrame:
    """Start/stop rows of the subdistribution model with their censoring weights.

    A subject with the competing event (2) goes on to the last day with an event of interest and
    is cut wherever the censoring curve drops; everybody else keeps one row and meets no join. The
    curve has one entry per day of follow-up.
    """
    s = F.lit(0) if strata is None else F.col(strata)
    base = df.withColumns({"s": s, "t": F.col(time)})
    per_day = base.groupBy("s", "t").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(status) == 0).alias("c"),
        F.count_if(F.col(status) == 1).alias("d"))
    curve = censoring_curve(per_day)
    last = F.max(F.when(F.col("d") > 0, F.col("t"))).over(Window.partitionBy("s"))
    curve = curve.withColumn("last_event", last)
    # per day: where the curve drops from that day on, up to the last event of interest
    drop = F.when((F.col("c") > 0) & (F.col("t") < F.col("last_event")), F.struct("t", "g_after"))
    onward = Window.partitionBy("s").orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    curve = curve.select("s", "t", "g", "last_event", F.collect_list(drop).over(onward).alias("drops"))
    curve = broadcast_if_small(curve, MAX_CURVE_DAYS)

    whole = [F.lit(0).alias("fgstart"), F.col("t").cast("int").alias("fgstop"),
             (F.col(status) == 1).cast("int").alias("fgstatus"), F.lit(1.0).alias("fgwt")]
    single = base.where(F.col(status) != 2).select(*df.columns, *whole)
    stop = F.greatest(F.col("t"), F.col("last_event"))
    starts = F.concat(F.array(F.struct(F.lit(0).alias("t"), F.col("g").alias("g_after"))), F.col("drops"))
    pieces = F.transform(starts, lambda p, i: F.struct(
        p["t"].cast("int").alias("fgstart"),
        F.coalesce(F.get("drops", i)["t"], stop).cast("int").alias("fgstop"),
        (p["g_after"] / F.col("g")).alias("fgwt")))
    competing = base.where(F.col(status) == 2).join(curve, ["s", "t"])
    cut = competing.withColumn("piece", F.explode(pieces)).select(
        *df.columns, "piece.fgstart", "piece.fgstop", F.lit(0).alias("fgstatus"), "piece.fgwt")
    return single.unionByName(cut)


# --- diagnostics ----------------------------------------------------------------------

def _event_times(fit: CoxFit) -> DataFrame:
    """Day table at the estimates with ``gt``, the centred 1 - KM(t-) transform of event days."""
    day = fit.model.day_table(np.nan_to_num(fit.beta), second_order=True).persist()
    fit.model._keep(day)
    later = Window.partitionBy("one").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    pooled = day.groupBy(F.lit(0).alias("one"), "t").agg(F.sum("n_exit").alias("n"), F.sum("d").alias("d"))
    pooled = pooled.withColumn("n_risk", F.sum("n").over(later)).where("d > 0")
    prior = Window.partitionBy("one").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    stay = F.when(F.col("d") < F.col("n_risk"), F.log(1 - F.col("d") / F.col("n_risk")))
    pooled = pooled.withColumn("g", 1 - F.exp(F.coalesce(F.sum(stay).over(prior), F.lit(0.0))))
    mean = pooled.agg(F.sum(F.col("g") * F.col("d")) / F.sum("d")).first()[0]
    small = broadcast_if_small(pooled.select("t", (F.col("g") - F.lit(mean)).alias("gt")), MAX_DAY_ROWS)
    return day.where("d > 0").join(small, "t")


def cox_zph(fit: CoxFit, groups: Mapping[str, Sequence[str]] | None = None) -> list[tuple[str, float, int, float]]:
    """Score test of proportional hazards per term and overall: (term, chi2, df, p).

    ``groups`` names several coefficients that are tested together, such as the levels of a factor.
    """
    model, k = fit.model, fit.model.k
    tests = dict(groups) if groups else {t: [t] for t in fit.terms}
    tests = {**tests, "GLOBAL": fit.terms}
    if not fit.estimated.any():
        return [(name, None, 0, None) for name in tests]
    events = _event_times(fit)
    cells = [f"sum(gt * (ex_{i} - wbar * {model._mean_term(i)}))" for i in range(k)]
    for p in ("1", "gt", "gt * gt"):
        cells += [f"sum({p} * wbar * ({model._second_moment(i, j)} - {model._mean_product(i, j)}))"
                  for i, j in pairs(k)]
    row = list(events.selectExpr(*cells).first())
    m = len(pairs(k))
    u = np.array(row[:k])
    i11, i12, i22 = (symmetric(row[k + b * m: k + (b + 1) * m], k) for b in range(3))
    left = i22 - i12 @ np.linalg.pinv(i11, hermitian=True) @ i12
    out = []
    for name, members in tests.items():
        j = [i for i in map(fit.terms.index, members) if fit.estimated[i]]
        chi2 = float(u[j] @ np.linalg.pinv(left[np.ix_(j, j)], hermitian=True) @ u[j]) if j else None
        out.append((name, chi2, len(j), chi2_upper(chi2, len(j)) if j else None))
    return out


def schoenfeld_residuals(fit: CoxFit) -> DataFrame:
    """Scaled Schoenfeld residuals: one row per event group, day and term.

    ``n`` is the number of events that share the row's covariates. The values are those behind a
    plot of the coefficient against time.
    """
    model, k = fit.model, fit.model.k
    events = _event_times(fit).selectExpr("s", "t", "gt", *[f"{model._mean_term(i)} / d AS xbar_{i}" for i in range(k)])
    small = broadcast_if_small(events, MAX_DAY_ROWS)
    rows = model._scored(np.nan_to_num(fit.beta)).where("ev = 1").join(small, ["s", "t"])
    raw = [F.col(c) - F.col(f"xbar_{i}") for i, c in enumerate(model.x)]
    scaled = []
    for i, term in enumerate(fit.terms):
        if not fit.estimated[i]:
            continue
        value = F.lit(float(fit.beta[i]))
        for j in np.flatnonzero(fit.estimated).tolist():
            value = value + F.lit(float(fit.events * fit.naive[j, i])) * raw[j]
        scaled.append(F.struct(F.lit(term).alias("term"), raw[i].alias("residual"), value.alias("scaled")))
    return rows.select(F.col("t").alias("time"), F.col("gt").alias("transformed"), "n",
                       F.inline(F.array(*scaled)))


def zph_table(spark: SparkSession, tests: Sequence[tuple[str, float, int, float]]) -> DataFrame:
    return spark.createDataFrame(list(tests), "term string, chisq double, df int, p double")


def coefficient_rows(fit: CoxFit) -> list[tuple]:
    """(term, estimate, error, robust error, statistic, p); without an estimate all are NULL."""
    out = []
    for i, term in enumerate(fit.terms):
        if not fit.estimated[i]:
            out.append((term, None, None, None, None, None))
            continue
        est, se = float(fit.beta[i]), float(np.sqrt(max(0.0, fit.variance[i, i])))
        naive = float(np.sqrt(max(0.0, fit.naive[i, i])))
        z = est / se if se > 0 else float("nan")
        out.append((term, est, naive, None if fit.robust is None else se, z, normal_two_sided(z)))
    return out
