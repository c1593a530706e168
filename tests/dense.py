"""Slow, independent numpy versions of the models, for small data only."""

import numpy as np


def cox_terms(beta, x, stop, status, w=None, strata=None, start=None):
    """Log likelihood, score, information and score residuals by looping over tied ranks."""
    n, k = x.shape
    stop, status = np.asarray(stop), np.asarray(status)
    w = np.ones(n) if w is None else np.asarray(w)
    strata = np.zeros(n) if strata is None else np.asarray(strata)
    start = np.full(n, -np.inf) if start is None else np.asarray(start)
    eta = x @ beta
    r = np.exp(eta)
    ll, score, info = 0.0, np.zeros(k), np.zeros((k, k))
    resid = np.zeros((n, k))
    per_time = []
    for s in np.unique(strata):
        own = strata == s
        for t in np.unique(stop[own & (status == 1)]):
            risk = own & (start < t) & (stop >= t)
            ev = own & (stop == t) & (status == 1)
            d = ev.sum()
            wbar = w[ev].mean()
            ll += (w[ev] * eta[ev]).sum()
            score += (w[ev, None] * x[ev]).sum(axis=0)
            v_t, u_t = np.zeros((k, k)), (w[ev, None] * x[ev]).sum(axis=0)
            xbar_sum = np.zeros(k)
            for rank in range(d):
                share = np.where(ev, 1 - rank / d, 1.0) * risk
                p = w * r * share
                s0 = p.sum()
                mean = (p[:, None] * x).sum(axis=0) / s0
                ll -= wbar * np.log(s0)
                score -= wbar * mean
                u_t = u_t - wbar * mean
                cov = (p[:, None, None] * (x[:, :, None] * x[:, None, :])).sum(axis=0) / s0 - np.outer(mean, mean)
                info += wbar * cov
                v_t += wbar * cov
                resid -= (r * share * wbar / s0)[:, None] * (x - mean)
                resid[ev] -= mean / d
                xbar_sum += mean
            resid[ev] += x[ev]
            per_time.append((t, d, u_t, v_t, xbar_sum / d))
    return ll, score, info, resid, per_time


def newton(x, stop, status, w=None, strata=None, start=None):
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        _, score, info, resid, _ = cox_terms(beta, x, stop, status, w, strata, start)
        beta = beta + np.linalg.solve(info, score)
    _, score, info, resid, per_time = cox_terms(beta, x, stop, status, w, strata, start)
    naive = np.linalg.inv(info)
    w = np.ones(len(x)) if w is None else w
    meat = (w[:, None] * resid).T @ (w[:, None] * resid)
    return beta, naive, naive @ meat @ naive, per_time


def zph(x, stop, status, w):
    """Score tests of beta(t) = beta + theta g(t) with g = 1 - KM(t-), one per term and overall."""
    beta, _, _, per_time = newton(x, stop, status, w)
    k = x.shape[1]
    km, surv, g = 1.0, {}, {}
    for t in np.unique(stop):
        g[t] = 1 - km
        at_risk, d = (stop >= t).sum(), ((stop == t) & (status == 1)).sum()
        km *= 1 - d / at_risk
    times = np.array([p[0] for p in per_time])
    ds = np.array([p[1] for p in per_time])
    gt = np.array([g[t] for t in times])
    gt = gt - (gt * ds).sum() / ds.sum()
    u = sum(a * p[2] for a, p in zip(gt, per_time))
    i11 = sum(p[3] for p in per_time)
    i12 = sum(a * p[3] for a, p in zip(gt, per_time))
    i22 = sum(a * a * p[3] for a, p in zip(gt, per_time))
    left = i22 - i12 @ np.linalg.solve(i11, i12)
    single = [u[j] ** 2 / left[j, j] for j in range(k)]
    return single + [u @ np.linalg.solve(left, u)]


def censoring_left(time, status):
    """G(t-) at every subject's time; events and deaths of a day precede its censorings."""
    g, out = 1.0, {}
    for t in np.unique(time):
        out[t] = g
        c = ((time == t) & (status == 0)).sum()
        at_risk = (time >= t).sum() - ((time == t) & (status != 0)).sum()
        if c:
            g *= 1 - c / at_risk
    return out


def logistic(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ ((p * (1 - p))[:, None] * x), x.T @ (y - p))
    return 1 / (1 + np.exp(-x @ b))
