"""Distributions and tests on numpy: t, normal, Wilcoxon, Shapiro-Wilk, bootstrap, GEE and a mixed model. No SciPy is needed."""

from __future__ import annotations

import math

import numpy as np


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by the continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    """Probability of a value at least as far from 0."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else (0.0 if math.isinf(t) else math.nan)


def t_quantile(p: float, df: float) -> float:
    """Inverse of the t distribution function, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p and high < 1e12:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - t_two_sided(middle, df) / 2 < p else (low, middle)
    return (low + high) / 2


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if normal_cdf(middle) < p else (low, middle)
    return (low + high) / 2


def mean_interval(x, alpha: float = 0.05) -> tuple[float, float, float]:
    """(mean, low, high) by the t distribution; ends NaN for fewer than two values."""
    x = np.asarray(x, dtype=float)
    if len(x) < 2:
        return (float(x.mean()) if len(x) else math.nan), math.nan, math.nan
    half = t_quantile(1 - alpha / 2, len(x) - 1) * x.std(ddof=1) / math.sqrt(len(x))
    return float(x.mean()), float(x.mean() - half), float(x.mean() + half)


def paired_t(a, b) -> tuple[float, float]:
    """(t, two-sided p) of the mean difference; NaN where all differences are equal and 0."""
    d = np.asarray(a, dtype=float) - np.asarray(b, dtype=float)
    if len(d) < 2:
        return math.nan, math.nan
    sd = d.std(ddof=1)
    if sd == 0:
        return (math.nan, math.nan) if d.mean() == 0 else (math.copysign(math.inf, d.mean()), 0.0)
    t = d.mean() / (sd / math.sqrt(len(d)))
    return float(t), t_two_sided(t, len(d) - 1)


def average_ranks(x: np.ndarray) -> np.ndarray:
    values, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inverse]


def wilcoxon(a, b) -> tuple[float, float]:
    """(W, two-sided p) of the signed-rank test without zero differences. Exact for up to 50 differences without ties, else
    normal with the correction for ties. NaN where nothing differs."""
    d = np.asarray(a, dtype=float) - np.asarray(b, dtype=float)
    zeros, d = bool((d == 0).any()), d[d != 0]
    n = len(d)
    if n == 0:
        return math.nan, math.nan
    ranks = average_ranks(np.abs(d))
    plus = float(ranks[d > 0].sum())
    w = min(plus, n * (n + 1) / 2 - plus)
    _, counts = np.unique(np.abs(d), return_counts=True)
    if n <= 50 and not zeros and (counts == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return w, float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    variance = n * (n + 1) * (2 * n + 1) / 24 - float((counts**3 - counts).sum()) / 48
    z = (w - n * (n + 1) / 4) / math.sqrt(variance)
    return w, float(min(1.0, 2 * normal_cdf(-abs(z))))


def shapiro(x) -> tuple[float, float]:
    """(W, p) of Shapiro and Wilk's test by Royston's approximation; NaN for less than 3 values and where all are equal. p holds for 3 to 5000 values and is NaN beyond."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return math.nan, math.nan
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss = float(m @ m)
    u = 1 / math.sqrt(n)
    weights = m / math.sqrt(ss)
    if n == 3:
        weights = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        # fixed values: Royston's polynomials for the outermost weights
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, weights[-1]], u)
        if n <= 5:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            weights = m / math.sqrt(phi)
        else:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, weights[-2]], u)
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            weights = m / math.sqrt(phi)
            weights[1], weights[-2] = -second, second
        weights[0], weights[-1] = -last, last
    w = min(1.0, float(weights @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n > 5000:
        return w, math.nan
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    # fixed values: Royston's polynomials for the mean and deviation of the transformed statistic
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 0.0
        y = -math.log(gamma - y)
        mu, sigma = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        log = math.log(n)
        mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log))
    return w, float(1 - normal_cdf((y - mu) / sigma))


def skew_kurtosis(x) -> tuple[float, float]:
    """Population skewness and excess kurtosis; NaN without spread."""
    d = np.asarray(x, dtype=float) - np.mean(x)
    m2 = float((d**2).mean())
    return ((float((d**3).mean()) / m2**1.5), float((d**4).mean()) / m2**2 - 3) if m2 > 0 else (math.nan, math.nan)


def bootstrap_means(x, times: int, seed: int, block: int = 500) -> np.ndarray:
    """Means of resamples, some at a time so that memory stays bounded."""
    x, draw = np.asarray(x, dtype=float), np.random.default_rng(seed)
    return np.concatenate([x[draw.integers(0, len(x), (min(block, times - at), len(x)))].mean(axis=1) for at in range(0, times, block)])


def interval(samples: np.ndarray, alpha: float = 0.05) -> tuple[float, float]:
    low, high = np.percentile(samples, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(low), float(high)


def paired_bootstrap(a, b, times: int = 10_000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float, float, float]:
    """(mean difference, low, high, p): percentile interval, and the share of centred resamples at least as far from 0."""
    d = np.asarray(a, dtype=float) - np.asarray(b, dtype=float)
    if not len(d):
        return (math.nan,) * 4
    means = bootstrap_means(d, times, seed)
    low, high = interval(means, alpha)
    return float(d.mean()), low, high, float((np.abs(means - d.mean()) >= abs(d.mean())).mean())


def difference_in_differences(a, b, times: int = 10_000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float, float, float]:
    """As paired_bootstrap, for the difference of the means of two independent sets of differences."""
    if not len(a) or not len(b):
        return (math.nan,) * 4
    seen = float(np.mean(a) - np.mean(b))
    means = bootstrap_means(a, times, seed) - bootstrap_means(b, times, seed + 1)
    low, high = interval(means, alpha)
    return seen, low, high, float((np.abs(means - seen) >= abs(seen)).mean())


def clustered_bootstrap(hits_a, trials_a, hits_b, trials_b, times: int = 10_000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float, float, float]:
    """Difference of pooled rates, resampling whole samples (clusters of trials); the arms' arrays are by sample."""
    arrays = [np.asarray(x, dtype=float) for x in (hits_a, trials_a, hits_b, trials_b)]
    n = len(arrays[0])
    if not n:
        return (math.nan,) * 4
    ha, ta, hb, tb = arrays
    seen = float(ha.sum() / ta.sum() - hb.sum() / tb.sum())
    draw, out = np.random.default_rng(seed), []
    for at in range(0, times, 500):
        pick = draw.integers(0, n, (min(500, times - at), n))
        out.append(ha[pick].sum(axis=1) / ta[pick].sum(axis=1) - hb[pick].sum(axis=1) / tb[pick].sum(axis=1))
    means = np.concatenate(out)
    low, high = interval(means, alpha)
    return seen, low, high, float((np.abs(means - seen) >= abs(seen)).mean())


def separated(a, b) -> bool:
    """Whether an arm is all successes or all failures, so that a logistic model has no finite fit."""
    return any(len(x) and (np.mean(x) in (0.0, 1.0)) for x in (a, b))


def gee_exchangeable(y, arm, cluster, rounds: int = 50) -> tuple[float, float, float]:
    """(log-odds effect of the arm, robust standard error, p) of a logistic GEE with exchangeable correlation in clusters."""
    y, arm = np.asarray(y, dtype=float), np.asarray(arm, dtype=float)
    _, code = np.unique(np.asarray(cluster), return_inverse=True)
    order = np.argsort(code, kind="stable")
    y, x, code = y[order], np.column_stack([np.ones(len(y)), arm])[order], code[order]
    parts = np.split(np.arange(len(y)), np.flatnonzero(np.diff(code)) + 1)
    beta, rho = np.zeros(2), 0.0
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        v = mu * (1 - mu)
        residual = (y - mu) / np.sqrt(v)
        pairs = sum(len(p) * (len(p) - 1) / 2 for p in parts)
        if pairs:
            rho = sum((residual[p].sum() ** 2 - (residual[p] ** 2).sum()) / 2 for p in parts) / pairs / max((residual**2).mean(), 1e-12)
            rho = float(np.clip(rho, -0.5, 0.95))
        bread, score, meat = np.zeros((2, 2)), np.zeros(2), np.zeros((2, 2))
        for p in parts:
            d = x[p] * np.sqrt(v[p])[:, None]
            k = len(p)
            inverse = (np.eye(k) - rho / max(1 + (k - 1) * rho, 1e-9)) / (1 - rho)
            g = d.T @ inverse @ residual[p]
            bread += d.T @ inverse @ d
            score += g
            meat += np.outer(g, g)
        step = np.linalg.solve(bread, score)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    inverse = np.linalg.inv(bread)
    se = math.sqrt((inverse @ meat @ inverse)[1, 1])
    return float(beta[1]), se, float(2 * normal_cdf(-abs(beta[1] / se))) if se > 0 else math.nan


def mixed_logistic(hits, trials, nodes: int = 1, rounds: int = 200) -> tuple[float, float, float, float]:
    """(effect, its standard error, two-sided p, deviation of the clusters) of a logistic model with a normal intercept for each cluster.

    hits and trials have a row a cluster and two columns: the arm, then the one it is compared with. The intercepts are integrated out by adaptive Gauss-Hermite
    quadrature around each cluster's mode; one node is Laplace's approximation. All nan where the likelihood has no inner maximum."""
    hits, trials = np.asarray(hits, float), np.asarray(trials, float)
    z, w = np.polynomial.hermite.hermgauss(nodes)
    log_w, arm = np.log(w) + z * z, np.array([1.0, 0.0])

    def inner(theta, v):
        eta = theta[0] + theta[1] * arm + math.exp(theta[2]) * v[..., None]
        return (hits * eta - trials * np.logaddexp(0, eta)).sum(axis=-1) - v * v / 2, 1 / (1 + np.exp(-eta))

    def likelihood(theta) -> float:
        sigma, v = math.exp(theta[2]), np.zeros(len(hits))
        for _ in range(60):
            p = inner(theta, v)[1]
            curve = sigma * sigma * (trials * p * (1 - p)).sum(axis=1) + 1
            step = np.clip((sigma * (hits - trials * p).sum(axis=1) - v) / curve, -1, 1)
            v += step
            if np.abs(step).max(initial=0) < 1e-10:
                break
        p = inner(theta, v)[1]
        scale = np.sqrt(2 / (sigma * sigma * (trials * p * (1 - p)).sum(axis=1) + 1))
        at = np.stack([inner(theta, v + scale * node)[0] + lw for node, lw in zip(z, log_w, strict=True)])
        top = at.max(axis=0)
        return float((top + np.log(np.exp(at - top).sum(axis=0)) + np.log(scale) - 0.5 * math.log(2 * math.pi)).sum())

    def slopes(theta, h=1e-4):
        e = np.eye(3) * h
        up, down, here = [likelihood(theta + x) for x in e], [likelihood(theta - x) for x in e], likelihood(theta)
        gradient = np.array([(a - b) / (2 * h) for a, b in zip(up, down)])
        hessian = np.diag([(a + b - 2 * here) / (h * h) for a, b in zip(up, down)])
        for i, j in ((0, 1), (0, 2), (1, 2)):
            hessian[i, j] = hessian[j, i] = (likelihood(theta + e[i] + e[j]) - likelihood(theta + e[i] - e[j]) - likelihood(theta - e[i] + e[j]) + likelihood(theta - e[i] - e[j])) / (4 * h * h)
        return here, gradient, hessian

    rate = min(max(hits.sum() / max(trials.sum(), 1), 1e-3), 1 - 1e-3)
    theta = np.array([math.log(rate / (1 - rate)), 0.0, -0.5])
    for _ in range(rounds):
        here, gradient, hessian = slopes(theta)
        values, vectors = np.linalg.eigh(-hessian)
        step = np.clip(vectors @ ((vectors.T @ gradient) / np.maximum(np.abs(values), 1e-6)), -1, 1)
        size = 1.0
        while size > 1e-8 and likelihood(theta + size * step) < here:
            size /= 2
        theta = theta + size * step
        if np.abs(size * step).max() < 1e-7 or np.abs(theta).max() > 12:
            break
    hessian = slopes(theta)[2]
    # without spread between the clusters, log sigma runs off and the other two are what is left
    free = slice(0, 2) if theta[2] < -6 else slice(0, 3)
    if np.abs(theta[:2]).max() > 12 or theta[2] > 5 or np.linalg.eigvalsh(-hessian[free, free]).min() <= 0:
        return math.nan, math.nan, math.nan, math.nan
    se = math.sqrt(np.linalg.inv(-hessian[free, free])[1, 1])
    return float(theta[1]), se, 2 * normal_cdf(-abs(theta[1]) / se), math.exp(theta[2])
