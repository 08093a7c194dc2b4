"""Distributions for Arrow-batched functions, in numpy: log gamma, incomplete beta, binomial, Student's t, Kolmogorov-Smirnov."""

from __future__ import annotations

import math

import numpy as np

# fixed values: coefficients of Lanczos' approximation for g = 7
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of values above 0."""
    z = np.asarray(x, float) - 1
    a = np.full_like(z, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        a = a + c / (z + i)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(a)


def binom_logpmf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log probability of k successes; nan where a value is nan or p is not in [0, 1]."""
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(p, float))
    with np.errstate(all="ignore"):
        out = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
        out = out + np.where(k > 0, k * np.log(p), 0) + np.where(n > k, (n - k) * np.log1p(-p), 0)
    bad = np.isnan(k + n + p) | (p < 0) | (p > 1)
    return np.where(bad, np.nan, np.where((k < 0) | (k > n), -np.inf, out))


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Regularized incomplete beta function, by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    with np.errstate(all="ignore"):
        swap = x > (a + 1) / (a + b + 2)
        a2, b2, x2 = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        front = np.exp(lgamma(a2 + b2) - lgamma(a2) - lgamma(b2) + a2 * np.log(x2) + b2 * np.log1p(-x2)) / a2
        tiny = 1e-300
        c, d = np.ones_like(x2), 1 - (a2 + b2) * x2 / (a2 + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, steps):
            for t in (m * (b2 - m) * x2 / ((a2 + 2 * m - 1) * (a2 + 2 * m)), -(a2 + m) * (a2 + b2 + m) * x2 / ((a2 + 2 * m) * (a2 + 2 * m + 1))):
                d = 1 + t * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + t / np.where(np.abs(c) < tiny, tiny, c)
                h = h * c * d
            if np.nanmax(np.abs(c * d - 1), initial=0) < 1e-14:
                break
        y = front * h
    y = np.where(swap, 1 - y, y)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, y))


def binom_cdf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probability of at most k successes."""
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(p, float))
    inside = (k >= 0) & (k < n)
    y = betainc(np.where(inside, n - k, 1), np.where(inside, k + 1, 1), np.where(inside, 1 - p, 0.5))
    y = np.where(k >= n, 1.0, np.where(k < 0, 0.0, y))
    return np.where(np.isnan(k + n + p) | (p < 0) | (p > 1), np.nan, y)


def binom_test(k: int, n: int, p: float = 0.5) -> float:
    """Two-sided probability: that of all numbers that are at most as likely as k."""
    if n == 0:
        return math.nan
    logs = binom_logpmf(np.arange(n + 1), n, p)
    return float(min(1.0, np.exp(logs[logs <= logs[k] + 1e-7]).sum()))


def t_pdf(x: np.ndarray, df: float, loc: np.ndarray = 0.0, scale: np.ndarray = 1.0) -> np.ndarray:
    z = (np.asarray(x, float) - loc) / scale
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return front * (1 + z * z / df) ** (-(df + 1) / 2) / scale


def ks_uniform(values: np.ndarray) -> float:
    """Probability, by the limit distribution, of a greater distance from the uniform distribution on [0, 1]; nan without values."""
    v = np.sort(np.asarray(values, float))
    v = v[~np.isnan(v)]
    n = len(v)
    if not n:
        return math.nan
    u = np.clip(v, 0, 1)
    d = max((np.arange(1, n + 1) / n - u).max(), (u - np.arange(n) / n).max())
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if x < 0.2:
        return 1.0
    j = np.arange(1, 101)
    return float(np.clip(2 * ((-1.0) ** (j - 1) * np.exp(-2 * j * j * x * x)).sum(), 0, 1))


def density_mode(values: np.ndarray, grid: np.ndarray, weights: np.ndarray | None = None, bandwidth: float | None = None) -> float:
    """Place on the grid of the greatest Gaussian kernel density; nan without values."""
    y = kernel_density(values, grid, weights, bandwidth)
    return float(grid[int(np.argmax(y))]) if y is not None else math.nan


def kernel_density(values: np.ndarray, grid: np.ndarray, weights: np.ndarray | None = None, bandwidth: float | None = None) -> np.ndarray | None:
    """Gaussian kernel density; ``bandwidth`` is a factor of the deviation of the values (by Scott's rule, if None)."""
    v = np.asarray(values, float)
    w = np.ones(len(v)) if weights is None else np.asarray(weights, float)
    ok = ~np.isnan(v) & ~np.isnan(w)
    v, w = v[ok], w[ok]
    if not len(v) or not w.sum():
        return None
    w = w / w.sum()
    n_eff = 1 / (w * w).sum()
    mean = (v * w).sum()
    std = math.sqrt((w * (v - mean) ** 2).sum() / max(1 - (w * w).sum(), 1e-12)) or 1e-6
    h = (bandwidth if bandwidth is not None else n_eff ** -0.2) * std
    out = np.zeros(len(grid))
    for lo in range(0, len(v), 20_000):
        z = (grid[:, None] - v[None, lo : lo + 20_000]) / h
        out += (np.exp(-0.5 * z * z) * w[None, lo : lo + 20_000]).sum(1)
    return out / (h * math.sqrt(2 * math.pi))


def peaks(y: np.ndarray, rel_height: float = 0.5) -> list[tuple[int, float, float, float]]:
    """Local maxima (index, height, left, right): the places, between samples, where the curve falls to the peak less
    ``rel_height`` of its prominence."""
    out = []
    n, i = len(y), 1
    while i < n - 1:
        if y[i - 1] < y[i]:
            j = i
            while j < n - 1 and y[j + 1] == y[i]:
                j += 1
            if j < n - 1 and y[j + 1] < y[i]:
                top = (i + j) // 2
                left = top
                while left > 0 and y[left - 1] <= y[top]:
                    left -= 1
                right = top
                while right < n - 1 and y[right + 1] <= y[top]:
                    right += 1
                base = max(y[left : top + 1].min(), y[top : right + 1].min())
                level = y[top] - (y[top] - base) * rel_height
                a = top
                while a > left and y[a] > level:
                    a -= 1
                b = top
                while b < right and y[b] > level:
                    b += 1
                la = a + (level - y[a]) / (y[a + 1] - y[a]) if y[a] < level else float(a)
                rb = b - (level - y[b]) / (y[b - 1] - y[b]) if y[b] < level else float(b)
                out.append((top, float(y[top]), float(la), float(rb)))
            i = j
        i += 1
    return out


def histogram_peaks(values: np.ndarray, bins: int = 10) -> list[tuple[float, float]]:
    """(middle of the bin, density) of the local maxima of a histogram, whose ends count as neighbours of 0."""
    v = np.asarray(values, float)
    v = v[~np.isnan(v)]
    if not len(v):
        return []
    y, edges = np.histogram(v, bins, density=True)
    found = peaks(np.concatenate([[0.0], y, [0.0]]))
    return [(float((edges[i - 1] + edges[i]) / 2), h) for i, h, _, _ in found]


def without_contained(found: list[tuple[int, float, float, float]]) -> list[tuple[int, float, float, float]]:
    """Peaks whose extent lies in no other one's."""
    return [p for p in found if not any(q is not p and q[2] <= p[2] and p[3] <= q[3] and (q[2], q[3]) != (p[2], p[3]) for q in found)]


def piecewise_constant(y: np.ndarray, least: int, penalty: float) -> list[int]:
    """Borders of the piecewise constant function of least squares with a penalty per piece, pieces having at least ``least``
    values; by dynamic programming over all ends."""
    y = np.asarray(y, float)
    n = len(y)
    if n < 2 * least:
        return [0, n] if n else [0]
    s, q = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for e in range(least, n + 1):
        b = np.arange(0, e - least + 1)
        cost = best[b] + q[e] - q[b] - (s[e] - s[b]) ** 2 / (e - b) + penalty
        i = int(np.argmin(cost))
        best[e], back[e] = cost[i], b[i]
    out, e = [n], n
    while e:
        e = int(back[e])
        out.append(e)
    return out[::-1]


def generalized_poisson(rng: np.random.Generator, mean: float, omega: float, size: int) -> np.ndarray:
    """Draws with the mean and the variance mean / (1 - omega)**2, by inversion."""
    lam, k = mean * (1 - omega), np.arange(int(mean + 40 * np.sqrt(mean) / (1 - omega) + 50))
    t = lam + omega * k
    p = np.exp(np.log(lam) + (k - 1) * np.log(t) - t - lgamma(k + 1.0))
    return np.searchsorted(np.cumsum(p) / p.sum(), rng.random(size))


def dirichlet_multinomial(rng: np.random.Generator, n: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Counts (rows, classes) of n draws each, from portions that are drawn from a Dirichlet distribution."""
    return rng.multinomial(np.asarray(n), rng.dirichlet(alpha, len(n)))


def simulated_fractions(rng: np.random.Generator, depth: float, portions: np.ndarray, size: int, omega: float = 0.1, concentration: float = 100.0) -> np.ndarray:
    """Allele fractions (rows, alleles) of ``size`` places of the mean depth; rows of depth 0 are nan."""
    counts = dirichlet_multinomial(rng, generalized_poisson(rng, depth, omega, size), np.asarray(portions) * concentration)
    with np.errstate(invalid="ignore"):
        return counts / counts.sum(1, keepdims=True)
