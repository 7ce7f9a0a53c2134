"""A linear-chain conditional random field with two states over flat arrays.

Many chains lie one after another in one array; `starts` marks the first
position of each.  State 0 has score 0, state 1 has the position's score; the
four transition scores are shared.  The chain products are taken in blocks, all
blocks in step, so no Python loop runs over positions."""

from __future__ import annotations

import numpy as np

WIDTH = 64
PART = 200_000  # positions of a training step's part


def _prefix(m: np.ndarray) -> np.ndarray:
    """Row vectors v_t = v_{t-1} M_t, each scaled to sum 1, from (0.5, 0.5).
    m: (4, n), rows m00, m01, m10, m11."""
    n = m.shape[1]
    out = np.empty((2, n))
    if n <= WIDTH:
        a = b = 0.5
        for t in range(n):
            m00, m01, m10, m11 = m[:, t]
            a, b = a * m00 + b * m10, a * m01 + b * m11
            s = a + b
            a, b = a / s, b / s
            out[0, t], out[1, t] = a, b
        return out
    blocks = -(-n // WIDTH)
    padded = np.zeros((4, blocks * WIDTH))
    padded[0], padded[3] = 1.0, 1.0
    padded[:, :n] = m
    m = np.ascontiguousarray(padded.reshape(4, blocks, WIDTH).transpose(0, 2, 1))
    p00, p01, p10, p11 = m[0, 0], m[1, 0], m[2, 0], m[3, 0]
    for t in range(1, WIDTH):
        a, b, c, d = m[0, t], m[1, t], m[2, t], m[3, t]
        p00, p01, p10, p11 = p00 * a + p01 * c, p00 * b + p01 * d, p10 * a + p11 * c, p10 * b + p11 * d
        s = 1.0 / (p00 + p01 + p10 + p11)
        p00, p01, p10, p11 = p00 * s, p01 * s, p10 * s, p11 * s
    after = _prefix(np.stack([p00, p01, p10, p11]))
    a = np.concatenate([[0.5], after[0, :-1]])
    b = np.concatenate([[0.5], after[1, :-1]])
    res = np.empty((2, WIDTH, blocks))
    for t in range(WIDTH):
        a, b = a * m[0, t] + b * m[2, t], a * m[1, t] + b * m[3, t]
        s = 1.0 / (a + b)
        a, b = a * s, b * s
        res[0, t], res[1, t] = a, b
    return res.transpose(0, 2, 1).reshape(2, -1)[:, :n]


def _matrices(score: np.ndarray, starts: np.ndarray, trans: np.ndarray, begin: np.ndarray) -> np.ndarray:
    w = np.exp(np.clip(score, -30, 30))
    t = np.exp(np.clip(trans, -20, 20))
    m = np.empty((4, len(score)))
    m[0], m[1], m[2], m[3] = t[0], t[1] * w, t[2], t[3] * w
    s = np.exp(np.clip(begin, -20, 20))
    m[0, starts] = m[2, starts] = s[0]
    m[1, starts] = m[3, starts] = s[1] * w[starts]
    return m


def marginals(score: np.ndarray, starts: np.ndarray, trans: np.ndarray, begin: np.ndarray, pairs: bool = False):
    """Probability of state 1 at each position by forward-backward; with
    `pairs` also the expected transition counts (4,) and begin counts (2,)."""
    n = len(score)
    if not n:
        return (np.zeros(0), np.zeros(4), np.zeros(2)) if pairs else np.zeros(0)
    m = _matrices(score, starts, trans, begin)
    alpha = _prefix(m)
    beta = np.empty((2, n))
    beta[:, -1] = 0.5
    if n > 1:
        beta[:, :-1] = _prefix(np.ascontiguousarray(m[:, :0:-1][[0, 2, 1, 3]]))[:, ::-1]
    g = alpha[1] * beta[1]
    g = g / (g + alpha[0] * beta[0])
    if not pairs:
        return g
    inner = np.ones(n, bool)
    inner[starts] = False
    k = np.flatnonzero(inner)
    x = np.stack([alpha[i, k - 1] * m[2 * i + j, k] * beta[j, k] for i in (0, 1) for j in (0, 1)])
    x /= x.sum(0)
    return g, x.sum(1), np.array([(1 - g[starts]).sum(), g[starts].sum()])


def fit(features: np.ndarray, size: int, labels: np.ndarray, starts: np.ndarray, weight: np.ndarray | None = None, rounds: int = 40, l2: float = 1e-3, rate: float = 0.5):
    """Maximum conditional likelihood by full-batch AdaGrad.

    features: (n, k) ids below `size` whose weights add up to a position's
    score (id 0: none).  weight: of each position in the emission gradient.
    Returns (weights, trans, begin)."""
    n, k = features.shape
    theta, trans, begin = np.zeros(size), np.zeros(4), np.zeros(2)
    if not n:
        return theta, trans, begin
    there = np.zeros(size, bool)
    for j in range(k):
        there[features[:, j]] = True
    used = np.flatnonzero(there)
    place = np.zeros(size, np.int32)
    place[used] = np.arange(len(used))
    w, gw, gt, gb = np.zeros(len(used)), np.full(len(used), 1e-8), np.full(4, 1e-8), np.full(2, 1e-8)
    live = used != 0
    y = labels.astype(float)
    inner = np.ones(n, bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(2 * labels[at - 1].astype(int) + labels[at].astype(int), minlength=4).astype(float)
    first = np.array([(1 - y[starts]).sum(), y[starts].sum()])
    del inner, at
    # whole chains in parts, so that memory follows PART and not the sample
    cut = np.unique(np.append(starts[np.searchsorted(starts, np.arange(0, n, PART))[np.arange(0, n, PART) <= starts[-1]]], n))
    cut = np.unique(np.append(cut, 0))
    for _ in range(rounds):
        d, x, b = np.zeros(len(used)), np.zeros(4), np.zeros(2)
        for lo, hi in zip(cut[:-1], cut[1:]):
            score = np.zeros(hi - lo)
            columns = [place[features[lo:hi, j]] for j in range(k)]
            for c in columns:
                score += w[c]
            own = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)] - lo
            g, more, head = marginals(score, own, trans, begin, pairs=True)
            r = y[lo:hi] - g if weight is None else (y[lo:hi] - g) * weight[lo:hi]
            for c in columns:
                d += np.bincount(c, weights=r, minlength=len(used))
            x, b = x + more, b + head
        d = (d / n - l2 / n * w * 100) * live
        gw += d * d
        w += rate * d / np.sqrt(gw)
        d = (seen - x) / n - l2 * trans
        gt += d * d
        trans = trans + rate * 0.5 * d / np.sqrt(gt)
        d = (first - b) / n - l2 * begin
        gb += d * d
        begin = begin + rate * 0.5 * d / np.sqrt(gb)
    theta[used] = w
    return theta, trans, begin


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Weighted logistic regression with intercept, by damped Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = l2 * np.r_[1e-3, np.ones(x.shape[1] - 1)]
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
