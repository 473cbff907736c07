"""Gradient-boosted trees on a bounded sample, flattened into node arrays. Deterministic; no library beyond numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Node arrays of all trees, one after the other. A leaf has feature -1; ``x <= threshold`` goes left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the positive class, for all rows at once."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                if (f < 0).all():
                    break
                stay = f < 0
                left = x[rows, np.where(stay, 0, f)] <= self.threshold[at]
                at = np.where(stay, at, np.where(left, self.left[at], self.right[at]))
            out += self.value[at]
        return out

    def sql(self, columns: list[str], node: int | None = None) -> str:
        """The same score as nested CASE expressions over integer ``columns``."""
        if node is None:
            return f"({self.base:.17e}" + "".join(f" + {self.sql(columns, int(r))}" for r in self.roots) + ")"
        if self.feature[node] < 0:
            return f"{float(self.value[node]):.17e}"
        return f"CASE WHEN {columns[self.feature[node]]} <= {int(np.floor(self.threshold[node]))} THEN {self.sql(columns, int(self.left[node]))} ELSE {self.sql(columns, int(self.right[node]))} END"


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, l2: float = 1.0, least: int = 5, bins: int = 64, monotone: dict[int, int] | None = None) -> Trees:
    """Logistic loss. ``monotone[f]`` is 1 or -1: the score never falls, or never rises, as feature f grows.

    A constrained split must order its children's values; their subtrees are then held on either side of the middle.
    With one class or no rows, the result is a constant.
    """
    monotone = monotone or {}
    n, width = x.shape
    p = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if n else np.zeros(0) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], 1) if n else np.zeros((0, width), int)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    score = np.full(n, base)

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        me, total_g, total_h = node(), g[rows].sum(), h[rows].sum()
        value[me] = float(np.clip(rate * total_g / (total_h + l2), lo, hi))
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for f in range(width):
                k = len(edges[f])
                if not k:
                    continue
                b = binned[rows, f]
                sums = [np.bincount(b, weights=w, minlength=k + 1).cumsum()[:k] for w in (g[rows], h[rows], np.ones(len(rows)))]
                gl, hl, nl = sums
                gr, hr, nr = total_g - gl, total_h - hl, len(rows) - nl
                vl, vr = np.clip(rate * gl / (hl + l2), lo, hi), np.clip(rate * gr / (hr + l2), lo, hi)
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total_g**2 / (total_h + l2)
                gain[(nl < least) | (nr < least) | (monotone.get(f, 0) * (vr - vl) < 0)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), (f, at, float(vl[at]), float(vr[at])))
        if best[1]:
            f, at, vl, vr = best[1]
            middle, sign = (vl + vr) / 2, monotone.get(f, 0)
            bounds = ((lo, hi), (lo, hi)) if not sign else ((lo, middle), (middle, hi)) if sign > 0 else ((middle, hi), (lo, middle))
            goes = binned[rows, f] <= at
            feature[me], threshold[me] = f, float(edges[f][at])
            left[me] = grow(rows[goes], g, h, level + 1, *bounds[0])
            right[me] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return me

    arrays = lambda: Trees(np.array(feature, int), np.array(threshold), np.array(left, int), np.array(right, int), np.array(value), np.array(roots, int), base)
    if n and 0 < y.sum() < n:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            first = len(feature)
            roots.append(grow(np.arange(n), y - p, p * (1 - p), 0, -np.inf, np.inf))
            one = arrays()
            one.roots, one.base = np.array([first]), 0.0
            score += one.score(x)
    return arrays()
