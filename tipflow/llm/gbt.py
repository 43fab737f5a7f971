"""Gradient-boosted trees for two classes, flattened into numpy node arrays.

Newton steps on the logistic loss over quantile-binned features.  A feature may be constrained to
push the score up (+1) or down (-1) only: a split whose child values go the other way is not
taken, and the middle of its children's values bounds the trees below on either side.  Training
takes a bounded sample; scoring walks all rows of a matrix down each tree at once.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    """Node arrays of all trees: feature (-1: leaf), threshold, left, right, value; roots."""

    def __init__(self):
        self.feature: np.ndarray = np.zeros(0, np.int32)
        self.threshold = np.zeros(0)
        self.left = np.zeros(0, np.int32)
        self.right = np.zeros(0, np.int32)
        self.value = np.zeros(0)
        self.roots: list[int] = []
        self.base = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, np.int32)
            while True:
                feature = self.feature[node]
                inner = feature >= 0
                if not inner.any():
                    break
                down = np.where(x[rows, feature] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(inner, down, node)
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone=None, trees: int = 60, depth: int = 4, rate: float = 0.2,
        bins: int = 64, ridge: float = 1.0, least: float = 1.0, weight: np.ndarray | None = None) -> Boosted:
    """Trees for rows ``x`` with labels ``y`` (0 or 1); monotone: a sign (-1, 0, 1) for each feature."""
    model = Boosted()
    if not len(x):
        return model
    weight = np.ones(len(y)) if weight is None else weight
    signs = np.zeros(x.shape[1], int) if monotone is None else np.asarray(monotone)
    share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    model.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    margin = np.full(len(y), model.base)
    nodes: list[list] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-12)
        model.roots.append(len(nodes))
        _grow(nodes, np.arange(len(y)), (-np.inf, np.inf), depth, binned, cuts, grad, hess, signs, ridge, least, bins)
        step = np.zeros(len(y))
        _assign(nodes, model.roots[-1], np.arange(len(y)), x, step)
        for node in nodes[model.roots[-1]:]:
            node[4] *= rate
        margin += rate * step
    columns = list(zip(*nodes))
    model.feature, model.left, model.right = (np.array(columns[i], np.int32) for i in (0, 2, 3))
    model.threshold, model.value = np.array(columns[1], float), np.array(columns[4], float)
    return model


def _assign(nodes, node, rows, x, out):
    feature, threshold, left, right, value = nodes[node]
    if feature < 0:
        out[rows] = value
        return
    goes = x[rows, feature] <= threshold
    _assign(nodes, left, rows[goes], x, out)
    _assign(nodes, right, rows[~goes], x, out)


def _grow(nodes, rows, bounds, depth, binned, cuts, grad, hess, signs, ridge, least, bins) -> int:
    """Append the tree over ``rows``; its number.  Values stay within ``bounds``."""
    def worth(g, h):
        return np.clip(-g / (h + ridge), *bounds)

    def gain(g, h, v):
        return -(g * v + 0.5 * (h + ridge) * v * v)

    g, h = grad[rows].sum(), hess[rows].sum()
    own = worth(g, h)
    number = len(nodes)
    nodes.append([-1, 0.0, -1, -1, float(own)])
    best = (1e-6, None)
    if depth:
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            place = binned[rows, f]
            gl = np.cumsum(np.bincount(place, grad[rows], bins))[:len(cut)]
            hl = np.cumsum(np.bincount(place, hess[rows], bins))[:len(cut)]
            vl, vr = worth(gl, hl), worth(g - gl, h - hl)
            better = gain(gl, hl, vl) + gain(g - gl, h - hl, vr) - gain(g, h, own)
            better[(hl < least) | (h - hl < least) | (signs[f] * (vr - vl) < 0)] = -np.inf
            i = int(np.argmax(better))
            if better[i] > best[0]:
                best = (better[i], (f, i, vl[i], vr[i]))
    if best[1] is not None:
        f, i, vl, vr = best[1]
        low, high = bounds
        middle = (vl + vr) / 2
        sides = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
        goes = binned[rows, f] <= i
        args = (depth - 1, binned, cuts, grad, hess, signs, ridge, least, bins)
        left = _grow(nodes, rows[goes], sides[int(signs[f])][0], *args)
        right = _grow(nodes, rows[~goes], sides[int(signs[f])][1], *args)
        nodes[number] = [f, float(cuts[f][i]), left, right, 0.0]
    return number
