"""Gradient-boosted depth-two trees for small feature tables (logistic loss), in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """``trees``: (feature, threshold, left (feature, threshold, low, high), right (...))."""

    base: float = 0.0
    trees: list[tuple] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        for f, t, low, high in self.trees:
            side = x[:, f] > t
            for part, (g, u, a, b) in ((~side, low), (side, high)):
                out[part] += np.where(x[part, g] > u, b, a)
        return out


def _stump(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float, float, float, float]:
    """The split with the largest gain: (feature, threshold, low value, high value, gain)."""
    total_g, total_h = gradient.sum(), hessian.sum() + 1.0
    best = (0, np.inf, float(total_g / total_h), 0.0, 0.0)
    for f, thresholds in enumerate(cuts):
        if not len(thresholds):
            continue
        place = np.searchsorted(thresholds, x[:, f], side="left")
        g = np.cumsum(np.bincount(place, gradient, len(thresholds) + 1))[:-1]
        h = np.cumsum(np.bincount(place, hessian, len(thresholds) + 1))[:-1]
        gain = g**2 / (h + 1.0) + (total_g - g) ** 2 / (total_h - h) - total_g**2 / total_h
        i = int(gain.argmax())
        if gain[i] > best[4]:
            best = (f, float(thresholds[i]), float(g[i] / (h[i] + 1.0)), float((total_g - g[i]) / (total_h - h[i])), float(gain[i]))
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3) -> Boosted:
    """Fit on features ``x`` and labels ``y`` of 0 and 1; no rows or one class give a constant model."""
    if not len(y) or y.min() == y.max():
        return Boosted(base=4.0 if len(y) and y[0] else -4.0)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)))[:-1] for f in range(x.shape[1])]
    share = y.mean()
    model = Boosted(base=float(np.log(share / (1 - share))))
    odds = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        g, h = y - p, p * (1 - p)
        f, t, *_ = _stump(x, g, h, cuts)
        side = x[:, f] > t
        leaves = []
        for part in (~side, side):
            if part.any():
                q, u, a, b, _ = _stump(x[part], g[part], h[part], cuts)
                leaves.append((q, u, rate * a, rate * b if np.isfinite(u) else rate * a))
            else:
                leaves.append((0, np.inf, 0.0, 0.0))
        model.trees.append((f, t, leaves[0], leaves[1]))
        odds += Boosted(0.0, [model.trees[-1]]).score(x)
    return model
