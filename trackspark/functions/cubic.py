"""Monotone cubic interpolation (Fritsch and Carlson, 1980) of a few knots, in numpy."""

from __future__ import annotations

import math

import numpy as np


def limited(slope: float, ahead: float, secant: float) -> tuple[float, float]:
    """Slopes at both ends of a piece of that secant that keep it monotone: against it none, and within a circle of radius 3."""
    if secant == 0:
        return 0.0, 0.0
    a, b = max(0.0, slope / secant), max(0.0, ahead / secant)
    size = math.hypot(a, b)
    scale = secant * (3 / size if size > 3 else 1)
    return a * scale, b * scale


class MonotoneCubic:
    """Through rising x: secants averaged at inner knots, 0 where they disagree in sign, limited in order so that no piece overshoots."""

    def __init__(self, x, y):
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)
        if len(self.x) != len(self.y) or len(self.x) < 2 or not (np.diff(self.x) > 0).all():
            raise ValueError("two knots at least are asked for, at rising x")
        s = np.diff(self.y) / np.diff(self.x)
        inner = np.where(s[:-1] * s[1:] > 0, (s[:-1] + s[1:]) / 2, 0.0)
        self.m = np.concatenate([s[:1], inner, s[-1:]])
        if len(s) > 1:
            for k, secant in enumerate(s):
                self.m[k : k + 2] = limited(*self.m[k : k + 2], secant)

    def __call__(self, at) -> np.ndarray:
        """Values at any points; beyond the ends, the ends' values."""
        at = np.clip(np.asarray(at, float), self.x[0], self.x[-1])
        k = np.clip(np.searchsorted(self.x, at, "right") - 1, 0, len(self.x) - 2)
        h = self.x[k + 1] - self.x[k]
        t = (at - self.x[k]) / h
        y = self.y[k] + t * t * (3 - 2 * t) * (self.y[k + 1] - self.y[k])
        return y + h * t * (1 - t) * ((1 - t) * self.m[k] - t * self.m[k + 1])
