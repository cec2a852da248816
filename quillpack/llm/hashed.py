"""Hashed text features for whole texts, and the optimiser that the linear models share (numpy only)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_MUL = np.uint32(0x01000193)
_MIX = np.uint32(0x9E3779B1)
_FOLD = np.arange(0x250, dtype=np.uint32)
for _c in range(0x250):
    if not chr(_c).isalnum():
        _FOLD[_c] = 32


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def words_only(text: str) -> np.ndarray:
    """Lower-case code points in which each run of other than letters and digits is one space, with a space at either end."""
    raw = code_points(f" {text.lower()} ")
    low = raw < 0x250
    folded = np.where(low, _FOLD[np.where(low, raw, 0)], raw)
    space = folded == 32
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return folded[keep]


def ngram_buckets(points: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The bucket of every n-gram of that order, in order of place; none if the text is shorter."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    h = np.full(n, np.uint32(order * 7919 + 1))
    for k in range(order):
        h *= _MUL
        h += points[k : k + n]
        h ^= h >> np.uint32(15)
    return (h * _MIX) >> np.uint32(32 - bits)


class Distinct:
    """Distinct buckets without a sort: the last place of each bucket is the one that counts."""

    def __init__(self, bits: int):
        self.place = np.zeros(1 << bits, dtype=np.int32)

    def __call__(self, buckets: np.ndarray) -> np.ndarray:
        at = np.arange(len(buckets), dtype=np.int32)
        self.place[buckets] = at
        return buckets[self.place[buckets] == at]


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 60, memory: int = 8, tol: float = 1e-6) -> np.ndarray:
    """A minimum of the smooth function f (value and gradient), by limited-memory BFGS with backtracking."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = -grad, []
        for s, y, rho in reversed(past):
            alphas.append(a := rho * (s @ d))
            d = d - a * y
        if past:
            s, y, _ = past[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, float(np.linalg.norm(d)))
        for (s, y, rho), a in zip(past, reversed(alphas), strict=True):
            d = d + (a - rho * (y @ d)) * s
        slope, t = float(grad @ d), 1.0
        if slope >= 0:
            break
        while t > 1e-10:
            new = x + t * d
            new_value, new_grad = f(new)
            if new_value <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = new - x, new_grad - grad
        if (sy := float(s @ y)) > 1e-12:
            past = [*past[1 - memory :], (s, y, 1 / sy)]
        done = value - new_value <= tol * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x


class Rows:
    """Sparse rows: column numbers and values one after the other, with each row's length."""

    def __init__(self, columns: list[np.ndarray], width: int, values: list[np.ndarray] | None = None):
        self.lengths = np.array([len(c) for c in columns], dtype=np.int64)
        self.columns = np.concatenate([*columns, np.zeros(0, dtype=np.uint32)]).astype(np.int32)
        self.values = None if values is None else np.concatenate([*values, np.zeros(0, dtype=np.float32)]).astype(np.float32)
        self.width = width
        self.owner = np.repeat(np.arange(len(columns), dtype=np.int32), self.lengths)

    def dot(self, w: np.ndarray) -> np.ndarray:
        picked = w[self.columns] if self.values is None else w[self.columns] * self.values
        return np.bincount(self.owner, weights=picked, minlength=len(self.lengths))

    def back(self, g: np.ndarray) -> np.ndarray:
        picked = g[self.owner] if self.values is None else g[self.owner] * self.values
        return np.bincount(self.columns, weights=picked, minlength=self.width)
