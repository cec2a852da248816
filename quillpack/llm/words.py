"""Words of a text as places and 64-bit hashes, found with array operations over its code points."""

from __future__ import annotations

import numpy as np

from .hashed import code_points

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LATIN = 0x250
_IS_WORD = np.array([chr(c).isalnum() for c in range(_LATIN)])
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(_LATIN)], dtype=np.uint32)
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        one = np.ones(1, dtype=np.uint64)
        _powers = tuple(np.concatenate((one, np.cumprod(np.full(size - 1, b, dtype=np.uint64)))) for b in (_BASE, _INVERSE))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which close ones end far apart."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(text: str, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of letters and digits; Latin letters in lower case. With prefix, hashes of that many first characters."""
    starts, ends, total, down = _sums(text)
    return starts, ends, _hashes(starts, ends if prefix is None else np.minimum(ends, starts + prefix), total, down)


def words_and_prefixes(text: str, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of words(text) and of words(text, prefix), at the cost of one."""
    starts, ends, total, down = _sums(text)
    return _hashes(starts, ends, total, down), _hashes(starts, np.minimum(ends, starts + prefix), total, down)


def _hashes(starts: np.ndarray, stops: np.ndarray, total: np.ndarray, down: np.ndarray) -> np.ndarray:
    return mix((total[stops] - total[starts]) * down[starts]) if len(starts) else np.zeros(0, dtype=np.uint64)


def _sums(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, running sums of the characters' terms, and the powers that shift a sum to place 0."""
    raw = code_points(text)
    latin = raw < _LATIN
    at = np.where(latin, raw, 0)
    word = np.where(latin, _IS_WORD[at], ~(((raw >= 0x2000) & (raw < 0x2070)) | ((raw >= 0x3000) & (raw < 0x3040))))
    edges = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((np.where(latin, _LOWER[at], raw).astype(np.uint64) + np.uint64(7)) * up[: len(raw)], out=total[1:])
    return starts, ends, total, down
