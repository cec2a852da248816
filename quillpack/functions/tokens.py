"""An estimate of language-model tokens, counted in one pass over the UTF-8 bytes of a whole Arrow batch.

White space separates; each punctuation mark is a token; a run of n UTF-16 units outside ASCII that starts a word is ceil(n / 1.5)
tokens; an ASCII word is one, and one more for each change of case or between letters and digits inside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BREAK, _MARK, _UPPER, _LOWER, _DIGIT, _OTHER, _WIDE = range(7)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[128:] = _WIDE
for _c in range(128):
    _s = chr(_c)
    if _s in "\t\n\r\x0b\x0c ":
        _KIND[_c] = _BREAK
    elif _s.isupper():
        _KIND[_c] = _UPPER
    elif _s.islower():
        _KIND[_c] = _LOWER
    elif _s.isdigit():
        _KIND[_c] = _DIGIT
    elif _s.isprintable() and _s != "_":
        _KIND[_c] = _MARK
#: UTF-16 units that start at each byte: none at one that goes on, two at the first of four.
_UNITS = np.ones(256, dtype=np.uint8)
_UNITS[0x80:0xC0], _UNITS[0xF0:] = 0, 2


#: Bytes counted at once: the arrays that a count needs take some forty times as many.
PIECE = 1 << 20


def count_batch(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The estimate of each text: the bytes from offsets[k] to offsets[k + 1].

    Counted in pieces of whole texts; a text larger than a piece is cut behind white space or a mark, where nothing before matters.
    """
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    k, at = 0, int(offsets[0])
    while k < len(out):
        past = int(np.searchsorted(offsets, at + PIECE, "right")) - 1
        if past > k:
            bounds = offsets[k : past + 1].astype(np.int64)
            bounds[0] = at
            out[k:past] += _count(data, bounds)
            k, at = past, int(offsets[past])
        else:
            cut = _cut(data, at + PIECE, int(offsets[k + 1]))
            out[k] += _count(data, np.array([at, cut]))[0]
            k, at = k + (cut == int(offsets[k + 1])), cut
    return out


def _cut(data: np.ndarray, at: int, end: int) -> int:
    """The first place behind white space or a mark that stands at `at` or later; end if there is none before."""
    for k in range(at, end, PIECE):
        if len(found := np.flatnonzero(_KIND[data[k : min(k + PIECE, end)]] < _UPPER)):
            return k + int(found[0]) + 1
    return end


def _count(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """count_batch of one piece."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    some = np.flatnonzero(np.diff(offsets))
    if not len(some):
        return out
    base = int(offsets[0])
    data, starts = data[base : int(offsets[-1])], (offsets[some] - base).astype(np.int64)
    kind = _KIND[data]
    before = np.empty_like(kind)  # of the byte before, which is a break at the start of a text
    before[1:] = kind[:-1]
    before[starts] = _BREAK
    inside, fresh = kind >= _UPPER, before < _UPPER
    upper, lower, was_upper = kind == _UPPER, kind == _LOWER, before == _UPPER
    count = (kind == _MARK).view(np.uint8) + (inside & fresh)
    count += upper & ~fresh & ~was_upper
    count += ((kind == _DIGIT) & (was_upper | (before == _LOWER))) | (lower & (before == _DIGIT))
    count[2:] += lower[2:] & was_upper[2:] & was_upper[1:-1]
    out[some] = np.add.reduceat(count, starts, dtype=np.int64)
    wide = kind == _WIDE
    first = np.flatnonzero(wide & fresh)
    if len(first):  # runs outside ASCII at the start of a word
        ends = np.append(np.flatnonzero(~wide | fresh), len(data))
        last = ends[np.searchsorted(ends, first, "right")]
        units = np.concatenate(([0], np.cumsum(_UNITS[data], dtype=np.int64)))
        more = (2 * (units[last] - units[first]) + 2) // 3
        # The word that such a run is all of was counted above; in one that goes on, its first character follows a break.
        after, follows = np.append(kind, _BREAK)[last], np.isin(last, starts)
        more -= (after < _UPPER) | follows
        more -= (after == _UPPER) & ~follows
        out[some] += np.bincount(np.searchsorted(starts, first, "right") - 1, weights=more, minlength=len(starts)).astype(np.int64)
    return out


@F.arrow_udf(T.LongType())
def _estimate(texts: pa.Array) -> pa.Array:
    large = pa.types.is_large_string(texts.type)
    if not large and not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    counts = count_batch(np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8), places)
    return pa.array(counts, mask=np.asarray(texts.is_null()) if texts.null_count else None)


def token_estimate(text: Column) -> Column:
    """The estimate, as a BIGINT; NULL for NULL."""
    return _estimate(text.cast("string"))
