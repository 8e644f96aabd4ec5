"""Vectorised word segmentation and hashing over Arrow string columns.

A batch of texts is laid out as one array of code points. Words are maximal runs of letters and digits, folded to lower
case one code point at a time. Every step is a numpy pass over the batch, so no Python loop runs per word, and long
texts are hashed in slices so that memory follows the batch and not the longest text times a constant.
A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LIMIT = 0x30000
_SLICE = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = {" ", "\t", "\n", "\r", "\x0b", "\x0c"}
_tables: dict[str, np.ndarray] = {}


def _table(kind: str) -> np.ndarray:
    if kind not in _tables:
        if kind == "word":
            t = np.fromiter((chr(c).isalnum() for c in range(_LIMIT)), dtype=bool, count=_LIMIT)
        elif kind == "space":
            t = np.fromiter((chr(c).isspace() for c in range(_LIMIT)), dtype=bool, count=_LIMIT)
        else:
            t = np.arange(_LIMIT, dtype=np.uint32)
            for c in range(_LIMIT):
                low = chr(c).lower()
                if len(low) == 1:
                    t[c] = ord(low)
        _tables[kind] = t
    return _tables[kind]


def lookup(kind: str, cps: np.ndarray) -> np.ndarray:
    """Entry of the table "word", "space" or "lower" for each code point."""
    table = _table(kind)
    if len(cps) and int(cps.max()) >= _LIMIT:
        return np.where(cps < _LIMIT, table[np.minimum(cps, _LIMIT - 1)], cps if kind == "lower" else False)
    return table[cps]


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    key = f"pow{base}"
    if key not in _tables or len(_tables[key]) < n:
        p = np.full(max(n, 1), base, dtype=np.uint64)
        p[0] = 1
        _tables[key] = np.multiply.accumulate(p)
    return _tables[key][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place where possible."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def layouts(col: pa.Array | pa.ChunkedArray, max_chars: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, row after the last, code points, character offsets) for runs of rows of about max_chars."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "")
    lengths = pc.utf8_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    lo, n = 0, len(col)
    ends = np.cumsum(lengths)
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + max_chars, "right")))
        part = "".join(col.slice(lo, hi - lo).to_pylist())
        cps = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        yield lo, hi, cps, np.concatenate([[0], ends[lo:hi] - base])
        lo = hi


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a text's border."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offs[:-1][offs[:-1] < n]
    first[at] = inside[at]
    at = offs[1:] - 1
    at = at[at >= 0]
    last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_runs(cps: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of cps[start:end] for every run; runs are in order and don't overlap."""
    out = np.empty(len(start), np.uint64)
    base = (_BASE + 2 * seed * 0x51_7C_C1_B7) & (2**64 - 1)
    j = 0
    while j < len(start):
        a = int(start[j])
        k = max(j + 1, int(np.searchsorted(start, a + _SLICE, "left")))
        b = int(end[k - 1])
        s = np.zeros(b - a + 1, np.uint64)
        v = cps[a:b].astype(np.uint64)
        v += np.uint64(0x1F123BB5 + seed)
        v *= _powers(b - a, base)
        np.cumsum(v, out=s[1:])
        x, y = start[j:k] - a, end[j:k] - a
        h = s[y] - s[x]
        h *= _powers(b - a, _inverse(base))[x]
        out[j:k] = mix(h + (y - x).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        j = k
    return out


def words(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, hash) of every word; positions count characters of the batch."""
    start, end = runs(lookup("word", cps), offs)
    text = np.searchsorted(offs, start, "right") - 1
    return text, start, end, hash_runs(lookup("lower", cps), start, end)


def ngrams(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every n words in a row of one text."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(text[:m] == text[n - 1 :])
    g = np.zeros(m, np.uint64)
    for i in range(n):
        g += h[i : i + m]
        g = mix(g * np.uint64(0x9E3779B97F4A7C15 + 2 * i))
    return at, g[at]


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every k values in a row, by prefix sums; len(h) - k + 1 of them."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(m, np.uint64)
    base = (0xC2B2AE3D27D4EB4F + 2 * seed * 0x2545F491) & (2**64 - 1)
    for a in range(0, m, _SLICE):
        b = min(m, a + _SLICE)
        v = mix(h[a : b + k - 1] + np.uint64(seed * 0x632BE59BD9B4E019 & (2**64 - 1)))
        s = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v * _powers(len(v), base), out=s[1:])
        w = s[k:] - s[: len(v) - k + 1]
        out[a:b] = mix(w * _powers(len(v), _inverse(base))[: len(w)])
    return out


def unique_pairs(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, key) in that order, and how often each occurs. text must not decrease."""
    if not len(key):
        return text[:0], key[:0], np.empty(0, np.int64)
    order = np.lexsort((key, text))
    t, k = text[order], key[order]
    new = np.empty(len(k), bool)
    new[0] = True
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return t[at], k[at], np.diff(np.append(at, len(k)))
