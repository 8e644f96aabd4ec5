"""Stems of texts in Arrow passes: what text.semantic_tokens and text.stem give, for whole batches.

A batch's words are found by their code points, and only the distinct ones are cut and stemmed.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are looked at together; arrays of some 40 times this size are held.
PIECE = 1 << 20


@lru_cache(1)
def _in_words() -> np.ndarray:
    """Whether a code point is a letter, a digit, _ or the mark of a break."""
    out = np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)), bool, 0x110000)
    out[[0x5F, 0x01]] = True
    return out


def tokens(word: str) -> list[str]:
    """The parts of a word, cut at _ and at changes of case, then the word, in lower case; none of one byte."""
    if not word.islower():
        ends = [i for i in range(1, len(word)) if word[i].isupper() and (word[i - 1].islower() or unicodedata.category(word[i - 1])[0] == "N")]
        word = "\x01".join(word[a:b] for a, b in zip([0, *ends], [*ends, len(word)], strict=True))
    low = word.lower()
    cut = [*low.replace("_", "\x01").split("\x01"), low.replace("\x01", "")] if "_" in low or "\x01" in low else [low, low]
    return [t for t in cut if len(t.encode()) >= 2]


def stem(word: str) -> str:
    n = len(word.encode())
    for suffix, least in (("ing", 4), ("ed", 3), ("es", 3), ("s", 4)):
        if word.endswith(suffix) and n >= least:
            return word[: -len(suffix)]
    return word


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each word, the words)."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()
    try:
        parts = [t.decode() for t in raw]
    except UnicodeDecodeError:
        parts = [t.decode(errors="replace") for t in raw]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    inside = _in_words()[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[ends] = True
    start = np.flatnonzero(inside & ~(np.concatenate([[False], inside[:-1]]) & ~edge[:-1]))
    end = np.flatnonzero(inside & ~(np.concatenate([inside[1:], [False]]) & ~edge[1:])) + 1
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    data = np.frombuffer("".join(parts).encode("utf-8", "surrogatepass"), np.uint8)
    size = at[end] - at[start]
    bounds = np.concatenate([[0], np.cumsum(size)])
    kept = np.repeat(inside, width)
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data[kept])])
    return np.searchsorted(ends, start, "right"), words


def stems(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, term) of every stem of the texts, in order, term a place in the list of distinct stems that comes third."""
    row, words = _words(texts)
    coded = words.dictionary_encode()
    places: dict[str, int] = {}
    ids: list[int] = []
    counts = []
    for w in coded.dictionary.to_pylist():
        own = [places.setdefault(stem(t), len(places)) for t in tokens(w)]
        ids += own
        counts.append(len(own))
    n, ids = np.array(counts, np.int64), np.array(ids, np.int64)
    code = coded.indices.to_numpy()
    each = n[code]
    begin = np.concatenate([[0], np.cumsum(n)])[:-1][code] if len(n) else np.empty(0, np.int64)
    of = np.concatenate([[0], np.cumsum(each)])
    return np.repeat(row, each), ids[np.repeat(begin - of[:-1], each) + np.arange(of[-1])], list(places)
