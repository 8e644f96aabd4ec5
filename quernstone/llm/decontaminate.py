"""Benchmark decontamination by one Aho-Corasick automaton over normalised questions and answers.

A text is normalised to its words (runs of letters and digits, lower case); the automaton's alphabet is the words of
the benchmark, so a word outside it separates. Each item of at least ``ngram`` words gives all its runs of ``ngram``
words as patterns, a shorter one, down to ``min_words``, gives itself whole; still shorter items prove nothing: too_short
reports them. Each text is scanned once. Hits of one item that overlap or touch are joined, and their word positions are
mapped to character offsets of the original text.

The patterns are broadcast: they grow with the benchmark, never with the corpus, and their size is checked. A benchmark
of more than MAX_CHARS characters is cut into parts by a hash of its items, and each part's automaton scans the texts.
Defined cases: null, empty or wordless texts and items match nothing; a null doc_id is reported as null; repeated
documents are each reported; an item repeated under two ids is reported under both; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, words

NGRAM, MIN_WORDS = 8, 5
#: Of one automaton: 4 million characters (544,098 patterns) took 0.18 GB of the driver and 0.27 GB of a worker.
MAX_CHARS = 4_000_000
SCHEMA = "doc_id long, item_id long, start long, end long, n_words long"


@dataclass
class Patterns:
    """alphabet: sorted hashes of words. groups: (words, [patterns, words] letters, bounds into items, items) by length."""

    alphabet: np.ndarray
    groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]
    ids: list[int | None]
    key: int


def _rows(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")


def _parts(items: DataFrame) -> list[DataFrame]:
    """The items, in as many parts as their characters ask for."""
    rows = _rows(items).distinct()
    n = -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // MAX_CHARS)
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [rows]


def too_short(items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(item_id, n_words) of the items that have too few words to be looked for."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        n = np.concatenate([np.bincount(words.words(c, o)[0], minlength=hi - lo) for lo, hi, c, o in words.layouts(b.column("text"))])
        few = pa.array(np.flatnonzero(n < min_words))
        return pa.RecordBatch.from_arrays([b.column("item_id").take(few), pa.array(n.astype(np.int64)).take(few)], ["item_id", "n_words"])

    return common.each_batch(_rows(items), batch, "item_id long, n_words long")


def patterns(rows: DataFrame, ngram: int = NGRAM, min_words: int = MIN_WORDS) -> Patterns:
    """The patterns of one part of the items."""
    table = rows.toArrow()  # MAX_CHARS characters, on average of the parts
    ids = table["item_id"].to_pylist()
    found: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
    for lo, hi, cps, offs in words.layouts(table["text"]):
        text, _, _, h = words.words(cps, offs)
        count = np.bincount(text, minlength=hi - lo)
        for n in sorted({min(ngram, int(c)) for c in count.tolist() if c >= min_words}):
            whole = (count == n) if n < ngram else (count >= n)
            at = np.flatnonzero((text[: len(h) - n + 1] == text[n - 1 :]) & whole[text[: len(h) - n + 1]])
            grams, of = found.setdefault(n, ([], []))
            grams.append(np.lib.stride_tricks.sliding_window_view(h, n)[at])
            of.append(lo + text[at])
    alphabet = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.unique(g) for grams, _ in found.values() for g in grams)]))
    groups = []
    for n, (grams, of) in found.items():
        letters = np.searchsorted(alphabet, np.concatenate(grams)).astype(np.int32)
        keys, inverse = np.unique(letters, axis=0, return_inverse=True)
        pair = np.unique((inverse.ravel().astype(np.int64) << 32) | np.concatenate(of))
        groups.append((n, keys, np.searchsorted(pair >> 32, np.arange(len(keys) + 1)), pair & 0xFFFFFFFF))
    return Patterns(alphabet, groups, ids, uuid.uuid4().int)


_built: dict[int, object] = {}


def _automaton(p: Patterns):
    """Built once in each worker."""
    if p.key not in _built:
        import ahocorasick

        a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for n, keys, at, items in p.groups:
            for i, seq in enumerate(keys):
                a.add_word(tuple(seq.tolist()), (n, items[at[i] : at[i + 1]].tolist()))
        a.make_automaton()
        _built.clear()
        _built[p.key] = a
    return _built[p.key]


def scan(col: pa.Array, p: Patterns) -> list[tuple[int, int | None, int, int, int]]:
    """(row, item id, start, end, words) of every joined hit in a column of texts."""
    out: list[tuple[int, int | None, int, int, int]] = []
    if not p.groups:
        return out
    automaton, least, alphabet = _automaton(p), min(n for n, *_ in p.groups), p.alphabet
    for lo, _, cps, offs in words.layouts(col):
        text, start, end, h = words.words(cps, offs)
        if len(h) < least:
            continue
        at = np.minimum(np.searchsorted(alphabet, h), len(alphabet) - 1)
        known = alphabet[at] == h
        new = np.flatnonzero(np.diff(text)) + 1
        a, b = words.runs(known, np.concatenate([[0], new, [len(h)]]))
        for i, j in zip(a[b - a >= least].tolist(), b[b - a >= least].tolist(), strict=True):
            spans: dict = {}
            for last, (n, ids) in automaton.iter(tuple(at[i:j].tolist())):
                for item in ids:
                    had = spans.setdefault(item, [])
                    if had and last - n + 1 <= had[-1][1]:
                        had[-1][0], had[-1][1] = min(had[-1][0], last - n + 1), last + 1
                    else:
                        had.append([last - n + 1, last + 1])
            row, base = int(text[i]), int(offs[text[i]])
            for item, had in spans.items():
                out += [(lo + row, p.ids[item], int(start[i + x]) - base, int(end[i + y - 1]) - base, y - x) for x, y in had]
    return out


def matches(docs: DataFrame, items: DataFrame, ngram: int = NGRAM, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each passage of a benchmark item in a document; start and end are character offsets of its text."""

    def of(part: DataFrame) -> DataFrame:
        bc = docs.sparkSession.sparkContext.broadcast(patterns(part, ngram, min_words))

        def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
            found = scan(b.column("text"), bc.value)
            if not found:
                return None
            row, item, start, end, n = (pa.array(x, pa.int64()) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([b.column("doc_id").take(row), item, start, end, n], ["doc_id", "item_id", "start", "end", "n_words"])

        return common.each_batch(common.text_of(docs), batch, SCHEMA)

    return reduce(DataFrame.unionByName, map(of, _parts(items)))


def drop_contaminated(docs: DataFrame, items: DataFrame, ngram: int = NGRAM, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, with all their columns, in which no benchmark item is found. No join and no shuffle."""
    for part in _parts(items):
        docs = _without(docs, docs.sparkSession.sparkContext.broadcast(patterns(part, ngram, min_words)))
    return docs


def _without(docs: DataFrame, bc) -> DataFrame:
    def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = np.ones(b.num_rows, bool)
        keep[[x[0] for x in scan(b.column("text"), bc.value)]] = False
        return b.filter(pa.array(keep)) if keep.any() else None

    return common.each_batch(docs, batch, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws, string_split_regex(text, '[\p{L}\p{N}]+') AS sp FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark),
i AS (SELECT item_id, ws, least(8, len(ws)) AS n FROM b WHERE len(ws) >= 5),
ig AS (SELECT DISTINCT item_id, n, unnest(list_transform(generate_series(1, len(ws) - n + 1), lambda k: array_to_string(ws[k:k + n - 1], ' '))) AS g FROM i),
dl AS (SELECT doc_id, n, list_transform(generate_series(1, len(ws) - n + 1), lambda k: array_to_string(ws[k:k + n - 1], ' ')) AS gs FROM d, (SELECT DISTINCT n FROM i) WHERE len(ws) >= n),
dg AS (SELECT doc_id, n, generate_subscripts(gs, 1) AS p, unnest(gs) AS g FROM dl),
hit AS (SELECT doc_id, item_id, p - 1 AS a, p - 1 + n AS z FROM dg JOIN ig USING (n, g)),
br AS (SELECT *, CASE WHEN a <= lag(z) OVER (PARTITION BY doc_id, item_id ORDER BY a) THEN 0 ELSE 1 END AS b FROM hit),
gr AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, item_id ORDER BY a) AS g FROM br),
s AS (SELECT doc_id, item_id, min(a) AS a, max(z) AS z FROM gr GROUP BY doc_id, item_id, g)
SELECT doc_id, item_id,
  CAST(list_sum(list_transform(sp[1:a + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:a], lambda x: length(x))), 0) AS BIGINT) AS "start",
  CAST(list_sum(list_transform(sp[1:z], lambda x: length(x))) + list_sum(list_transform(ws[1:z], lambda x: length(x))) AS BIGINT) AS "end", CAST(z - a AS BIGINT) AS n_words
FROM s JOIN d USING (doc_id)
"""
