"""Trigrams of bytes: extraction, plans from patterns, and the table of postings.

A plan is an AND of alternatives, each an OR of AND-groups of trigrams (six hex digits). It may only widen the set of
documents. A scan with contains or rlike is already right; the table, which an index keeps in order of trigram, is an
accelerator. In it a trigram is an integer, its three bytes from high to low.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .. import shared
from . import regexlang

Plan = list[list[list[str]]]
RAREST = 4
#: Bytes of texts that are looked at together; arrays of some 50 times this size are held.
_BYTES = 1 << 20
#: Trigrams of a plan that one number has room for.
_BITS = 32


def of(data: bytes) -> list[str]:
    return sorted({data[i : i + 3].hex() for i in range(len(data) - 2)})


def number(gram: str) -> int:
    return int(gram, 16)


def name(tri: Column) -> Column:
    """Six hex digits of a trigram of the table."""
    return F.lower(F.lpad(F.hex(tri), 6, "0"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tri) of the distinct trigrams of each text of (doc_id, text), in order, a few MB of text at a time."""
    for b in batches:
        if not b.num_rows:
            continue
        col = pc.fill_null(b.column("text"), "")
        offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + _BYTES, "right")) - 1)
            x = data[offs[lo] : offs[hi]].astype(np.int64)
            if len(x) >= 3:
                row = np.repeat(np.arange(hi - lo), np.diff(offs[lo : hi + 1]))
                key = (row[:-2] << 24) | (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
                key = np.unique(key[row[:-2] == row[2:]])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(lo + (key >> 24))), pa.array((key & 0xFFFFFF).astype(np.int32))], ["doc_id", "tri"])
            lo = hi


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, trigrams): the distinct trigrams of each text, in order; an empty list for a text of under three bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.pieces(batches, "text", _BYTES):
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column("text")], ["doc_id", "text"])
            parts = list(_pairs(iter([numbered])))
            row = np.concatenate([p.column(0).to_numpy() for p in parts]) if parts else np.empty(0, np.int64)
            tri = np.concatenate([p.column(1).to_numpy() for p in parts]) if parts else np.empty(0, np.int32)
            offs = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offs), pa.array(tri))], ["doc_id", "tris"])

    found = shared.map_arrow(docs.select("doc_id", "text"), run, "doc_id long, tris array<int>")
    return found.select("doc_id", F.transform("tris", name).alias("trigrams"))


def literal_plan(needle: str) -> Plan:
    grams = of(needle.encode())
    return [[grams]] if grams else []


def ignore_case_plan(needle: str) -> Plan:
    """One alternative for each window of three ASCII bytes, over its cases; k and s fold with letters outside of ASCII."""
    data, out = needle.encode(), []
    for i in range(len(data) - 2):
        w = data[i : i + 3]
        if any(b >= 128 or chr(b) in "kKsS" for b in w):
            continue
        cases = [sorted({ord(chr(b).lower()), ord(chr(b).upper())}) for b in w]
        out.append([[bytes(c).hex()] for c in product(*cases)])
    return out


def regex_plan(pattern: str, ignore_case: bool = False) -> Plan:
    found = regexlang.required_literals(pattern)
    plans = [p for x in found for p in (ignore_case_plan(x) if ignore_case else literal_plan(x))]
    return [p for i, p in enumerate(plans) if p not in plans[:i]]


def postings(docs: DataFrame, only: Plan | None = None) -> DataFrame:
    """(tri, doc_id): written in order of tri, row-group statistics are the dictionary of terms. only: those of a plan's trigrams."""
    kept = None if only is None else np.array(wanted(only), np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pairs(batches):
            yield b if kept is None else b.filter(pa.array(np.isin(b.column("tri").to_numpy(), kept)))

    return shared.map_arrow(docs.select("doc_id", "text"), run, "doc_id long, tri int").select("tri", "doc_id")


def stats(posts: DataFrame) -> DataFrame:
    """(tri, df)."""
    return posts.groupBy("tri").agg(F.count("*").alias("df"))


def merge(tables: list[DataFrame], live: DataFrame) -> DataFrame:
    """Postings of several tables, of live documents only."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.join(live.select("doc_id"), "doc_id", "left_semi").distinct().select("tri", "doc_id")


def wanted(plan: Plan) -> list[int]:
    """The trigrams of a plan."""
    return sorted({number(g) for alternatives in plan for grams in alternatives for g in grams})


def candidates(posts: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """Documents that the plan admits; all of docs for an empty plan. Of a group's trigrams the rarest four are asked for.

    The postings are read once: those of the plan's trigrams are kept, counted, and met by document as bits.
    """
    if not plan:
        return docs
    held = shared.checkpoint(posts.where(F.col("tri").isin(wanted(plan))).select("tri", "doc_id"))
    frequencies = {f"{r.tri:06x}": r.df for r in stats(held).collect()}  # a row for each trigram of the plan
    rarest = [[[number(g) for g in sorted(grams, key=lambda g: (frequencies[g], g))[:RAREST]] for grams in alternatives if grams and all(g in frequencies for g in grams)] for alternatives in plan]
    if not all(rarest):  # of some part no alternative is in the index
        return docs.limit(0)
    bit = {t: i for i, t in enumerate(sorted({t for alternatives in rarest for grams in alternatives for t in grams}))}
    blocks = range(-(-len(bit) // _BITS))

    def mask(grams: list[int], block: int) -> int:
        return sum(1 << bit[t] % _BITS for t in set(grams) if bit[t] // _BITS == block)

    def bits_of(block: int) -> Column:
        out = F.lit(0).cast("long")
        for t, i in bit.items():
            if i // _BITS == block:
                out = F.when(F.col("tri") == t, F.lit(1 << i % _BITS).cast("long")).otherwise(out)
        return out

    met = held.where(F.col("tri").isin(list(bit))).groupBy("doc_id").agg(*[F.bit_or(bits_of(k)).alias(f"b{k}") for k in blocks])
    for alternatives in rarest:
        fits = F.lit(False)
        for grams in alternatives:
            every = F.lit(True)
            for k in blocks:
                if m := mask(grams, k):
                    every = every & (F.col(f"b{k}").bitwiseAND(F.lit(m).cast("long")) == m)
            fits = fits | every
        met = met.where(fits)
    return docs.join(met.select("doc_id"), "doc_id", "left_semi")
