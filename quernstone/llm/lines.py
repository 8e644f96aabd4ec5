"""Near-duplicate lines by a segment-partition edit join.

Lines, stripped of white space at their ends, are joined at an edit distance that grows with their length: a pair may
differ by one edit for every ``per_edit`` characters of the shorter line, and by ``distance`` at most; a line too short
for an edit is joined to its equals alone. A line that may differ by d edits is cut into d + 1 segments, each indexed
under (length, number, text); every line probes the indexes of its own length and of those shorter by up to d with just
the substrings whose place allows the remaining edits on either side. Lines that meet under a segment are verified by a
banded bit-parallel edit distance. Of each connected group of lines the first occurrence, by (doc_id, line number), stays.

At scale: a line is known by 128 bits of hash; only (key, line) rows meet in the segment shuffle; a bucket gives one pair
a member (its leader), and then the pairs whose lines aren't connected already (see graph.star_edges: none is missed, so
many unrelated lines that share a segment take comparisons by the square of their number). The texts of lines that meet
another under a segment are read once, from one of the documents that have each, and kept; all rounds verify from those.

Defined cases: blank lines are left alone; null and empty texts have no lines; a null doc_id orders after all others;
rows equal in doc_id and text are one document; ties are broken by a hash of the text. The filter removes lines, keeps
the rest of a text as it is, drops a document all of whose text went, and sets n_chars where the column exists; other
columns, whatever their names, stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from . import common, graph

DISTANCE, PER_EDIT, SALT = 2, 16, 20_000
_ONE = np.uint64(1)


def lines_of(text: str | None) -> Iterator[tuple[int, str]]:
    """(number, stripped line) of the lines that aren't blank."""
    return ((n, s) for n, raw in enumerate((text or "").split("\n")) if (s := raw.strip()))


def line_hashes(lines: list[str]) -> np.ndarray:
    """[lines, 2]: 128 bits of hash of each."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.int64).reshape(-1, 2)


def allowed(length, distance: int, per_edit: int):
    """Edits that a pair whose shorter line has the length may differ by."""
    return np.minimum(distance, length // per_edit)


def segment_places(n: int, distance: int, per_edit: int) -> list[tuple[int, int, int, bool]]:
    """(seed, start, end, whether it is the line's own index entry) of all entries and probes of a line of n characters."""
    out = []
    for length in range(n, max(n - distance, 0) - 1, -1):
        delta, d = n - length, int(allowed(length, distance, per_edit))
        if d == 0 or delta > d:
            continue
        short, extra = divmod(length, d + 1)
        for i in range(d + 1):
            p, size = i * short + max(0, i - (d + 1 - extra)), short + (i >= d + 1 - extra)
            for at in range(max(p - i, p + delta - (d - i), 0), min(p + i, p + delta + (d - i), n - size) + 1):
                out.append((length * (distance + 1) + i, at, at + size, delta == 0 and at == p))
    return out


def within(chars: np.ndarray, a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray, k: int) -> np.ndarray:
    """Edit distances of chars[a:a + an] and chars[b:b + bn], or k + 1 for more than k, of many pairs at once.

    The band of 2k + 1 diagonals is a word of bits, with its vertical differences as two bit vectors; a step takes one
    character of the shorter text. k is at most 31.
    """
    swap = an < bn
    a, b, an, bn = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, bn, an), np.where(swap, an, bn)
    out = np.full(len(a), k + 1, np.int64)
    live = np.flatnonzero(an - bn <= k)
    short = live[an[live] <= k]
    for x in short.tolist():
        out[x] = min(_plain(chars[a[x] : a[x] + an[x]], chars[b[x] : b[x] + bn[x]]), k + 1)
    live = live[an[live] > k]
    vp = np.full(len(live), (2**64 - 1 << (63 - k)) & (2**64 - 1), np.uint64)
    vn, dist = np.zeros(len(live), np.uint64), np.full(len(live), k, np.int64)
    top, last, step = np.uint64(63), len(chars) - 1, 0
    while len(live):
        ended = bn[live] <= step
        if ended.any():
            out[live[ended]] = np.minimum(dist[ended], k + 1)
        go = ~ended & (dist <= 2 * k + bn[live] - an[live] + k)
        if not go.all():
            live, vp, vn, dist = live[go], vp[go], vn[go], dist[go]
            if not len(live):
                break
        c = chars[b[live] + step]
        x = np.zeros(len(live), np.uint64)
        for d in range(-k, k + 1):
            at = step + d
            if at >= 0:
                hit = (at < an[live]) & (chars[np.minimum(a[live] + at, last)] == c)
                x |= hit.astype(np.uint64) << np.uint64(63 + d - k)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        slope = step < an[live] - k
        down = np.uint64(62) - np.where(slope, 0, step - (an[live] - k)).astype(np.uint64)
        dist = dist + np.where(slope, 1 - ((d0 >> top) & _ONE).astype(np.int64), ((hp >> down) & _ONE).astype(np.int64) - ((hn >> down) & _ONE).astype(np.int64))
        vp, vn = hn | ~((d0 >> _ONE) | hp), (d0 >> _ONE) & hp
        step += 1
    return out


def _plain(x: np.ndarray, y: np.ndarray) -> int:
    row = list(range(len(y) + 1))
    for i, c in enumerate(x.tolist(), 1):
        old, row[0] = row[0], i
        for j, d in enumerate(y.tolist(), 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (c != d))
    return row[-1]


def _occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, line, v) of every line."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, numbers, lines = [], [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            for n, s in lines_of(text):
                rows.append(i)
                numbers.append(n)
                lines.append(s)
        if not rows:
            return None
        h, take = line_hashes(lines), pa.array(rows)
        return pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("doc_id", "k1", "k2")), pa.array(numbers, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", "k1", "k2", "line", "a", "b"])

    rows = common.each_batch(common.text_of(docs).select("doc_id", "text", *common.keys()), batch, "doc_id long, k1 long, k2 long, line int, a long, b long")
    return rows.select("doc_id", "k1", "k2", "line", F.struct("a", "b").alias("v"))


def _members(docs: DataFrame, distance: int, per_edit: int) -> DataFrame:
    """(bucket, v) of the lines that meet another under a segment."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, list[tuple[int, int, int, bool]]] = {}
        key = xxhash.xxh3_64_intdigest
        for b in batches:
            lines = sorted({s for text in b.column("text").to_pylist() for _, s in lines_of(text) if len(s) >= per_edit})
            keys, own, counts = [], [], []
            for s in lines:
                n = len(s)
                if n not in places:
                    places[n] = segment_places(n, distance, per_edit)
                keys += [key(s[x:y], seed) for seed, x, y, _ in places[n]]
                own += [o for _, _, _, o in places[n]]
                counts.append(len(places[n]))
            if keys:
                h = np.repeat(line_hashes(lines), counts, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(own)], ["bucket", "a", "b", "own"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.whole_groups(batches, "bucket", 1 << 17):
            key, a, b, own = t["bucket"].to_numpy(), t["a"].to_numpy(), t["b"].to_numpy(), t["own"].to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            many = np.logical_or.reduceat(own, first)
            many &= (np.minimum.reduceat(a, first) != np.maximum.reduceat(a, first)) | (np.minimum.reduceat(b, first) != np.maximum.reduceat(b, first))
            use = np.flatnonzero(np.repeat(many, np.diff(np.append(first, len(key)))))
            if len(use):
                key, a, b = key[use], a[use], b[use]
                order = np.lexsort((b, a, key))
                key, a, b = key[order], a[order], b[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(a[new]), pa.array(b[new])], ["bucket", "a", "b"])

    rows = common.map_arrow(common.text_of(docs).select("text"), batches_of, "bucket long, a long, b long, own boolean")
    met = common.map_arrow(rows.repartition("bucket").sortWithinPartitions("bucket"), meet, "bucket long, a long, b long")
    return met.select("bucket", F.struct("a", "b").alias("v"))


def _texts(docs: DataFrame, occurrences: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, text) of the wanted lines, each from one of the documents that have it."""
    place = occurrences.join(common.small(wanted, 32), "v", "left_semi").groupBy("v").agg(F.min(F.struct("k1", "k2", "line")).alias("p"))
    asked = common.checkpoint(place.groupBy(F.col("p.k1").alias("_k1"), F.col("p.k2").alias("_k2")).agg(F.collect_set("p.line").alias("asked")))
    rows = common.text_of(docs).select("text", *common.keys()).join(common.small(asked, 256), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        lines = []
        for text, asked in zip(b.column("text").to_pylist(), b.column("asked").to_pylist(), strict=True):
            parts = text.split("\n")
            lines += [parts[i].strip() for i in asked]
        h = line_hashes(lines)
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(lines, pa.string())], ["a", "b", "text"])

    return common.each_batch(rows.select("text", "asked"), batch, "a long, b long, text string").dropDuplicates(["a", "b"]).select(F.struct("a", "b").alias("v"), "text")


def _verify(texts: DataFrame, pairs: DataFrame, distance: int, per_edit: int) -> DataFrame:
    """The pairs (v, u) of lines within the distance allowed, with 1 - distance / length as similarity."""
    size = pairs.groupBy("u").count().select("u", F.ceil(F.col("count") / SALT).alias("salts"))
    leaders = size.select(F.col("u").alias("v"), "u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("ord"))
    wanted = leaders.unionByName(pairs.join(size, "u").select("v", "u", F.pmod("v.a", "salts").alias("salt"), F.lit(1).alias("ord")))
    sent = texts.join(wanted, "v").select(F.col("v.a").alias("a1"), F.col("v.b").alias("b1"), F.col("u.a").alias("a2"), F.col("u.b").alias("b2"), "salt", "ord", "text")
    sent = sent.repartition("a2", "b2", "salt").sortWithinPartitions("a2", "b2", "salt", "ord")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, chars = None, np.empty(0, np.uint32)
        for b in batches:
            own, ord_ = list(zip(*(b.column(c).to_pylist() for c in ("a2", "b2", "salt")), strict=True)), b.column("ord").to_pylist()
            text = b.column("text").to_pylist()
            parts, rows, at, known = [], [], 0, None
            x, xn, y, yn = [], [], [], []
            if lead is not None:
                parts.append(chars)
                known, at = (0, len(chars)), len(chars)
            for i, t in enumerate(text):
                c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                if ord_[i] == 0:
                    lead, chars, known = own[i], c, (at, len(c))
                elif lead == own[i]:
                    rows.append(i)
                    x.append(known[0])
                    xn.append(known[1])
                    y.append(at)
                    yn.append(len(c))
                parts.append(c)
                at += len(c)
            if not rows:
                continue
            x, xn, y, yn = (np.array(z) for z in (x, xn, y, yn))
            found = within(np.concatenate(parts), x, xn, y, yn, distance)
            ok = np.flatnonzero(found <= allowed(np.minimum(xn, yn), distance, per_edit))
            if len(ok):
                take = pa.array(np.array(rows)[ok])
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("a1", "b1", "a2", "b2")), pa.array(1 - found[ok] / np.maximum(xn, yn)[ok])], ["a1", "b1", "a2", "b2", "similarity"])

    near = common.map_arrow(sent, compare, "a1 long, b1 long, a2 long, b2 long, similarity double")
    return near.select(F.struct(F.col("a1").alias("a"), F.col("b1").alias("b")).alias("v"), F.struct(F.col("a2").alias("a"), F.col("b2").alias("b")).alias("u"), "similarity")


def repeated(docs: DataFrame, distance: int = DISTANCE, per_edit: int = PER_EDIT) -> DataFrame:
    """(doc_id, k1, k2, line, first_doc_id, first_line) of each line that an earlier one stands for; lines count from 0."""
    if not 0 <= distance <= 31 or per_edit < 2:
        raise ValueError("distance must be from 0 to 31, and per_edit at least 2")
    found = common.checkpoint(_occurrences(docs))
    if distance:
        members = common.checkpoint(_members(docs, distance, per_edit))
        texts = common.checkpoint(_texts(docs, found, common.checkpoint(members.select("v").distinct())))
        edges = graph.star_edges(members, lambda pairs: _verify(texts, pairs, distance, per_edit))
        label = common.checkpoint(graph.components(edges.select(F.col("v").alias("a"), F.col("u").alias("b"))))
        found = found.join(common.small(label, 48), "v", "left").withColumn("g", F.coalesce("label", "v"))
    else:
        found = found.withColumn("g", F.col("v"))
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2", "line")
    found = found.withColumn("place", place)
    firsts = found.groupBy("g").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1").select(F.col("g").alias("_g"), "first")
    found = found.join(firsts, F.col("g") == F.col("_g")).where("place <> first")
    return found.select("doc_id", "k1", "k2", "line", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line").alias("first_line"))


@F.arrow_udf(StringType())
def _without(text: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts without their lines of the given numbers."""
    out = []
    for t, g in zip(text.to_pylist(), gone.to_pylist(), strict=True):
        drop = set(g or ())
        out.append(None if t is None else "\n".join(line for i, line in enumerate(t.split("\n")) if i not in drop))
    return pa.array(out, pa.string())


def drop_repeated_lines(docs: DataFrame, **parameters) -> DataFrame:
    """The documents, with all their columns, without the lines that an earlier one stands for."""
    gone = repeated(docs, **parameters).groupBy("k1", "k2").agg(F.collect_set("line").alias("gone")).withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    rows = common.one_of_equal(common.keyed(docs).join(gone, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left"))
    touched = F.col("gone").isNotNull()
    rows = rows.withColumn("_cut", _without(F.when(touched, F.col("d.text").cast("string")), F.col("gone")))
    rows = rows.where(F.col("gone").isNull() | (F.regexp_replace("_cut", r"(?U)\s+", "") != ""))
    cols: list[Column] = []
    for c in docs.columns:
        own = F.col(f"d.`{c}`")
        if c == "text":
            own = F.when(touched, F.col("_cut")).otherwise(own)
        elif c == "n_chars":
            text = F.when(touched, F.col("_cut")).otherwise(F.col("d.text").cast("string"))
            own = F.length(text).cast(docs.schema[c].dataType)
        cols.append(own.alias(c))
    return rows.select(*cols)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the documents that repeat an earlier one, exactly or nearly."""
    return repeated(common.table(spark, sf_dir, "documents")).select("doc_id", "line", "first_doc_id", "first_line")
