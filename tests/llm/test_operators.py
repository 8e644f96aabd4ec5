"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd inputs."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quernstone.llm import decontaminate, fertility, graph, lines, minhash, packing, quality, suffixes, token_orc, tokens, toxicity, warc, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [a + b for a in ("ba", "ke", "mi", "to", "ru", "sal", "ven", "dor") for b in ("lin", "ta", "gor", "pe", "shu", "ril", "no", "xa", "um", "est")]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def rows(texts, start=0):
    return [(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(60, 160)) for _ in range(60)]
    near = []
    for t in texts[:12]:
        w = t.split()
        for _ in range(2):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        near.append(" ".join(w))
    shared = prose(rng, 60)
    texts += near + texts[5:9] + [prose(rng, 40) + " " + shared + " " + prose(rng, 30) for _ in range(4)]
    return rows(texts)


ODD = rows([None, "", " ", "\n\n", "!!! ###", "a", "Ab ab AB ab", "é" * 50, "x " * 3000, "line one of this text is long enough\n\nline two\n", "line one of this text is long enough\n\nline two\n", "퟿ \U0001f600 İı"]) + [(None, "null id here and here", None, None, None), (3, "same id again", "xx", "s", 1), (3, "same id again", "xx", "s", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "q", True) for r in ODD], DOCS + ", row int, bucket string, keep boolean")


def word_list(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


# 1 packing


def check_windows(pdf, counts, window):
    assert (pdf.groupby("window_id")["length"].sum() <= window).all()
    pdf = pdf.sort_values(["window_id", "offset"])
    nxt = pdf.groupby("window_id")["offset"].shift(-1).fillna(window)
    assert (pdf["offset"] + pdf["length"] <= nxt).all()
    assert pdf["length"].sum() == sum(counts)


def test_packing_places_every_token_once(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS)
    counts = {r[0]: r[1] for r in packing.lengths(docs).collect()}
    pdf = packing.pack(docs, window=128, grain=8).toPandas()
    check_windows(pdf, counts.values(), 128)
    for doc, own in pdf.groupby("doc_id"):
        own = own.sort_values("start")
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()][:-1] and own["length"].sum() == counts[doc]


def test_packing_odd_and_empty(spark, odd):
    counts = [r[1] for r in packing.lengths(odd).collect()]
    check_windows(packing.pack(odd, window=64, grain=8).toPandas(), counts, 64)
    assert packing.pack(odd.limit(0)).count() == 0


def test_best_fit_equals_piece_by_piece():
    g = np.random.default_rng(8)
    for case in range(30):
        window = int(g.integers(8, 200))
        sizes = np.sort(g.integers(1, window + 1, g.integers(0, 300)))[::-1].tolist()
        rooms: list[int] = []  # one piece after the other, each to the least room that it fits
        for x in sizes:
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms[rooms.index(min(fits))] -= x
            else:
                rooms.append(window - x)
        counts = collections.Counter(sizes)
        plan = packing.best_fit(dict(counts), window)
        held, seen = collections.defaultdict(list), collections.Counter()
        for length, lo, hi, each, first, slot, offset in plan:
            for r in range(lo, hi):
                seen[length, r] += 1
                held[first + (r - lo) // each].append((offset + (r - lo) % each * length, length, slot + (r - lo) % each))
        assert seen == collections.Counter((x, r) for x, n in counts.items() for r in range(n))
        for own in held.values():
            own.sort()
            assert [x[2] for x in own] == list(range(len(own))) and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and own[0][0] == 0 and own[-1][0] + own[-1][1] <= window
        assert sorted(window - sum(x[1] for x in own) for own in held.values()) == sorted(rooms)


def test_packing_equals_a_plain_version(spark, corpus):
    # the same plan, carried out on lists
    docs, window, grain = spark.createDataFrame(corpus, DOCS), 128, 8
    counts = [r[1] for r in packing.lengths(docs).collect() if r[1]]
    rests = [n % window for n in counts if n % window]
    bins = collections.Counter(-(-x // grain) for x in rests)
    plan = packing.solve(np.array([bins[b] for b in range(1, window // grain + 1)]), packing.DEPTH)
    pdf = packing.pack(docs, window=window, grain=grain).toPandas()
    kinds = collections.Counter(w[0] for w in pdf["window_id"].drop_duplicates())
    assert kinds["f"] == sum(n // window for n in counts) and kinds["c"] == sum(n for _, n in plan)
    got = collections.Counter(tuple(sorted(-(-x // grain) for x in own["length"])) for w, own in pdf.groupby("window_id") if w[0] == "c")
    assert got == collections.Counter({tuple(sorted(c)): n for c, n in plan})
    left = collections.Counter(pdf[pdf["window_id"].str.startswith("r")]["length"].tolist())
    assert kinds["r"] == len({first + i for _, lo, hi, each, first, _, _ in packing.best_fit(dict(left), window) for i in range(-(-(hi - lo) // each))})
    assert sum(bins.values()) - sum(n * len(c) for c, n in plan) == sum(left.values())


def test_combinations_are_all_that_fill():
    got = set(packing.combinations(12, 3))
    want = {(12,)} | {(a, 12 - a) for a in range(1, 7)} | {tuple(sorted((a, b, 12 - a - b))) for a in range(1, 13) for b in range(1, 12 - a)}
    assert got == {c for c in want if sum(c) == 12 and min(c) > 0}


def test_nnls_meets_the_optimality_conditions():
    g = np.random.default_rng(1)
    for _ in range(10):
        a, h = g.random((8, 20)), g.random(8)
        x = packing.nnls(a, h)
        grad = a.T @ (h - a @ x)
        assert (x >= 0).all() and (grad < 1e-6).all() and np.allclose(grad[x > 1e-9], 0, atol=1e-6)


def test_packing_uses_the_windows_well():
    g = np.random.default_rng(2)
    h = np.bincount(g.integers(1, 64, 20_000), minlength=65)[1:]
    plan = packing.solve(h, 3)
    used = np.zeros(64, int)
    for c, n in plan:
        for b in c:
            used[b - 1] += n
    assert (used <= h).all() and sum(n for _, n in plan) * 64 > 0.9 * (h * np.arange(1, 65)).sum()


# 2 archive


def test_archive_round_trip(spark, tmp_path):
    raw = [(1, b"WARC/1.0\r\nContent-Length: 5\r\nX: y\r\n\r\nhello\r\n\r\n"), (2, b"WARC/1.0\r\ncontent-length: 5\r\n\r\nhello"), (3, b"no header"), (4, b""), (None, b"WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), (2, b"WARC/1.0\r\ncontent-length: 5\r\n\r\nhello"), (5, bytes(range(256)))]
    df = spark.createDataFrame(raw, "record_id long, raw binary")
    warc.write(warc.records_of_raw(df), str(tmp_path / "a"))
    back = warc.read(spark, str(tmp_path / "a")).collect()
    assert collections.Counter((r.record_id, bytes(r.record)) for r in back) == collections.Counter(raw)
    stored = spark.read.parquet(str(tmp_path / "a" / "payloads"))
    assert stored.count() == stored.select("digest").distinct().count() == 2


def test_archive_of_files(spark, tmp_path):
    import gzip

    records = [b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(p), p) for p in (b"hello", b"a\r\n\r\nWARC/1.0\r\n\r\nb", b"", bytes(range(256)) * 20)]
    assert list(warc.split_file(b"".join(records))) == records and list(warc.split_file(b"")) == []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "in" / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records[:2])))
    warc.write(warc.records_of_files(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    back = [bytes(r.record) for r in warc.read(spark, str(tmp_path / "out")).collect()]
    assert collections.Counter(back) == collections.Counter(records + records[:2])
    assert spark.read.parquet(str(tmp_path / "out" / "payloads")).count() == 4


def test_payloads_of_one_digest_are_compared():
    import zstandard

    def batch(*rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["digest", "packed"])

    a, b = (zstandard.ZstdCompressor(level=3, write_checksum=w).compress(b"same bytes " * 50) for w in (False, True))
    c = zstandard.compress(b"other")
    assert a != b and [x.num_rows for x in warc._once(iter([batch((b"d", a), (b"d", b)), batch((b"d", a))]))] == [1]
    with pytest.raises(ValueError, match="differ"):
        list(warc._once(iter([batch((b"d", a), (b"d", c))])))


def test_archive_of_pages_odd_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>", 1), (2, None, None, 2), (None, "v", "", 3), (1, "u", "<p>é</p>", 1)], "page_id long, url string, html string, digest int")
    warc.write(warc.records_of_pages(pages), str(tmp_path / "p"))
    back = warc.read(spark, str(tmp_path / "p")).collect()
    assert len(back) == 4 and sum(b"<p>\xc3\xa9</p>\r\n\r\n" in bytes(r.record) for r in back) == 2
    warc.write(warc.records_of_pages(pages.limit(0)), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


def test_archive_notices_a_changed_payload(spark, tmp_path):
    path = str(tmp_path / "c")
    warc.write(warc.records_of_raw(spark.createDataFrame([(1, b"Content-Length: 2\r\n\r\nab")], "record_id long, raw binary")), path)
    good = spark.read.parquet(f"{path}/payloads").collect()[0]
    import zstandard

    spark.createDataFrame([(good.digest, bytearray(zstandard.compress(b"xy")))], "digest binary, packed binary").write.mode("overwrite").parquet(f"{path}/payloads2")
    (tmp_path / "c" / "payloads").rename(tmp_path / "c" / "old")
    (tmp_path / "c" / "payloads2").rename(tmp_path / "c" / "payloads")
    with pytest.raises(Exception, match="has changed"):
        warc.read(spark, path).collect()


# 3 lines


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        old, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (c != d))
    return row[-1]


def mutate(rng, t, n):
    for _ in range(n):
        p = rng.randrange(len(t))
        t = rng.choice([t[:p] + "q" + t[p:], t[:p] + t[p + 1 :], t[:p] + "z" + t[p + 1 :]])
    return t


@pytest.mark.parametrize("k", [1, 2, 3, 6])
def test_banded_distance_equals_the_table(k):
    rng = random.Random(k)
    pairs = []
    for _ in range(500):
        x = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 40)))
        pairs.append((x, mutate(rng, "xyxy" + x, rng.randint(0, 3))[rng.choice([0, 4]) :] if rng.random() < 0.8 else "ab" * rng.randint(0, 9)))
    chars = np.array([ord(c) for p in pairs for c in p[0] + p[1]], np.uint32)
    n = np.array([[len(x), len(y)] for x, y in pairs])
    at = np.concatenate([[0], np.cumsum(n.sum(axis=1))])[:-1]
    got = lines.within(chars, at, n[:, 0], at + n[:, 0], n[:, 1], k)
    assert got.tolist() == [min(edits(x, y), k + 1) for x, y in pairs]


def brute_lines(data, distance, per_edit):
    occ = sorted(((i, n, s.strip()) for i, t in data for n, s in enumerate(t.split("\n")) if s.strip()), key=lambda x: x[:2])
    uniq = sorted({x[2] for x in occ})
    up = {x: x for x in uniq}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(uniq):
        for y in uniq[:i]:
            k = min(distance, min(len(x), len(y)) // per_edit)
            if abs(len(x) - len(y)) <= k and edits(x, y) <= k:
                up[find(x)] = find(y)
    first, out = {}, set()
    for i, n, s in occ:
        if (g := find(s)) in first:
            out.add((i, n, *first[g]))
        else:
            first[g] = (i, n)
    return out


@pytest.mark.parametrize(("distance", "per_edit"), [(0, 16), (1, 16), (2, 8), (2, 16), (3, 5)])
def test_line_join_equals_brute_force(spark, distance, per_edit):
    rng = random.Random(11)
    base = [prose(rng, rng.randint(1, 12)) for _ in range(40)] + ["a", "ab", "ééé", "}"]
    pool = base + [mutate(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(80)]
    data = [(i, "\n".join(rng.choice(["", "  "]) + rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    got = lines.repeated(spark.createDataFrame(data, "doc_id long, text string"), distance, per_edit)
    assert {(r.doc_id, r.line, r.first_doc_id, r.first_line) for r in got.collect()} == brute_lines(data, distance, per_edit)


def test_line_join_of_a_hot_segment_equals_brute_force(spark):
    # lines that share only their tail with the leader, and each a link elsewhere
    rng = random.Random(3)
    tail = " :: shared common tail 01"
    base = ["".join(rng.choice("abcdefghij") for _ in range(50)) for _ in range(60)]
    pool = []
    for x in base:
        a, b, c, d = x, mutate(rng, x, 2), mutate(rng, x, 2), mutate(rng, x, 2)
        pool += [t + tail for t in (a, b, c, d)]
    pool += ["nmzrjriwpkdgukbaazjxtkomkmccktodigzt", "nm#rj#iwpkdgukbaazjxtkomkmccktodigzt", "nm#rj#iwpkdguk#aa#jxtkomkmccktodigzt", "nm#rj#iwpkdguk#aa#jx@k@mkmccktodigzt"]
    data = [(i, t) for i, t in enumerate(pool)]
    got = lines.repeated(spark.createDataFrame(data, "doc_id long, text string"), 2, 16)
    assert {(r.doc_id, r.line, r.first_doc_id, r.first_line) for r in got.collect()} == brute_lines(data, 2, 16)


def test_star_edges_connect_all_of_a_bucket(spark, monkeypatch):
    # b~c only in the bucket of an unrelated leader 0, while b is linked to a and c to d elsewhere
    monkeypatch.setattr(graph, "FEW", 0)
    monkeypatch.setattr(graph, "ROUNDS", 1)
    true = {(2, 1), (3, 2), (4, 3)} | {(x + 10, x) for x in range(20, 30)}
    rows_ = [(v, 1) for v in (0, 2, 3)] + [(v, 2) for v in (1, 2)] + [(v, 3) for v in (3, 4)] + [(v, 4) for v in range(5, 40)]
    near = spark.createDataFrame([(*p, 1.0) for p in true], "v long, u long, similarity double")
    edges = graph.star_edges(spark.createDataFrame(rows_, "v long, bucket long"), lambda pairs: pairs.join(near, ["v", "u"]))
    got = {r.v: r.label for r in graph.components(edges.selectExpr("v as a", "u as b")).collect()}
    assert {got.get(v, v) for v in (1, 2, 3, 4)} == {1} and all(got[x + 10] == x for x in range(20, 30)) and not {0, 5, 19} & set(got)


def test_lines_filter(spark, odd):
    data = rows(["a first line, quite long enough to count here\nkeep me once", "other text\na first line, quite long enough to count herq", "keep me once"])
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.drop_repeated_lines(spark.createDataFrame(data, DOCS)).collect()}
    assert got == {0: (data[0][1], len(data[0][1])), 1: ("other text", 10)}
    kept = lines.drop_repeated_lines(odd)
    assert kept.columns == odd.columns and kept.schema["n_chars"] == odd.schema["n_chars"]
    back = kept.collect()
    assert {None, "", " ", "\n\n"} <= {r.text for r in back} and sum(r.text == "same id again" for r in back) == 1
    assert lines.drop_repeated_lines(odd.limit(0)).count() == 0


# 4 toxicity


def toxic_case(spark, n=300):
    rng = random.Random(5)
    bad = ["vilex", "grumor", "scathen", "drebbish", "knavor"]
    data, labels = [], []
    for i in range(n):
        w = prose(rng, rng.randint(20, 80)).split()
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "a", "os"]))
        data.append((i, " ".join(w)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: i % 4 == 0 for i in range(n)}, {x[0] for x in labels}


def test_toxicity_held_out(spark):
    docs, labels, truth, seen = toxic_case(spark)
    got = {r.doc_id: r for r in toxicity.scores(docs, toxicity.train(docs, labels)).collect()}
    held = [i for i in truth if i not in seen]
    assert np.mean([got[i].rejected == truth[i] for i in held]) > 0.95
    assert all(got[i].neighbours for i in held if truth[i])


def test_nearest_and_scores_equal_brute_force(spark):
    docs, labels, _, _ = toxic_case(spark)
    data = {r[0]: collections.Counter(word_list(r[1])) for r in docs.collect()}
    y = {r.doc_id: r.toxic for r in labels.collect()}
    base, n1 = np.mean(list(y.values())), sum(y.values())
    df = collections.Counter(w for c in data.values() for w in c)
    a, b = (collections.Counter(w for i in y if y[i] == c for w in data[i]) for c in (1, 0))
    weight = {w: (math.log(len(data) / df[w]) + 1) * abs(math.log((a[w] + 0.5) / (n1 + 1)) - math.log((b[w] + 0.5) / (len(y) - n1 + 1))) for w in {*a, *b}}
    vec = {i: {w: (1 + math.log(n)) * weight[w] for w, n in c.items() if weight.get(w, 0) > 0} for i, c in data.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    index = toxicity.train(docs, labels)
    for r in toxicity.scores(docs, index).collect():
        sims = {j: sum(x * vec[j].get(w, 0) for w, x in vec[r.doc_id].items()) / (norm[r.doc_id] * norm[j]) for j in y}
        best = sorted(sims.values(), reverse=True)[: toxicity.K]
        assert np.allclose(r.similarities, [s for s in best if s > 0], atol=1e-9)
        assert all(abs(sims[j] - s) < 1e-9 for j, s in zip(r.neighbours, r.similarities, strict=True)) and len(set(r.neighbours)) == len(r.neighbours)
        votes = [(1 / (1.01 - s), y[j]) for j, s in zip(r.neighbours, r.similarities, strict=True)] + [(1 / 1.01, base)] * (toxicity.K - len(r.neighbours))
        p = 1 / (1 + math.exp(-(index.slope * sum(w * t for w, t in votes) / sum(w for w, _ in votes) + index.shift)))
        assert abs(r.toxicity - p) < 1e-6 and r.rejected == (p >= toxicity.THRESHOLD)
    texts = pa.array([r[1] for r in docs.collect()])
    for lo, hi, cps, offs in words.layouts(texts):
        text, _, _, h = words.words(cps, offs)
        v = index.vectors(text, h, hi - lo)
        assert all((x == z).all() for x, z in zip(index.nearest(*v, 5), index.nearest(*v, 5, prune=False), strict=True))


def test_a_copy_of_a_toxic_example_is_rejected(spark):
    docs, labels, truth, seen = toxic_case(spark)
    copies = docs.where(docs.doc_id.isin([i for i in seen if truth[i]])).selectExpr("doc_id + 1000 as doc_id", "text")
    assert all(r.rejected for r in toxicity.scores(copies, toxicity.train(docs, labels)).collect())


@pytest.mark.parametrize(("labelled", "base"), [([(100 + i, 1, int(i < 6)) for i in range(10)], 0.6), ([(i, 1, 1) for i in range(5)], 1.0), ([(i, 1, 0) for i in range(5)], 0.0), ([], 0.0), ([(None, 1, 1), (1, None, None)], 0.0)])
def test_toxicity_without_both_classes(spark, labelled, base):
    docs = spark.createDataFrame(rows([prose(random.Random(i), 20) for i in range(5)]), DOCS)
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    got = toxicity.scores(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 5 and all(abs(r.toxicity - base) < 1e-9 and not r.rejected and r.neighbours == [] for r in got)
    assert toxicity.drop_toxic(docs, labels).count() == 5


def test_toxicity_odd_inputs(spark, odd):
    docs, labels, _, _ = toxic_case(spark, 80)
    index = toxicity.train(docs, labels)
    got = toxicity.scores(odd, index).collect()
    assert len(got) == len(ODD) and not any(r.rejected or r.neighbours for r in got) and all(abs(r.toxicity - index.base) < 1e-9 for r in got)
    none = spark.createDataFrame([(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert not any(r.rejected for r in toxicity.scores(odd, toxicity.train(odd, none)).collect())
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= len(ODD)
    assert toxicity.scores(odd.limit(0), index).count() == 0


# 5 near duplicates


def weighted_sets(data, idf):
    out = {}
    for i, t in data:
        for _, _, cps, offs in words.layouts(pa.array([t], pa.string())):
            _, g, w, _ = minhash.weighted(cps, offs, idf)
            out[i] = dict(zip(g.tolist(), w.tolist(), strict=True))
    return out


def test_near_duplicates_recall_and_precision(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS)
    idf = minhash.idf_of(*minhash.document_frequencies(docs))
    sets = weighted_sets([(r[0], r[1]) for r in corpus], idf)
    near = set()
    for a in sets:
        for b in sets:
            if a < b:
                keys = set(sets[a]) | set(sets[b])
                lo = sum(min(sets[a].get(k, 0), sets[b].get(k, 0)) for k in keys)
                if lo / (sum(sets[a].values()) + sum(sets[b].values()) - lo) >= minhash.THRESHOLD:
                    near.add((a, b))
    out = minhash.groups(docs).collect()
    got = {r.doc_id: r.group_id for r in out}
    assert all(r.links >= 1 and r.similarity >= minhash.THRESHOLD for r in out)
    assert near and np.mean([got.get(a, -1) == got.get(b, -2) for a, b in near]) >= 0.9
    assert set(got) <= {x for p in near for x in p}


def test_sketch_estimates_weighted_jaccard():
    g = np.random.default_rng(3)
    ids = g.integers(0, 2**63, 300).astype(np.uint64)
    a, b = g.gamma(2, 1, 300).astype(np.float32), None
    b = np.where(g.random(300) < 0.3, a * 0.3, a).astype(np.float32)
    order = np.argsort(ids)
    both = minhash.sketch(np.concatenate([ids[order], ids[order]]), np.concatenate([a[order], b[order]]), np.array([0, 300]), 2000)
    assert abs((both[0] == both[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.06


def test_near_duplicates_odd(spark, odd):
    kept = minhash.drop_near_duplicates(odd)
    texts = [r.text for r in kept.collect()]
    assert kept.columns == odd.columns and {None, "", " ", "\n\n", "!!! ###"} <= set(texts)
    assert texts.count("same id again") == 1 and texts.count(ODD[9][1]) == 1
    assert minhash.groups(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    e = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)]
    up = list(range(140))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in e:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r.v: r.label for r in graph.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert all(got.get(v, v) == find(v) for v in range(140))


# 6 quality


def test_quality_held_out(spark):
    rng = random.Random(9)
    data, labels = [], []
    for i in range(200):
        good = i % 3 > 0
        t = prose(rng, 60).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in prose(rng, 60).split())
        data.append((i, t))
        if i < 100:
            labels.append((i, int(good), 0))
    docs, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.scores(docs, quality.train(docs, lab)).collect()}
    assert np.mean([got[i] == (i % 3 > 0) for i in range(100, 200)]) > 0.97


def test_dual_descent_reaches_the_optimum():
    g = np.random.default_rng(4)
    x, y = g.normal(size=(60, 5)), np.where(g.random(60) < 0.5, 1.0, -1.0)
    w = quality.dual_descent(np.arange(0, 301, 5), np.tile(np.arange(5), 60), x.ravel(), y, 5, 1.0, 2000)
    c = 60 / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    z = np.concatenate([x, np.ones((60, 1))], axis=1)
    grad = w - (2 * c * y * np.maximum(0, 1 - y * (z @ w))) @ z
    assert np.abs(grad).max() < 0.1


@pytest.mark.parametrize(("labelled", "rate"), [([(100 + i, i % 2, 0) for i in range(10)], 0.5), ([(i, 0, 0) for i in range(5)], 0.0), ([(i, 1, 0) for i in range(5)], 1.0), ([(1, 1, 0), (200, 0, 0)], 0.5), ([], 1.0)])
def test_quality_without_both_classes(spark, labelled, rate):
    docs = spark.createDataFrame(rows([prose(random.Random(i), 20) for i in range(5)]), DOCS)
    got = quality.scores(docs, quality.train(docs, spark.createDataFrame(labelled, "doc_id long, quality int, toxic int"))).collect()
    assert len(got) == 5 and all(r.quality == rate and r.keep for r in got)


def test_quality_model_equals_a_plain_version(spark):
    # log-count ratios, scaled vectors and margins, by dictionaries
    rng = random.Random(9)
    texts = [prose(rng, 30) + "." if i % 3 else prose(rng, 30).upper() for i in range(60)]
    col = pa.array(texts)
    sets = collections.defaultdict(set)
    for lo, hi, cps, offs in words.layouts(col):
        for t, i in zip(*quality.indicators(cps, offs), strict=True):
            sets[lo + int(t)].add(int(i))
    good = np.array([i % 3 > 0 for i in range(60)])
    ind = [sorted(sets[i]) for i in range(60)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ind])])
    model = quality.fit(bounds, np.concatenate(ind), good)
    train = [i for i in range(60) if i % 5 != 4]
    p, q = (collections.Counter(x for i in train if good[i] == g for x in ind[i]) for g in (True, False))
    dim = 1 << quality.BITS
    ratio = lambda x: math.log((p[x] + 1) / (sum(p.values()) + dim)) - math.log((q[x] + 1) / (sum(q.values()) + dim))
    assert all(abs(model.square[x] - ratio(x) ** 2) < 1e-6 for x in ind[0])
    for i in range(60):
        r = np.array([ratio(x) for x in ind[i]])
        w = np.array([model.weight[x] / ratio(x) for x in ind[i]])
        want = (w * r).sum() / math.sqrt((r * r).sum()) + model.bias
        t = np.zeros(len(ind[i]), np.int64)
        assert abs(model.margins(t, np.array(ind[i]), 1)[0] - want) < 1e-6


def test_quality_odd(spark, odd):
    none = spark.createDataFrame([(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.scores(odd, quality.train(odd, none)).collect()
    assert len(got) == len(ODD) and all(r.keep for r in got)
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    assert quality.scores(odd, quality.train(odd, lab)).count() == len(ODD)
    assert quality.scores(odd.limit(0), quality.train(odd, none)).count() == 0


# 7 repeated passages


def brute_repeats(data, depth):
    at = collections.defaultdict(list)
    ws = [word_list(t) for _, t in data]
    for r, w in enumerate(ws):
        for p in range(len(w) - depth + 1):
            at[tuple(w[p : p + depth])].append((r, p))
    mark = collections.defaultdict(dict)
    for v in at.values():
        for x in v if len(v) > 1 else ():
            mark[x[0]][x[1]] = len(v)
    out = collections.Counter()
    for r, m in mark.items():
        ps = sorted(m)
        for k, p in enumerate(ps):
            if k == 0 or ps[k - 1] != p - 1:
                begin, most = p, 0
            most = max(most, m[p])
            if k + 1 == len(ps) or ps[k + 1] != p + 1:
                out[(data[r][0], begin, p + depth, most)] += 1
    return out


@pytest.mark.parametrize("depth,digit", [(50, 10), (8, 3), (5, 5), (3, 1)])
def test_repeats_equal_brute_force(spark, corpus, depth, digit):
    data = [(r[0], r[1]) for r in corpus] + [(500, "one two " * 60), (501, "w " * 70)]
    got = suffixes.repeats(spark.createDataFrame(data, "doc_id long, text string"), depth, digit).collect()
    assert collections.Counter((r.doc_id, r.start, r.end, r.copies) for r in got) == brute_repeats(data, depth)


def test_repeats_odd(spark, odd):
    data = [(r[0], r[1]) for r in ODD]
    got = suffixes.repeats(odd, 4, 2).collect()
    assert collections.Counter((r.doc_id, r.start, r.end, r.copies) for r in got) == brute_repeats(data, 4)
    assert suffixes.repeats(odd.limit(0)).count() == 0


# 8 token ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"])
def test_token_ids_equal_the_librarys(name, corpus):
    v = tokens.Vocabulary(name, tokens.read_file(tokens.TOKENIZERS, name))
    texts = [r[1] for r in ODD] + ["a  b", " a", "a ", "a \n b", "a\n \nb", "it's  x", "▁a ▁", "x  y", "café 1234 日本 語"] + [r[1] for r in corpus]
    ids, offs = v.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == list(v.whole(t or ""))


def test_orc_round_trip_and_lookup(spark, corpus, odd, tmp_path):
    docs = spark.createDataFrame(corpus, DOCS)
    path = str(tmp_path / "orc")
    token_orc.write(docs, path)
    want = {r.doc_id: list(r.token_ids) for r in token_orc.encode(docs).collect()}
    assert {r.doc_id: list(r.token_ids) for r in token_orc.read(spark, path).collect()} == want
    assert {r.doc_id for r in token_orc.read(spark, path, [3, 17, 10**9]).collect()} == {3, 17}
    token_orc.write(odd, str(tmp_path / "odd"))
    assert token_orc.read(spark, str(tmp_path / "odd")).count() == len(ODD)
    token_orc.write(odd.limit(0), str(tmp_path / "none"))
    assert token_orc.read(spark, str(tmp_path / "none")).count() == 0


def test_orc_layout_and_skipping(spark, tmp_path):
    path = str(tmp_path / "orc")
    docs = spark.range(0, 40_000, 2).selectExpr("id as doc_id", "concat('text number ', id) as text").coalesce(1)
    token_orc.write(docs, path)
    jvm = spark.sparkContext._jvm
    file = next(x for x in (tmp_path / "orc").iterdir() if x.suffix == ".orc")
    orc = jvm.org.apache.orc.OrcFile
    reader = orc.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), orc.readerOptions(spark.sparkContext._jsc.hadoopConfiguration()))
    assert reader.getRowIndexStride() == 1000 and reader.getNumberOfRows() == 20_000
    rows = reader.rows()
    for stripe in reader.getStripes():
        footer = rows.readStripeFooter(stripe)
        kinds = collections.Counter(x.getKind().toString() for x in footer.getStreamsList())
        assert kinds["ROW_INDEX"] >= 3 and kinds["BLOOM_FILTER_UTF8"] == 1  # the filter is that of doc_id
        assert [footer.getColumns(i).getKind().toString() for i in (1, 2, 4)] == ["DIRECT_V2"] * 3  # run lengths
    rows.close()

    def read_rows(ids):
        df = token_orc.read(spark, path, ids)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = df._jdf.queryExecution().executedPlan()
            got = {r.doc_id for r in df.collect()}
            return got, plan.collectLeaves().head().metrics().apply("numOutputRows").value()
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")

    got, n = read_rows([1234])
    assert got == {1234} and 0 < n <= 1000  # one row group, by its range
    got, n = read_rows([1235, 30_001])
    assert got == set() and n <= 1000  # inside of ranges: the Bloom filters
    got, n = read_rows([10**9])
    assert got == set() and n == 0


# 9 decontamination


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(13)
    items = [(i, prose(rng, n)) for i, n in enumerate([3, 6, 8, 9, 20, 30])] + [(6, None), (7, "")]
    data = []
    for i in range(40):
        w = prose(rng, 30).split()
        if i % 2:
            src = rng.choice(items[:6])[1].split()
            a = rng.randrange(len(src))
            w[10:10] = [x.upper() + "," for x in src[a : a + rng.randint(4, 20)]]
        data.append((i, "  ".join(w)))
    want = set()
    for i, t in data:
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t)]
        w = word_list(t)
        for j, text in items:
            k = word_list(text)
            n = min(8, len(k))
            if len(k) < 5:
                continue
            grams = {tuple(k[x : x + n]) for x in range(len(k) - n + 1)}
            hits = [p for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in grams]
            run = []
            for p in hits:
                if run and p <= run[-1][1]:
                    run[-1][1] = p + n
                else:
                    run.append([p, p + n])
            want |= {(i, j, spans[a][0], spans[b - 1][1], b - a) for a, b in run}
    df, it = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(df, it)
    assert want and {tuple(r) for r in got.collect()} == want
    clean = decontaminate.drop_contaminated(df, it)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in data} - {x[0] for x in want}


def test_decontamination_in_parts(spark, monkeypatch):
    rng = random.Random(14)
    items = [(i, prose(rng, rng.randint(3, 40))) for i in range(30)] + [(None, prose(rng, 9)), (3, prose(rng, 12))]
    data = [(i, prose(rng, 10) + " " + rng.choice(items)[1] + " " + prose(rng, 10)) for i in range(60)]
    df, it = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = collections.Counter(tuple(r) for r in decontaminate.matches(df, it).collect())
    kept = {r.doc_id for r in decontaminate.drop_contaminated(df, it).collect()}
    monkeypatch.setattr(decontaminate, "MAX_CHARS", 1000)
    assert len(decontaminate._parts(it)) > 3
    assert whole and collections.Counter(tuple(r) for r in decontaminate.matches(df, it).collect()) == whole
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, it).collect()} == kept == {i for i, _ in data} - {k[0] for k in whole}
    assert {(r.item_id, r.n_words) for r in decontaminate.too_short(it).collect()} == {(i, len(t.split())) for i, t in items if len(t.split()) < 5}


def test_decontamination_odd(spark, odd):
    items = spark.createDataFrame([(1, "line one of this text is long enough"), (2, "x"), (None, "line one of this text is long enough")], "item_id long, text string")
    got = decontaminate.matches(odd, items).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in got) == [(9, 0), (9, 1), (10, 0), (10, 1)]
    assert decontaminate.drop_contaminated(odd, items).columns == odd.columns
    assert decontaminate.matches(odd, items.limit(0)).count() == 0 and decontaminate.matches(odd.limit(0), items).count() == 0


# 10 fertility


def test_fertility_measures(spark, corpus):
    v, s = (tokens.Vocabulary(n, tokens.read_file(tokens.TOKENIZERS, n)) for n in (fertility.BYTES, fertility.PIECES))
    docs = spark.createDataFrame([*corpus, *rows(["日本 \U0001f600 x", None], 900)], DOCS)
    for r in fertility.measure(docs).collect():
        t = next(x[1] for x in [*corpus, *rows(["日本 \U0001f600 x", None], 900)] if x[0] == r.doc_id)
        ids, pieces = v.whole(t or ""), s.whole(t or "")
        assert r.n_tokens == len(ids)
        if not ids:
            assert r.entropy is None
            continue
        p = np.array(list(collections.Counter(ids).values())) / len(ids)
        assert np.isclose(r.chars_per_token, len(t) / len(ids)) and np.isclose(r.piece_chars_per_token, len(t) / len(pieces))
        assert np.isclose(r.byte_share, np.mean(s.is_byte[pieces]))
        assert np.isclose(r.entropy, -(p * np.log2(p)).sum() / np.log2(len(ids)) if len(ids) > 1 else 1.0)


def test_fertility_rejects_the_odd_one_out(spark):
    rng = random.Random(17)
    texts = [prose(rng, 100) for _ in range(120)]
    n = fertility.measure(spark.createDataFrame(rows(texts), DOCS)).agg({"n_tokens": "avg"}).first()[0]
    docs = rows([*texts, "balin " * round(n / 3)])
    got = {r.doc_id: r for r in fertility.judge(spark.createDataFrame(docs, DOCS)).collect()}
    assert [i for i, r in got.items() if not r.keep] == [120] and "entropy" in got[120].reasons


def test_fertility_bands_equal_a_plain_version(spark):
    rng = random.Random(23)
    docs = [(i, prose(rng, rng.randint(5, 200)) + ("é" * rng.randint(0, 9)), rng.choice(["en", "de", None]), "s", None) for i in range(400)] + [(900 + i, "balin " * rng.randint(1, 150), "en", "s", None) for i in range(20)] + [(950, prose(rng, 3000), "zz", "s", None)]
    df = spark.createDataFrame(docs, DOCS)
    m = {r.doc_id: r for r in fertility.measure(df).collect()}
    octave = {i: int(math.log2(r.n_tokens)) for i, r in m.items()}
    lang = {r.doc_id: r.lang for r in m.values()}

    def pool(i):
        for same, far in fertility.LEVELS:
            own = [j for j in m if (not same or lang[j] == lang[i]) and (far is None or abs(octave[j] - octave[i]) <= far)]
            if len(own) >= fertility.MIN_GROUP:
                return own

    def quantile(xs, q):  # the least value that so large a share doesn't exceed
        return sorted(xs)[max(math.ceil(q * len(xs)) - 1, 0)]

    for r in fertility.judge(df).collect():
        own, reasons = pool(r.doc_id), []
        for name, (side, floor) in fertility.BANDS.items():
            q1, q2, q3 = (quantile([m[j][name] for j in own], q) for q in (0.25, 0.5, 0.75))
            low, high = q2 - fertility.WIDTH * max(q2 - q1, floor), q2 + fertility.WIDTH * max(q3 - q2, floor)
            if side != "high" and r[name] < low or side != "low" and r[name] > high:
                reasons.append(name)
        assert r.reasons == reasons and r.keep == (not reasons), r


def test_fertility_judges_small_groups(spark):
    rng = random.Random(19)
    docs = rows([prose(rng, 100) for _ in range(60)])
    docs += [(100, "balin " * 4000, "en", "s", None), (101, "balin " * 100, "xx", "s", None), (102, "\U0001f600" * 5, "en", "s", None), (103, prose(rng, 100), "xx", "s", None)]
    got = {r.doc_id: r.keep for r in fertility.judge(spark.createDataFrame(docs, DOCS)).collect()}
    assert {i for i, keep in got.items() if not keep} == {100, 101, 102}


def test_fertility_odd(spark, odd):
    got = fertility.judge(odd).collect()
    assert len(got) == len(ODD) and all(r.keep for r in got)
    assert fertility.judge(odd.limit(0)).count() == 0
