"""Every operator and every stage of the pipeline on hard tables: nulls in any column, empty and very long texts, ties and
repeated rows, empty tables, and further columns whose names clash with those that the operators use inside."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quernstone.llm import common, decontaminate, fertility, lines, minhash, packing, quality, suffixes, token_orc, tokens, toxicity, warc, words

WORDS = [a + b for a in ("ba", "ke", "mi", "to", "ru", "sal", "ven", "dor") for b in ("lin", "ta", "gor", "pe", "shu", "ril", "no", "xa", "um", "est")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, bucket string, keep boolean, v long, gone int, d string, k1 string, label int, window_id long, length string"
ITEM = "which of the seven rivers ends in the northern sea of glass"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _texts():
    rng = random.Random(31)
    long = "\n".join(prose(rng, rng.randint(5, 60)) for _ in range(1400))
    assert len(long) > 1 << 18  # one text crosses the slices that the operators work in
    passage = prose(rng, 70)
    out = [None, "", " ", "\n\n", "!!! ###", "a", "\U0001f600" * 40, long, long + " tail", "x" * (1 << 18) + " y", passage + " " + prose(rng, 30), prose(rng, 20) + " " + passage, ITEM.upper() + " and so on", "vile vile grumor " + prose(rng, 20)]
    base = prose(rng, 120)
    out += [base, base, base.replace(" ", "  ", 1), base.rsplit(" ", 1)[0] + " other", "same line of this text\nsame line of this text\n\nsame line of this texd", prose(rng, 200)]
    return out


TEXTS = _texts()
ROWS = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
ROWS += [(None, TEXTS[14], None, None, None), (None, None, None, None, None), (5, "a", "en", "s", 1), (5, "a", "en", "s", 1), (5, "another text of the same id", "en", "s", 27)]
FULL = [(*r, 1, "b", None, 2, 3, "d", None, 4, 5, "l") for r in ROWS]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(FULL, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i == 13)) for i in range(6, 20)] + [(13, 1, 1), (13, 0, 0), (None, 1, 1), (7, None, None), (500, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, ITEM), (1, ITEM)], "item_id long, text string")


def word_list(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def multiset(rows):
    return collections.Counter(map(tuple, rows))


def test_layouts_cut_between_texts_alone():
    col = pa.array(TEXTS, pa.string())
    seen = []
    for lo, hi, cps, offs in words.layouts(col):
        whole = cps.tobytes().decode("utf-32-le")
        seen += [whole[offs[i] : offs[i + 1]] for i in range(hi - lo)]
        text, start, end, h = words.words(cps, offs)
        assert [whole[a:b].lower() for a, b in zip(start, end, strict=True)] == [w for i in range(lo, hi) for w in word_list(TEXTS[i])]
        by = {}
        assert all(by.setdefault(whole[a:b].lower(), x) == x for a, b, x in zip(start.tolist(), end.tolist(), h.tolist(), strict=True)) and len(set(by.values())) == len(by)
    assert seen == [t or "" for t in TEXTS]


def test_packing(spark, hard):
    counts = {}
    v = tokens.Vocabulary(packing.VOCABULARY, tokens.read_file(tokens.TOKENIZERS, packing.VOCABULARY))
    for i, t, *_ in ROWS:
        counts.setdefault(i, []).append(len(v.whole(t or "")))
    pdf = packing.pack(hard, window=256, grain=16).toPandas()
    assert (pdf.groupby("window_id")["length"].sum() <= 256).all()
    got = pdf.groupby("doc_id", dropna=False)["length"].sum()
    for i, n in counts.items():
        assert sum(n) == (0 if sum(n) == 0 else int(got[got.index.isna()].sum() if i is None else got[i]))
    assert packing.pack(hard.limit(0)).count() == 0


def test_archive(spark, tmp_path):
    pages = spark.createDataFrame([(i, None if i % 3 == 0 else f"u{i}", t, "x", 1) for i, t in enumerate(TEXTS + TEXTS[5:9])] + [(None, None, None, None, None)], "page_id long, url string, html string, digest string, packed int")
    warc.write(warc.records_of_pages(pages), str(tmp_path / "a"))
    back = warc.read(spark, str(tmp_path / "a")).collect()
    assert collections.Counter(bytes(r.record).split(b"\r\n\r\n", 1)[1] for r in back) == collections.Counter((r.html or "").encode() + b"\r\n\r\n" for r in pages.collect())
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == len({t or "" for t in TEXTS})
    warc.write(warc.records_of_pages(pages.limit(0)), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b")).count() == 0


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        old, row[0] = row[0], i
        for j, e in enumerate(y, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (c != e))
    return row[-1]


def expected_lines(rows):
    """(doc_id, text hash, line) of the lines that go: of the hard table, whose long lines are equal or far apart but for a few."""
    occ = sorted({(i is None, i if i is not None else 0, t, n, s.strip()) for i, t, *_ in rows for n, s in enumerate((t or "").split("\n")) if s.strip()}, key=lambda x: (x[0], x[1]))
    uniq = list(dict.fromkeys(o[4] for o in occ))
    up = {x: x for x in uniq}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    short = [x for x in uniq if len(x) >= 16]
    short.sort(key=len)
    for a, x in enumerate(short):
        for y in short[a + 1 :]:
            k = min(2, len(x) // 16)
            if len(y) - len(x) > k:
                break
            if (x[:6] == y[:6] or x[-6:] == y[-6:]) and len(x) < 5000 and distance(x, y) <= k:
                up[find(y)] = find(x)
    return occ, find


def test_lines(spark, hard):
    got = lines.repeated(hard).collect()
    occ, find = expected_lines(ROWS)
    groups = collections.Counter(find(o[4]) for o in occ)
    assert len(got) == sum(n - 1 for n in groups.values())
    by = {}
    for o in occ:
        by.setdefault((None if o[0] else o[1], o[3]), set()).add(find(o[4]))
    assert all(by[r.doc_id, r.line] & by[r.first_doc_id, r.first_line] for r in got)
    assert lines.repeated(hard.limit(0)).count() == 0


def test_toxicity(spark, hard, labels):
    index = toxicity.train(hard, labels)
    got = toxicity.scores(hard, index).collect()
    assert multiset([(r.doc_id,) for r in got]) == multiset([(r[0],) for r in ROWS])
    by = {r.doc_id: r for r in got}
    assert all(by[i].neighbours == [] and not by[i].rejected and by[i].toxicity == index.base for i in (0, 1, 2, 3, 4))
    assert by[13].neighbours[0] == 13 and abs(by[13].similarities[0] - 1) < 1e-9 and by[7].neighbours[0] == 7
    assert toxicity.scores(hard.limit(0), toxicity.train(hard.limit(0), labels)).count() == 0 and toxicity.scores(hard, toxicity.train(hard, labels.limit(0))).where("rejected").count() == 0


def test_minhash(spark, hard):
    got = {(r.doc_id, r.k1): r for r in minhash.groups(hard).collect()}
    by = collections.defaultdict(set)
    for (i, _), r in got.items():
        by[r.group_id].add(i)
    assert by == {7: {7, 8}, 14: {14, 15, 16, 17, None}, 5: {5}} or by == {7: {7, 8}, 14: {14, 15, 16, 17, None}}
    kept = minhash.drop_near_duplicates(hard)
    assert kept.columns == hard.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids == collections.Counter([i for i in range(len(TEXTS)) if i not in (8, 15, 16, 17)] + [None, 5])  # the null text of a null id, and the other text of id 5
    assert minhash.groups(hard.limit(0)).count() == 0


def test_quality(spark, hard, labels):
    got = quality.scores(hard, quality.train(hard, labels)).collect()
    assert multiset([(r.doc_id,) for r in got]) == multiset([(r[0],) for r in ROWS]) and all(0 <= r.quality <= 1 and r.keep == (r.quality >= 0.5) for r in got)
    same = [r.quality for r in got if r.doc_id == 5]
    assert len(same) == 4 and len({round(q, 12) for q in same}) == 2
    assert quality.scores(hard.limit(0), quality.train(hard.limit(0), labels)).count() == 0


def test_repeats(spark, hard):
    depth, at = 50, collections.defaultdict(list)
    for r, (_, t, *_) in enumerate(ROWS):
        w = word_list(t)
        for p in range(len(w) - depth + 1):
            at[tuple(w[p : p + depth])].append((r, p))
    mark = collections.defaultdict(dict)
    for v in at.values():
        for r, p in v if len(v) > 1 else ():
            mark[r][p] = len(v)
    want = collections.Counter()
    for r, m in mark.items():
        run = None
        for p in sorted(m):
            if run and p == run[1] + 1:
                run = (run[0], p, max(run[2], m[p]))
                continue
            if run:
                want[ROWS[r][0], run[0], run[1] + depth, run[2]] += 1
            run = (p, p, m[p])
        want[ROWS[r][0], run[0], run[1] + depth, run[2]] += 1
    got = suffixes.repeats(hard).collect()
    assert multiset([(r.doc_id, r.start, r.end, r.copies) for r in got]) == want
    assert suffixes.repeats(hard.limit(0)).count() == 0


def test_token_orc(spark, hard, tmp_path):
    token_orc.write(hard, str(tmp_path / "t"))
    v = tokens.Vocabulary(token_orc.VOCABULARY, tokens.read_file(tokens.TOKENIZERS, token_orc.VOCABULARY))
    got = collections.Counter((r.doc_id, tuple(r.token_ids)) for r in token_orc.read(spark, str(tmp_path / "t")).collect())
    assert got == collections.Counter((r[0], tuple(v.whole(r[1] or ""))) for r in ROWS)
    assert token_orc.read(spark, str(tmp_path / "t"), [5]).count() == 4


def test_decontamination(spark, hard, items):
    got = decontaminate.matches(hard, items).collect()
    assert multiset([(r.doc_id, r.item_id, r.start, r.end, r.n_words) for r in got]) == {(12, 1, 0, len(ITEM), len(ITEM.split())): 1, (12, None, 0, len(ITEM), len(ITEM.split())): 1}
    kept = decontaminate.drop_contaminated(hard, items)
    assert kept.columns == hard.columns and multiset([(r.doc_id,) for r in kept.collect()]) == multiset([(r[0],) for r in ROWS if r[0] != 12])
    assert decontaminate.matches(hard, items.limit(0)).count() == 0 and decontaminate.drop_contaminated(hard.limit(0), items).count() == 0


def test_fertility(spark, hard):
    got = fertility.judge(hard).collect()
    assert multiset([(r.doc_id,) for r in got]) == multiset([(r[0],) for r in ROWS])
    assert all(r.keep and r.reasons == [] for r in got if r.n_tokens == 0)
    assert fertility.judge(hard.limit(0)).count() == 0


# the pipeline's stages


@pytest.fixture(scope="module")
def folder(spark, labels, items, hard, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    labels.write.parquet(f"{path}/labels.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    hard.write.parquet(f"{path}/documents.parquet")
    hard.limit(0).write.parquet(f"{path}/none.parquet")
    return str(path)


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", [n for n in STAGES if n != "packing"])
def test_a_stage_keeps_columns_and_clean_rows(spark, hard, folder, name):
    out = STAGES[name](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert out.schema.names == hard.columns and [f.dataType for f in out.schema] == [f.dataType for f in hard.schema]
    rows = out.collect()
    ids = collections.Counter(r.doc_id for r in rows)
    every = collections.Counter(r[0] for r in ROWS)
    if name == "toxicity":
        index = toxicity.train(hard, spark.read.parquet(f"{folder}/labels.parquet"))
        bad = {r.doc_id for r in toxicity.scores(hard, index).where("rejected").collect()}
        assert ids == collections.Counter({i: n for i, n in every.items() if i not in bad})
    elif name == "line_dedup":
        occ, find = expected_lines(ROWS)
        first, want = {}, collections.defaultdict(list)
        for o in occ:
            if first.setdefault(find(o[4]), (o[:4])) == o[:4]:
                want[o[:3]].append(o[3])
        left = {(i, t) for i, t, *_ in ROWS if not any(s.strip() for s in (t or "").split("\n"))}
        text_of = {k: [s for n, s in enumerate(k[2].split("\n")) if n in keep] for k, keep in want.items()}
        assert len(rows) == len(left) + len(text_of)
        assert collections.Counter(tuple(s for s in (r.text or "").split("\n") if s.strip()) for r in rows) == collections.Counter([*(tuple(s) for s in text_of.values()), *[()] * len(left)])
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    elif name == "near_dedup":
        assert ids == collections.Counter([i for i in range(len(TEXTS)) if i not in (8, 15, 16, 17)] + [None, 5])
    else:
        assert ids == collections.Counter({i: n for i, n in every.items() if i != 12})
    assert STAGES[name](spark, spark.read.parquet(f"{folder}/none.parquet"), folder).count() == 0


def test_the_last_stage_and_the_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert STAGES["packing"](spark, docs, folder).groupBy("doc_id").sum("length").count() == len({r[0] for r in ROWS if r[1]})
    assert STAGES["packing"](spark, docs.limit(0), folder).count() == 0
    expected = docs
    for name, stage in corpus_pipeline.STAGES:
        expected = common.checkpoint(stage(spark, expected, folder))
    got = corpus_pipeline.run(spark, folder)
    total = lambda df: {r[0]: r[1] for r in df.groupBy("doc_id").sum("length").collect()}
    assert total(got) == total(expected) and 12 not in total(got) and np.all([w <= packing.WINDOW for w in total(got.selectExpr("window_id as doc_id", "length")).values()])
