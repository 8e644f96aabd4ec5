"""What keeps the engine's passes over texts bounded in memory and time, on small tables."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone import shared
from quernstone.functions import trigram
from quernstone.operators import extract, hybrid, search
from quernstone.plans import standin
from quernstone.sources import store


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_structural_parses_spread_texts_once(spark):
    code = F.concat(F.lit("import os\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("id") % 7), lambda i: F.concat(F.lit("def f"), i.cast("string"), F.lit("(a):\n    return a\n"))), ""))
    docs = spark.range(40).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("d"), F.col("id") * 7 % 40).alias("path"), F.lit("python").alias("lang"), code.alias("text"))
    found = extract.structural(docs, "def $NAME($$$): $$$", "python", None)
    plan = optimized(found)
    assert "Sort" not in plan[: plan.index("MapInArrow")] and "RepartitionByExpression" in plan[plan.index("MapInArrow") :]
    got = [(r.path, r.line_start, r.captures[0].text) for r in found.collect()]
    assert got == sorted(got) == sorted((d.path, 2 + 2 * i, f"f{i}") for d in docs.collect() for i in range(d.doc_id % 7 + 1))
    assert [(r.path, r.line_start, r.captures[0].text) for r in extract.structural(docs, "def $NAME($$$): $$$", "python", 9, 3).collect()] == got[3:12]


def test_fallback_query_where_the_name_is_defined(spark, tmp_path):
    """The query is of text references at every size, and the operator gives definitions where there are some."""
    import duckdb

    from quernstone.operators import callgraph
    from quernstone.plans import standin
    from quernstone.queries import ORACLE_SQL, QUERIES

    rows = [(i, f"Under{'üä'[i % 2]} a word\nhere under it\nnothing", "de", "src1", 1) for i in range(7, 12)] + [(i, "look under here", "en", "src2", 1) for i in range(20, 90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["goto_definition_fallback"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["goto_definition_fallback"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 50
    d = standin.docs(spark, str(tmp_path))
    own = callgraph.definition(d, standin.symbols(d), standin.refs(d, ["under"]), "src1/de/doc_7.txt", "under").collect()
    assert len(own) == 5 and "text" not in {r.kind for r in own}


class Pass:
    """Stands for the result of an Arrow pass; holds its function."""

    def __init__(self, fn):
        self.fn = fn

    def select(self, *_):
        return self


#: Passes over (doc_id, text), and the rows of a text.
PASSES = {
    "refs": lambda d: standin.refs(d),
    "symbols": lambda d: standin.symbols(d),
    "extract": lambda d: trigram.extract(d),
    "postings": lambda d: trigram.postings(d),
    "terms": lambda d: hybrid.terms(d.withColumnRenamed("doc_id", "chunk_id")),
    "hash_embedding": lambda d: hybrid.hash_embedding(d.withColumnRenamed("doc_id", "chunk_id")),
}


@pytest.mark.parametrize("name", sorted(PASSES))
def test_passes_hold_a_few_texts_of_a_large_batch(spark, monkeypatch, name):
    monkeypatch.setattr(shared, "map_arrow", lambda df, fn, schema: Pass(fn))
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(3000)]
    texts = ["\n".join("Word " + " ".join(rng.choices(words, k=20)) for _ in range(100)) for _ in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), pa.array(texts)], ["chunk_id" if name in ("terms", "hash_embedding") else "doc_id", "text"])
    assert batch.nbytes > 14 << 20
    d = spark.createDataFrame([], "doc_id long, text string")
    fn = PASSES[name](d).fn
    list(fn(iter([batch.slice(0, 1)])))  # tables that are made once
    before, sizes, rows = pa.total_allocated_bytes(), [], 0
    tracemalloc.start()
    for b in fn(iter([batch])):
        sizes.append(b.nbytes)
        rows += b.num_rows
        assert pa.total_allocated_bytes() - before < 64 << 20
        del b
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20 and max(sizes) < 24 << 20 and rows >= 1200


def test_pieces_keep_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["", "aaa", None, "b" * 50, "cc", "", "é" * 3])], ["doc_id", "text"])
    got = list(shared.pieces(iter([b, b.slice(0, 0), b.slice(2, 3)]), "text", 5))
    assert [r for x in got for r in x.to_pylist()] == b.to_pylist() + b.slice(2, 3).to_pylist()
    assert max(len(x) for x in got) > 1 and all(len(x) == 1 or sum(len((t or "").encode()) for t in x.column(1).to_pylist()) <= 5 for x in got)


def test_symbols_are_those_of_lines(spark):
    import re

    rng = random.Random(2)
    texts = ["\n".join("".join(rng.choices("ABabcé \r", k=rng.randrange(0, 90))) for _ in range(rng.randrange(0, 6))) for _ in range(400)] + ["", "Ab", "Ab\n", "\nAb", "A\nb", "é\nZz é" + "ü" * 80]
    want = []
    for i, t in enumerate(texts):
        lines = t.split("\n")
        heads = [(k, m[1]) for k, x in enumerate(lines, 1) if (m := re.match("([A-Z][a-z]+)", x))]
        for n, (k, w) in enumerate(heads):
            last = heads[n + 1][0] - 1 if n + 1 < len(heads) else len(lines)
            want.append((i, n, w.lower(), ("class", "function", "method")[len(w) % 3], k, last, None, lines[k - 1][:60]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, standin.symbols(d).collect())) == want and len(want) > 50


def counted(spark, df):
    """df, and an accumulator that counts how often its rows are made."""
    n, kind = spark.sparkContext.accumulator(0), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    return df.mapInArrow(run, kind), n


def test_candidates_read_the_postings_once(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abeErR tio", k=rng.randrange(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    posts, n = counted(spark, trigram.postings(docs).cache())
    plan = [*trigram.ignore_case_plan("ere"), *trigram.literal_plan("tio")]
    got = {r.doc_id for r in trigram.candidates(posts, docs, plan).collect()}
    assert got == {i for i, t in enumerate(texts) if "ere" in t.lower() and "tio" in t} and n.value == trigram.postings(docs).count()
    only = trigram.postings(docs, plan)
    assert {r.doc_id for r in trigram.candidates(only, docs, plan).collect()} == got and only.select("tri").distinct().count() <= 9
    many = [[[f"{a:02x}{b:02x}{c:02x}"] for a in b"abeE" for b in b"abeE" for c in b"rRti"]]  # more trigrams than one number has bits
    assert {r.doc_id for r in trigram.candidates(posts, docs, many).collect()} == {i for i, t in enumerate(texts) if any(bytes.fromhex(g[0]).decode() in t for g in many[0])}
    assert trigram.candidates(posts, docs, trigram.literal_plan("zzzz")).count() == 0 and trigram.candidates(posts, docs, []).count() == 300


def test_an_index_makes_its_postings_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"p{i}", "x", 9, i, 0, 1, f"Word{i % 7} und Licht {i}\nZwei {i * 31}") for i in range(200)], "doc_id long, path string, lang string, size long, mtime_ns long, hash long, lines int, text string").repartition(3)
    made, counts = trigram.postings, []

    def postings(d, only=None):
        rows, n = counted(spark, made(d, only))
        counts.append(n)
        return rows

    monkeypatch.setattr(trigram, "postings", postings)
    index = store.Store(spark, f"file://{tmp_path}/index", lambda d: (standin.symbols(d), standin.refs(d)))
    index.full(docs)
    assert [n.value for n in counts] == [index.table("postings").count()] == [made(docs).count()]
    for f in (tmp_path / "index").glob("segment-1/postings/*.parquet"):
        rows = [(r.tri, r.doc_id) for r in spark.read.parquet(str(f)).collect()]
        assert rows == sorted(rows)
    q = search.Query("Licht 1")
    got = search.indexed(index.table("docs"), index.table("postings"), q, index.table("symbols")).collect()
    assert {r.path for r in got} == {f"p{i}" for i in range(200) if str(i).startswith("1")} if len(got) < 50 else len(got) == 50


def test_bm25_scan_reads_the_texts_once(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["nicht", "parsing", "parses", "fooBar", "a", "x_y", "Öl"], k=rng.randrange(0, 30))) for _ in range(500)]
    chunks, n = counted(spark, spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"))
    got = hybrid.bm25_scan(chunks, ["nicht", "pars", "bar"]).collect()
    assert n.value == 500
    assert got == hybrid.bm25(hybrid.terms(chunks), ["nicht", "pars", "bar"]).collect() and len(got) == 200


def test_terms_are_counted_where_the_chunks_lie(spark):
    rng = random.Random(5)
    letters = "abcXYZ019__ \n\x01\x02-.äÄßøØÉéªº²½ⅠⅣⅾⓐⓏΣσςİıKſǅǆ中文あアरा٣́😀sedings"
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(3000)] + ["", None, "HTTPServer parseConfig foo_bar_Baz x2Go running classes based s es ed ing king"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    found = hybrid.terms(chunks)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and "Aggregate" not in optimized(found)
    want = {(r.chunk_id, t): (r.s.count(t), len(r.s)) for r in chunks.select("chunk_id", hybrid.stems(F.col("text")).alias("s")).collect() for t in r.s or []}
    assert {(r.chunk_id, r.term): (r.tf, r.dl) for r in found.collect()} == want
