"""The engine against plain Python, on small fixtures and generated corpora."""

from __future__ import annotations

import json
import os
import random
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from quernstone import api
from quernstone.functions import regexlang, text as T, trigram
from quernstone.operators import callgraph, extract, hybrid, pack, search, symbols
from quernstone.sources import store, tree
from quernstone.streaming import watch

DOCS = "doc_id long, path string, lang string, size long, lines int, hash long, text string"


def docs_of(spark, files: dict[str, str]):
    rows = [(i, p, p.rsplit(".", 1)[-1] if "." in p else "other", len(t.encode()), t.count("\n") + (not t.endswith("\n") and t != ""), hash(t) % 10**9, t) for i, (p, t) in enumerate(files.items())]
    names = {"py": "python", "rs": "rust", "js": "javascript", "go": "go"}
    return spark.createDataFrame([(r[0], r[1], names.get(r[2], "other"), *r[3:]) for r in rows], DOCS)


def word_byte(c: str) -> bool:
    return c == "_" or c.isascii() and c.isalnum() or ord(c) >= 128


def scan(files: dict[str, str], q: search.Query) -> list[tuple[str, int, int]]:
    """Every line with a surviving match, by a plain matcher."""
    out = []
    flags = re.I if q.case_insensitive else 0
    p = re.compile(q.pattern if q.regex else re.escape(q.pattern), flags)
    for path, t in files.items():
        seen = set()
        for m in p.finditer(t):
            if m.start() == m.end():
                continue
            if q.whole_word and (m.start() and word_byte(t[m.start() - 1]) or m.end() < len(t) and word_byte(t[m.end()])):
                continue
            line = t.count("\n", 0, m.start()) + 1
            if line not in seen:
                seen.add(line)
                out.append((path, line, len(t[t.rfind("\n", 0, m.start()) + 1 : m.start()].encode()) + 1))
    return sorted(out)


def test_search_equals_a_plain_matcher(spark):
    rng = random.Random(1)
    words = "token tokenize toke tok ken parse_config parser pars arse load loader x.x ax.x.x é café tion".split()
    files = {p: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 8))) for p in ("src/main.rs", "lib/util.py", "app/handler.js", "pkg/server.go", "notes/readme.txt")}
    docs = docs_of(spark, files)
    posts = trigram.postings(docs).cache()
    cases = [("tok", False), ("parse", False), ("x.x", False), ("é", False), ("toke|tokenize", True), (r"t\w*", True), ("t.", True), (r"[a-z]+_[a-z]+", True), (r"x\s+", True), (r"e\n[a-z]", True), ("z*", True), ("ken tok", False)]
    for pattern, regex in cases:
        for ci, ww in ((False, False), (True, False), (False, True)):
            q = search.Query(pattern, regex, ci, ww, exhaustive=True)
            got = [(r.path, r.line, r.column) for r in search.search(docs, q).collect()]
            assert got == scan(files, q), q
            plan = trigram.regex_plan(pattern, ci) if regex else trigram.ignore_case_plan(pattern) if ci else trigram.literal_plan(pattern)
            assert [(r.path, r.line, r.column) for r in search.search(trigram.candidates(posts, docs, plan), q).collect()] == got, q


def test_case_folding_spans_and_caps(spark):
    files = {"a.txt": "ComputeSum\nCOMPUTESUM CAFÉRUNNER\nheader:\n  value\n", "b.txt": "\n".join(f"needle_{i}" for i in range(100))}
    docs = docs_of(spark, files)
    rows = lambda q: [(r.path, r.line, r.column) for r in search.search(docs, q).collect()]
    assert rows(search.Query("computesum", case_insensitive=True)) == [("a.txt", 1, 1), ("a.txt", 2, 1)]
    assert rows(search.Query("caférunner", case_insensitive=True)) == [("a.txt", 2, 12)]
    assert rows(search.Query(r"header:\s+value", regex=True)) == [("a.txt", 3, 1)]
    assert len(rows(search.Query("needle_"))) == 20 and rows(search.Query("needle_", exhaustive=True)) == [("b.txt", i + 1, 1) for i in range(100)]
    assert rows(search.Query("")) == [] and rows(search.Query("z*", regex=True)) == []


def test_display_cuts_bytes_at_characters(spark):
    lines = ["short  ", "é" * 200, "a" + "é" * 200, "ab" + "日" * 200, "x" * 320, "x" * 321, "\U0001f600" * 90]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(T.display(F.col("t"))).collect()]
    want = [x.rstrip() if len(x.rstrip().encode()) <= 320 else x.encode()[:320].decode(errors="ignore") + "…" for x in lines]
    assert got == want


@pytest.mark.parametrize("bad", ["(?=a)", "(?<!b)c", r"(a)\1", "a*+", "(?>a)", r"\Qa\E"])
def test_dialect_rejects(bad):
    with pytest.raises(regexlang.PatternError):
        regexlang.translate(bad)


def test_dialect_translates(spark):
    row = lambda p, t: spark.createDataFrame([(t,)], "t string").select(F.col("t").rlike(regexlang.translate(p))).first()[0]
    assert row(r"^\w$", "é") and row("a.b", "a\rb") and not row("b$", "ab\n") and row("(?P<n>a)b", "ab") and row("[]a]", "]")


def test_required_literals_hold():
    assert regexlang.required_literals("fn\\s+compute_\\w+") == ["compute_"]
    assert regexlang.required_literals("abc|def") == [] and regexlang.required_literals("(?i)abc") == []


@pytest.mark.parametrize("name,parts,acr", [("HTTPServerLoad", ["httpserver", "load"], "hl"), ("parse_config-file", ["parse", "config", "file"], "pcf"), ("x2Go", ["x2", "go"], "xg"), ("", [], "")])
def test_identifiers(spark, name, parts, acr):
    r = spark.createDataFrame([(name,)], "n string").select(T.split_identifier(F.col("n")), T.acronym(F.col("n"))).first()
    assert list(r[0]) == parts and r[1] == acr


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(T.line_count(F.lit(x))) for x in ("", "a", "a\n", "a\nb", "\n")] == [0, 1, 1, 2, 1]
    assert [one(T.stem(F.lit(x))) for x in ("ted", "sing", "boxes", "cats", "gas", "walking")] == ["t", "s", "box", "cat", "gas", "walk"]
    assert one(T.shared_prefix(F.lit("a/b/c"), F.lit("a/b/d"))) == 2 and one(T.shared_prefix(F.lit("a/b"), F.lit("a/b"))) == 2
    assert one(T.language_of(F.lit("x/Y.PYI"))) == "python" and one(T.language_of(F.lit("Makefile"))) == "other"
    assert abs(one(T.path_score(F.lit("a/tests/b/c.rs"))) + 1.15) < 1e-9
    assert [one(T.fuzzy_score(F.lit(n), "pc")) for n in ("PC", "pcx", "parse_config", "xpcx", "pxc", "q")] == [100, 70, 60, 50, 30, None]


PY = "import os.path as p\n\ndef helper(x):\n    return x\n\nclass Loader:\n    def load(self):\n        return helper(p.join('a'))\n\ndef main():\n    helper(1)\n    Loader().load()\n"
RS = "fn helper() {\n    1\n}\n\nfn main() {\n    helper();\n}\n\nimpl Thing {\n    pub fn go(&self) { self.run() }\n}\n"


@pytest.fixture(scope="module")
def code(spark):
    docs = docs_of(spark, {"lib/util.py": PY, "src/main.rs": RS, "web/a.js": "export const f = (x) => {\n  return g(x)\n}\nclass A {\n  m(y) {\n    f(y)\n  }\n}\n", "bad.py": "def broken(:\n  foo(1)\n"}).cache()
    s, r = extract.extract(docs)
    return docs, s.cache(), r.cache()


def test_extraction(code):
    docs, s, r = code
    got = {(x.doc_id, x.name, x.kind, x.line_start, x.line_end, x.container) for x in s.collect()}
    assert {(0, "helper", "function", 3, 4, None), (0, "Loader", "class", 6, 8, None), (0, "load", "method", 7, 8, "Loader"), (0, "main", "function", 10, 12, None)} <= got
    assert {(1, "helper", "function", 1, 3, None), (1, "main", "function", 5, 7, None), (1, "go", "method", 10, 10, "Thing")} <= got
    assert {(2, "f", "function", 1, 3, None), (2, "A", "class", 4, 8, None), (2, "m", "method", 5, 7, "A"), (3, "broken", "function", 1, 2, None)} <= got
    refs = {(x.doc_id, x.name, x.kind, x.line, x.column) for x in r.collect()}
    assert {(0, "helper", "call", 8, 16), (0, "join", "call", 8, 25), (0, "load", "call", 12, 14), (0, "os", "import", 1, 8), (1, "helper", "call", 6, 5), (2, "g", "call", 2, 10), (2, "f", "call", 6, 5)} <= refs


def test_graph(code):
    docs, s, r = code
    assert [(x.caller, x.path, x.line) for x in callgraph.callers(docs, s, r, "helper").collect()] == [("load", "lib/util.py", 8), ("main", "lib/util.py", 11), ("main", "src/main.rs", 6)]
    assert {x.callee for x in callgraph.callees(docs, s, r, "main").collect()} == {"helper", "Loader", "load"}
    hit = {(x.name, x.distance) for x in callgraph.impact(docs, s, r, "helper").collect()}
    assert hit == {("helper", 0), ("load", 1), ("main", 1)}
    kinds = [x.kind for x in callgraph.resolved_references(docs, s, r, "helper").collect()]
    assert kinds == ["definition"] * 2 + ["call"] * 3
    found = callgraph.definition(docs, s, r, "src/main.rs", "helper", is_call=True).collect()
    assert (found[0].path, found[0].line_start, found[0].resolved) == ("src/main.rs", 1, True)
    assert {x.kind for x in callgraph.definition(docs, s, r, "src/main.rs", "self").collect()} == {"text"}


def test_symbols_and_snippets(code):
    docs, s, _ = code
    assert [x.name for x in symbols.outline(docs, s, "lib/util.py").collect()] == ["helper", "Loader", "load", "main"]
    assert symbols.lookup(docs, s, "LOADER", exact=True).count() == 1 and symbols.lookup(docs, s, "lo", kind="method").first().name == "load"
    x = symbols.snippet(docs, "src/main.rs", 5, 999).first()
    assert (x.start_line, x.end_line, x.total_lines) == (5, 11, 11)
    x = symbols.snippet(docs, "src/main.rs", 500, 600).first()
    assert (x.start_line, x.end_line, x.text) == (11, 11, "}")
    for bad in ("/etc/passwd", "../x", "a/../../b", ""):
        with pytest.raises(ValueError):
            symbols.snippet(docs, bad, 1, 1)


def test_structure_and_identifiers(code):
    docs, _, _ = code
    got = extract.structural(docs, "def $NAME(self): $$$", "python").collect()
    assert [(x.path, x.line_start, x.captures[0].text) for x in got] == [("lib/util.py", 7, "load")]
    assert [x.captures[0].text for x in extract.structural(docs, "fn $NAME() {}", "rust").collect()] == ["helper", "main"]
    with pytest.raises(ValueError):
        extract.structural(docs, "(call) @x", "rust")
    assert extract.identifier_at(RS, "rust", 6, 6)[:3] == ("helper", True, False)
    assert extract.identifier_at(PY, "python", 12, 15)[:3] == ("load", True, True) and extract.identifier_at(PY, "python", 99, 1) is None


def test_pack(code):
    docs, s, r = code
    got = pack.pack(docs, s, r, "how does load call the helper", 8000).collect()
    assert {"load", "helper"} <= {x.name for x in got} and got[0].used_tokens == sum(x.cost for x in got)
    tiny = pack.pack(docs, s, r, "load helper", 1).collect()
    assert len(tiny) == 1 and tiny[0].truncated


def test_hybrid(spark, code):
    docs, s, _ = code
    assert [(a.line_start, a.line_end) for a in spark.range(1).select(F.explode(hybrid.windows(F.lit(1), F.lit(100), 50, 8)).alias("w")).select("w.*").collect()] == [(1, 50), (43, 92), (85, 100)]
    own = {(x.doc_id, x.sym_idx): [] for x in s.collect()}
    for x in hybrid.own_intervals(s).collect():
        own[(x.doc_id, x.sym_idx)].append((x.line_start, x.line_end))
    assert sorted(own[(0, 1)]) == [(6, 6)]
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "text")
    best = hybrid.bm25(hybrid.terms(chunks), ["helper"]).first().chunk_id
    assert best in (0, 1)
    e = hybrid.hash_embedding(chunks, 64).collect()
    assert all(len(x.embedding) == 64 and abs(sum(v * v for v in x.embedding) - 1) < 1e-5 for x in e)


# sources and the store


def put(root, files):
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(t if isinstance(t, bytes) else t.encode())


def test_tree(spark, tmp_path):
    put(tmp_path, {"a.py": "x = 1\n", "b/c.rs": "fn a() {}\n", ".hid/x.py": "1", "skip/me.py": "1", "bin.dat": b"a\0b", "nul.txt": "p\x10\x00q".replace("\x00", ""), "big.txt": "x" * 200, "empty.txt": "", ".gitignore": "skip/\n*.log\n!keep.log\n", "z.log": "1", "keep.log": "1", "node_modules/m.js": "1", "bad.txt": b"caf\xe9 x"})
    docs, skipped = tree.read(spark, str(tmp_path), tree.Config(max_file_size=100))
    got = {r.path: r for r in docs.collect()}
    assert set(got) == {"a.py", "b/c.rs", "nul.txt", "keep.log", "bad.txt"} and got["b/c.rs"].lang == "rust" and got["bad.txt"].text.endswith(" x")
    why = {r.rel: r.reason for r in skipped.collect()}
    assert why["bin.dat"] == "binary" and why["big.txt"] == "too_large" and why["empty.txt"] == "empty" and why["z.log"] == "ignored" and why["skip/me.py"] == "ignored" and why["node_modules/m.js"] == "excluded"
    assert "bin.dat" in {r.path for r in tree.read(spark, str(tmp_path), tree.Config(index_binary=True))[0].collect()}


def test_engine_follows_changes(spark, tmp_path):
    put(tmp_path, {"a.py": "def alpha():\n    beta()\n", "b.py": "def beta():\n    pass\n"})
    e = api.Engine(spark, str(tmp_path))
    assert e.reindex()["added"] == 2 and e.status()["doc_count"] == 2 and not e.is_dirty()
    put(tmp_path, {"a.py": "def alpha2():\n    beta()\n    return 1\n", "c.py": "def gamma(): pass\n"})
    (tmp_path / "b.py").unlink()
    assert e.is_dirty()
    counts = e.reindex()
    assert (counts["added"], counts["changed"], counts["deleted"]) == (1, 1, 1)
    after = {(r.path, r.name) for r in e.docs.join(e.symbols_table, "doc_id").collect()}
    assert after == {("a.py", "alpha2"), ("c.py", "gamma")}
    e.compact()
    assert e.status()["segments"] == 1 and {r.name for r in e.symbols_table.collect()} == {"alpha2", "gamma"}
    assert [r.path for r in e.search(search.Query("gamma")).collect()] == ["c.py"]
    (tmp_path / api.tree.INDEX_DIR / "manifest.json").write_text("{broken")
    assert [r.path for r in e.search(search.Query("gamma")).collect()] == ["c.py"]
    assert e.ensure_indexed() and e.status()["doc_count"] == 2
    assert api.request(e, {"method": "Outline", "path": "c.py"})[0]["name"] == "gamma"
    assert api.discover(str(tmp_path / "x" / "y")) == str(tmp_path)
    with pytest.raises(ValueError):
        api.inside(str(tmp_path), "/etc")


def test_a_crash_before_the_swap_changes_nothing(spark, tmp_path, monkeypatch):
    put(tmp_path, {"a.py": "def a(): pass\n"})
    e = api.Engine(spark, str(tmp_path))
    e.reindex()
    put(tmp_path, {"a.py": "def b(): pass  # longer\n"})
    with monkeypatch.context() as m:
        m.setattr(store.Folder, "swap", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            e.reindex()
    assert {r.name for r in e.symbols_table.collect()} == {"a"}
    e.reindex()
    assert {r.name for r in e.symbols_table.collect()} == {"b"}


def test_moved_files_keep_their_symbols(spark, tmp_path, monkeypatch):
    put(tmp_path, {"a.py": "def alpha():\n    beta()\n", "b.py": "def beta():\n    pass\n"})
    e = api.Engine(spark, str(tmp_path))
    e.reindex()
    (tmp_path / "a.py").rename(tmp_path / "moved.py")
    put(tmp_path, {"c.py": "def gamma():\n    alpha()\n"})
    seen = []
    inner = e.store.extract
    e.store.extract = lambda d: seen.extend(r.path for r in d.collect()) or inner(d)
    counts = e.reindex()
    assert counts["renamed"] == 1 and seen == ["c.py"]
    got = {(r.path, r.name) for r in e.docs.join(e.symbols_table, "doc_id").collect()}
    assert got == {("moved.py", "alpha"), ("b.py", "beta"), ("c.py", "gamma")}
    assert {r.path for r in e.callers("beta").collect()} == {"moved.py"}
    assert [r.path for r in e.search(search.Query("def alpha")).collect()] == ["moved.py"]


def test_files_that_look_the_same_are_not_opened(spark, tmp_path):
    put(tmp_path, {"a.py": "x = 1\n", "b.py": "y = 2\n"})
    e = api.Engine(spark, str(tmp_path))
    e.reindex()
    stat = (tmp_path / "a.py").stat()
    (tmp_path / "a.py").write_text("x = 9\n")  # same size; the time is set back
    os.utime(tmp_path / "a.py", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert not e.is_dirty() and "changed" not in e.reindex()
    os.utime(tmp_path / "a.py")
    assert e.is_dirty() and e.reindex()["changed"] == 1 and e.search(search.Query("x = 9")).count() == 1
    os.utime(tmp_path / "b.py")
    assert not e.is_dirty() and e.reindex()["touched"] == 1


def test_a_damaged_index_is_noticed(spark, tmp_path):
    put(tmp_path, {"a.py": "def alpha():\n    pass\n"})
    e = api.Engine(spark, str(tmp_path))
    e.reindex()
    e.verify()
    folder = tmp_path / api.tree.INDEX_DIR / "segment-1" / "postings"
    part = next(x for x in folder.iterdir() if x.suffix == ".parquet")
    good = part.read_bytes()
    part.write_bytes(good[:40] + bytes([good[40] ^ 1]) + good[41:])
    for x in folder.glob(".*.crc"):
        x.write_bytes(b"")
    with pytest.raises(store.Corrupt):
        e.verify()
    part.unlink()
    with pytest.raises(store.Corrupt):
        e.store.check()
    assert [(r.path, r.score) for r in e.search(search.Query("alpha")).collect()] == [("a.py", 1.0)]  # a scan: no bonus
    e.reindex()  # built anew
    e.verify()
    assert [(r.path, r.score) for r in e.search(search.Query("alpha")).collect()] == [("a.py", 4.0)]


def test_indexed_search_reads_candidates_alone(spark, tmp_path):
    rng = random.Random(4)
    put(tmp_path, {f"d/f{i}.txt": " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 40)) for _ in range(30)) for i in range(40)})
    e = api.Engine(spark, str(tmp_path))
    e.reindex()
    posts = e.store.table("postings")
    for q in (search.Query("alpha7", exhaustive=True), search.Query("GAMMA1", case_insensitive=True, exhaustive=True), search.Query(r"beta3\d", regex=True, exhaustive=True), search.Query("zz9", exhaustive=True), search.Query("a1", exhaustive=True)):
        want = [tuple(r) for r in search.search(e.docs, q, e.symbols_table).collect()]
        assert [tuple(r) for r in search.indexed(e.docs, posts, q, e.symbols_table).collect()] == want == [tuple(r) for r in e.search(q).collect()]
    few = trigram.candidates(posts, e.docs, search.plan(search.Query("alpha7"))).count()
    assert few < 40


def test_semantic_index_is_kept(spark, tmp_path):
    put(tmp_path, {"billing/invoice_total.py": "def invoice_total(rows):\n    return sum(rows)\n", "src/parse.py": "def parse_config(path):\n    return open(path).read()\n", "notes.txt": "nothing of note\n"})
    e = api.Engine(spark, str(tmp_path))
    e.reindex()
    assert e.build_semantic() == 3
    at = e._semantic()
    assert e.semantic_search("invoice total").first().path == "billing/invoice_total.py" and e._semantic() == at
    assert e.semantic_search("parse_config").first().name == "parse_config"
    put(tmp_path, {"src/parse.py": "def parse_other(path):\n    return 1\n"})
    e.reindex()
    assert e.semantic_search("parse_other").first().name == "parse_other" and e._semantic() != at


def test_static_model(spark, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer, models, pre_tokenizers

    from quernstone.operators import static_model

    vocab = {"[UNK]": 0, "invoice": 1, "total": 2, "parse": 3, "config": 4}
    t = Tokenizer(models.WordLevel(vocab, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    folder = tmp_path / "model"
    folder.mkdir()
    t.save(str(folder / "tokenizer.json"))
    table = np.array([[9, 9], [1, 0], [0.5, 0.5], [0, 1]], np.float16)
    parts = {"embeddings": table, "mapping": np.array([0, 1, 2, 3, 3], np.int64), "weights": np.array([1, 2, 1, 1, 1], np.float64)}
    head, at = {}, 0
    for k, v in parts.items():
        head[k] = {"dtype": {"float16": "F16", "int64": "I64", "float64": "F64"}[str(v.dtype)], "shape": list(v.shape), "data_offsets": [at, at + v.nbytes]}
        at += v.nbytes
    raw = json.dumps(head).encode()
    (folder / "model.safetensors").write_bytes(len(raw).to_bytes(8, "little") + raw + b"".join(v.tobytes() for v in parts.values()))
    m = static_model.StaticModel(str(folder))
    mean = np.array([2 + 0.5, 0.5]) / 2
    assert np.allclose(m.embed(["invoice total nothing", "zzz", "config"]), [mean / np.linalg.norm(mean), [0, 0], [0, 1]], atol=1e-6)
    (folder / "config.json").write_text('{"normalize": false}')
    assert np.allclose(static_model.StaticModel(str(folder)).embed(["invoice total"]), [mean], atol=1e-6)
    with pytest.raises(ValueError):
        static_model.tensors(b"short")
    put(tmp_path / "src", {"a.py": "def invoice(rows):\n    return total\n", "b.py": "def parse(path):\n    return config\n"})
    e = api.Engine(spark, str(tmp_path / "src"), model=str(folder))
    e.reindex()
    assert e.semantic_search("config parse").first().path == "b.py"


def test_serve(spark, tmp_path):
    put(tmp_path, {"a.py": "def alpha():\n    pass\n"})
    out = []
    lines = ['{"method": "ping", "id": 1}', "", '{"method": "reindex"}', '{"method": "search", "pattern": "alpha"}', '{"method": "nope", "id": 5}', "{", '{"method": "semanticSearch", "query": "alpha"}']
    api.serve(lambda root: api.Engine(spark, str(tmp_path)), lines, lambda x: out.append(json.loads(x)))
    assert out[0] == {"id": 1, "result": "pong"} and out[1]["result"]["added"] == 1 and out[2]["result"][0]["path"] == "a.py"
    assert out[3]["id"] == 5 and "nope" in out[3]["error"] and "error" in out[4] and out[5]["result"][0]["name"] == "alpha"


def test_savings_log_is_trimmed(spark, tmp_path, monkeypatch):
    put(tmp_path, {"a.py": "def alpha():\n    pass\n"})
    e = api.Engine(spark, str(tmp_path))
    e.reindex()
    hits = e.search(search.Query("alpha"))
    for now in (100, 200, 300):
        monkeypatch.setattr(api.time, "time", lambda now=now: now)
        e.record_savings(hits, "search")
    assert e.savings_report()[1].first().queries == 3
    monkeypatch.setattr(api, "LOG_BYTES", 10)
    monkeypatch.setattr(api.time, "time", lambda: 400)
    e.record_savings(hits, "search")
    assert e.savings_report()[1].first().queries == 3  # of four, those from the middle on


def test_index_counters_and_tokens(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.semantic_tokens(F.lit("parseConfig a_bc x2Go HTTP"))) == ["parse", "config", "parseconfig", "bc", "a_bc", "x2", "go", "x2go", "http", "http"]
    assert one(T.path_tokens(F.lit("packages/core/src/middleware/flipTable.ts"))) == ["flip", "table", "fliptable"]
    assert one(T.path_tokens(F.lit("wms/stock_channel/models/index.py"))) == ["wms", "wms", "stock", "channel", "stock_channel"]
    assert T.task_terms("Add the StockRelease code, and fix its use") == ["stock", "release", "its"]
    assert abs(one(T.noise_penalty(F.lit("a/tests/legacy/README.md"))) - 0.102) < 1e-9 and one(T.noise_penalty(F.lit("contests/latest.py"))) == 0


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    put(tmp_path, {"a.py": "def f():\n    return 1\n"})
    run("add", "a.py")
    run("commit", "-qm", "first")
    put(tmp_path, {"a.py": "def f():\n    return 2\n"})
    run("commit", "-qam", "second")
    e = api.Engine(spark, str(tmp_path))
    e.reindex()
    assert e.blame("a.py", 2).first().summary == "second"
    assert [r.summary for r in e.history("f").collect()] == ["second", "first"]
    assert [(r.path, r.status, list(r.symbols)) for r in e.changed_since("HEAD~1").collect()] == [("a.py", "M", ["f"])]
    assert tree.head(str(tmp_path)) and tree.head("/") is None


def test_compaction_plan(spark):
    sizes = spark.createDataFrame([(i, 10 + i) for i in range(6)], "segment int, n int")
    assert {r.segment for r in store.compaction_plan(sizes, 4).collect()} == {0, 1, 2, 3, 4}
    assert store.compaction_plan(sizes, 6).count() == 0


def test_stream_events(spark):
    state = spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int")
    batch = spark.createDataFrame([("a", 9, 2, "put"), ("a", 8, 1, "put"), ("b", 0, 3, "delete"), ("c", 5, 4, "put")], "path string, v int, seq int, op string")
    assert {(r.path, r.v) for r in watch.apply(state, batch).collect()} == {("a", 9), ("c", 5)}


@pytest.mark.parametrize("name", ["structural_match", "blast_radius"])
def test_whole_results_have_no_row_cap(spark, name):
    from quernstone.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan


def test_extraction_queries_see_all_words(spark):
    from quernstone.queries import more

    d = more._sources(spark, "/root/testdata/sf0.001").limit(20).cache()
    s, r = more.X.extract(d)
    words = {x.doc_id: x.text.count("\ndef ") for x in d.collect()}
    defs = {x.doc_id: x["count"] for x in s.where("kind = 'function'").groupBy("doc_id").count().collect()}
    assert max(words.values()) > 50 and {i: n for i, n in words.items() if n} == defs
