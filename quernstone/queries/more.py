"""Packs, retrieval, maintenance, savings and extraction queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import shared
from ..functions import text as T
from ..operators import extract as X, hybrid as H, pack as K, savings as A, symbols as Y
from ..plans import standin
from ..plans.standin import PATH_SCORE, SQL
from ..sources import store, tree
from ..streaming import watch

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def add(name: str, sql: str | None = None, bare: bool = False):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql if bare else SQL + sql
        return fn

    return keep


TASK = "thble onthat nicht"
_lex = " + ".join(f"CASE WHEN name = '{t}' THEN 20 WHEN contains(name, '{t}') THEN 6 ELSE 0 END + CASE WHEN contains(lower(signature), '{t}') THEN 3 ELSE 0 END + CASE WHEN contains(lower(path), '{t}') THEN 2 ELSE 0 END" for t in T.task_terms(TASK))
_cand = f""", lx AS (SELECT s.*, path, lang, {_lex} AS l0 FROM symbols s JOIN docs USING (doc_id)),
 deg AS (SELECT name, count(*) AS n FROM refs GROUP BY name),
 cand AS MATERIALIZED (SELECT lx.* EXCLUDE (l0), CAST(round(l0 + CASE WHEN kind IN ('function', 'method', 'struct', 'class', 'trait', 'interface', 'enum', 'type', 'constructor', 'module') THEN 2 ELSE 0 END + ln(1 + coalesce(n, 0)) * 1.5 + {PATH_SCORE}, 4) AS DOUBLE) AS score, 'match' AS reason FROM lx LEFT JOIN deg USING (name) WHERE l0 > 0)"""


def _code(fn, refs: bool = True):
    def run(s, p):
        d = standin.docs(s, p)
        return fn(d, standin.symbols(d), standin.refs(d)) if refs else fn(d, standin.symbols(d))

    return run


add("lexical_score", _cand + " SELECT doc_id, sym_idx, path, name, kind, line_start, score FROM cand")(_code(lambda d, y, r: K.candidates(d, y, r, TASK).select("doc_id", "sym_idx", "path", "name", "kind", "line_start", "score")))
add(
    "context_pack",
    _cand
    + """, seeds AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, sym_idx) AS seed FROM (SELECT * FROM cand ORDER BY score DESC, doc_id, sym_idx LIMIT 8)),
 ca AS (SELECT seed, s.name AS of_, s.score AS f, r.name, row_number() OVER (PARTITION BY seed ORDER BY r.name, s.path, r.line, r."column") AS rn FROM refs r JOIN seeds s ON s.doc_id = r.doc_id AND r.line BETWEEN s.line_start AND s.line_end),
 nb AS (SELECT y.*, d.path, d.lang, f, of_, row_number() OVER (PARTITION BY y.name, y.line_start ORDER BY seed, rn, y.doc_id, y.sym_idx) AS k FROM symbols y JOIN ca ON ca.name = y.name AND ca.rn <= 12 JOIN docs d ON d.doc_id = y.doc_id),
 al AS (SELECT doc_id, sym_idx, path, lang, name, kind, line_start, line_end, signature, score, reason FROM cand
  UNION ALL SELECT doc_id, sym_idx, path, lang, name, kind, line_start, line_end, signature, CAST(round(f * 0.3, 4) AS DOUBLE), 'callee of ' || of_ FROM nb WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM cand c WHERE c.name = nb.name AND c.line_start = nb.line_start)),
 it AS MATERIALIZED (SELECT al.*, array_to_string(string_split(text, chr(10))[line_start:least(line_end, line_start + 60)], chr(10)) AS code, CAST(row_number() OVER (ORDER BY score DESC, doc_id, sym_idx) AS INT) AS rank FROM al JOIN docs USING (doc_id, path, lang)),
 ic AS MATERIALIZED (SELECT *, CAST(greatest(1, (strlen(code) + strlen(coalesce(signature, ''))) // 4) AS INT) AS cost FROM it),
 go AS (SELECT 1 AS r, cost AS used, true AS took, false AS cut FROM ic WHERE rank = 1
  UNION ALL SELECT r + 1, CASE WHEN used < 2000 AND used + cost <= 2000 THEN used + cost ELSE used END, used < 2000 AND used + cost <= 2000, cut OR NOT (used < 2000 AND used + cost <= 2000) FROM go JOIN ic ON rank = r + 1)
 SELECT CAST(row_number() OVER (ORDER BY rank) AS INT) AS rank, path, lang, name, kind, line_start, line_end, code, reason, score, cost, (SELECT max(used) FROM go) AS used_tokens, (SELECT bool_or(cut) FROM go) AS truncated FROM ic JOIN go ON r = rank WHERE took""",
)(_code(lambda d, y, r: K.pack(d, y, r, TASK, 2000)))

# chunks and retrieval
_win = """unnest(list_transform(generate_series(0, CASE WHEN e - b + 1 <= {s} THEN 0 ELSE CAST(ceil((e - b + 1 - {s}) / {t}.0) AS INT) END), lambda i: {{'a': CAST(b + i * {t} AS INT), 'z': CAST(least(b + i * {t} + {s} - 1, e) AS INT)}}))"""
def _nested(d, y):
    """Stand-in nesting: each file's first symbol holds all lines from its own on, the others keep half of theirs."""
    last = d.select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    half = F.col("line_start") + F.expr("(line_end - line_start) div 2").cast("int")
    return y.join(last, "doc_id").withColumn("line_end", F.when(F.col("sym_idx") == 0, F.col("n")).otherwise(half)).drop("n")


_own = """, ns AS MATERIALIZED (SELECT s.* EXCLUDE (line_end), CASE WHEN sym_idx = 0 THEN CAST(len(string_split(text, chr(10))) AS INT) ELSE line_start + (line_end - line_start) // 2 END AS line_end FROM symbols s JOIN docs USING (doc_id)),
 ln AS (SELECT doc_id, sym_idx, line_start AS a, line_end AS z, unnest(generate_series(line_start, line_end)) AS line FROM ns),
 own AS (SELECT doc_id, sym_idx, line FROM ln WHERE NOT EXISTS (SELECT 1 FROM ns i WHERE i.doc_id = ln.doc_id AND i.line_start >= ln.a AND i.line_end <= ln.z AND i.line_end - i.line_start < ln.z - ln.a AND ln.line BETWEEN i.line_start AND i.line_end)),
 g AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id, sym_idx ORDER BY line) AS g FROM own),
 iv AS (SELECT doc_id, sym_idx, CAST(min(line) AS INT) AS line_start, CAST(max(line) AS INT) AS line_end FROM g GROUP BY doc_id, sym_idx, g)"""
add("own_intervals", _own + " SELECT * FROM iv")(_code(lambda d, y: H.own_intervals(_nested(d, y)), refs=False))
add("chunk_windows", _own + f""", w AS (SELECT doc_id, sym_idx, name, kind, signature, b, {_win.format(s=50, t=42)} AS w FROM (SELECT ns.*, iv.line_start AS b, iv.line_end AS e FROM iv JOIN ns USING (doc_id, sym_idx) WHERE iv.line_end - iv.line_start >= 2 OR (iv.line_start = ns.line_start AND iv.line_end = ns.line_end))),
 f AS (SELECT doc_id, -1 AS sym_idx, 'doc_' || doc_id AS name, 'file' AS kind, {_win.format(s=80, t=72)} AS w FROM (SELECT *, 1 AS b, least(lines, 800) AS e FROM docs ANTI JOIN symbols USING (doc_id) WHERE lines > 0))
 SELECT doc_id, sym_idx, name, kind, w.a AS line_start, w.z AS line_end, CASE WHEN w.a = b THEN signature END AS signature FROM w UNION ALL SELECT doc_id, sym_idx, name, kind, w.a, w.z, NULL FROM f""")(_code(lambda d, y: H.symbol_chunks(_nested(d, y)).unionByName(H.file_chunks(d, y)), refs=False))

#: Tokens of a text, as (…, t): parts of each word and the word, then stems. {0}: a query of (k, text).
_stems = """SELECT k, CASE WHEN t LIKE '%ing' AND strlen(t) >= 4 THEN left(t, -3) WHEN t LIKE '%ed' AND strlen(t) >= 3 THEN left(t, -2) WHEN t LIKE '%es' AND strlen(t) >= 3 THEN left(t, -2) WHEN t LIKE '%s' AND strlen(t) >= 4 THEN left(t, -1) ELSE t END AS t
 FROM (SELECT k, unnest(list_concat(string_split_regex(lower(w), '[_\x01]'), [replace(lower(w), '\x01', '')])) AS t
  FROM (SELECT k, unnest(regexp_extract_all(regexp_replace(text, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1\x01\\2', 'g'), '[\\p{{L}}\\p{{N}}_\x01]+')) AS w FROM ({0}))) WHERE strlen(t) >= 2"""
add("terms", ", st AS (" + _stems.format("SELECT doc_id AS k, text FROM docs") + "), n AS (SELECT k, count(*) AS dl FROM st GROUP BY k) SELECT k AS chunk_id, t AS term, count(*) AS tf, CAST(any_value(dl) AS INT) AS dl FROM st JOIN n USING (k) GROUP BY k, t")(lambda s, p: H.terms(_whole(standin.docs(s, p))))


def _whole(d):
    """Each document as one chunk."""
    return d.select(F.col("doc_id").alias("chunk_id"), "path", "text")


_PARTS = ("Stock", "releaseChannel", "src", "HTTPServer", "tests", "x2Go", "vendor", "legacy", "docs", "i18n", "static", "lib", "compat", "examples", "website", "feature-flags", "__tests__", "spec", "Models", "wms")
_FILES = ("index.ts", "flipTable.ts", "README.md", "a.spec.js", "mod.rs", "locale.po", "site.css", "conf.yaml", "LICENSE", "changelog.txt", "types.d.ts", "app.min.js", "data.csv", "Main.java", "lib.rs", "stock_release.py", "guide.mdx", "noext", "test_it.py", "notice.xml")


def _paths(s, p):
    """A path of three folders and a file for each part, over all pairs of rules in time."""
    part = s.read.parquet(f"{p}/part.parquet").select("p_partkey")
    return part.select("p_partkey", F.concat_ws("/", _choose(_PARTS, 1), _choose(_PARTS, 7), _choose(_PARTS, 20), _choose(_FILES, 3)).alias("path"))


def _pick(xs, k):
    return f"(['{"','".join(xs)}'])[(p_partkey // {k}) % {len(xs)} + 1]"


_DIRS = "src lib libs pkg app apps core internal packages common components component modules module utils util helpers helper shared main include includes test tests spec specs __tests__ fixtures examples example demo mocks __mocks__ migrations generated gen dist build target out node_modules vendor models model views view controllers controller services service handlers handler routes router middleware middlewares data static assets public security report reports wizard wizards i18n locale locales"
add("path_signals", f"""WITH p AS (SELECT p_partkey, {_pick(_PARTS, 1)} || '/' || {_pick(_PARTS, 7)} || '/' || {_pick(_PARTS, 20)} || '/' || {_pick(_FILES, 3)} AS path FROM part),
 q AS (SELECT *, lower(path) AS l, string_split(CASE WHEN contains(path, '.') THEN regexp_extract(path, '^(.*)[.]', 1) ELSE path END, '/') AS seg FROM p),
 kept AS (SELECT p_partkey, unnest(list_filter(list_transform(seg, lambda x, i: CASE WHEN i < len(seg) AND lower(x) IN ('{"','".join(_DIRS.split())}') THEN NULL WHEN i = len(seg) AND lower(x) IN ('index', 'mod', '__init__', 'main', 'lib') THEN NULL ELSE x END), lambda x: x IS NOT NULL)) AS w FROM q),
 t AS (SELECT p_partkey, unnest(list_concat(string_split_regex(lower(m), '[_\x01]'), [lower(w)])) AS t FROM (SELECT *, regexp_replace(w, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1\x01\\2', 'g') AS m FROM kept))
 SELECT q.p_partkey, path, coalesce((SELECT list(t ORDER BY t) FROM t WHERE t.p_partkey = q.p_partkey AND strlen(t) >= 2), []) AS tokens,
  CAST(round(CASE WHEN regexp_matches(l, '/test|test/|__tests__|[.]test[.]|[.]spec[.]|/spec/') THEN 0.04 ELSE 0 END + CASE WHEN regexp_matches(l, '/(legacy|compat|examples)/') THEN 0.012 ELSE 0 END
   + CASE WHEN regexp_matches(l, '[.]min[.]|[.]d[.]ts$|/vendor/|/lib/') THEN 0.016 ELSE 0 END + CASE WHEN regexp_matches(l, '/static/|[.]css$') THEN 0.01 ELSE 0 END + CASE WHEN regexp_matches(l, '[.]pot?$|/i18n/') THEN 0.045 ELSE 0 END
   + CASE WHEN regexp_matches(l, '[.](rst|md|mdx|markdown|mdown|rdoc|adoc|txt)$|/readme|/(docs|doc|website|documentation)/') THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches(l, '[.](xml|csv|cfg|ini|toml|yaml|yml)$') THEN 0.022 ELSE 0 END
   + CASE WHEN regexp_matches(l, '/(license|copying|notice|authors|changelog)[^/]*$') THEN 0.03 ELSE 0 END, 6) AS DOUBLE) AS noise FROM q""", bare=True)(lambda s, p: _paths(s, p).select("p_partkey", "path", F.array_sort(T.path_tokens(F.col("path"))).alias("tokens"), F.round(T.noise_penalty(F.col("path")), 6).alias("noise")))
_KINDS = ("function", "constructor", "field", "module", "method", "const", "type", "trait")
_TASK = "Add the stock release, and fix how a BrownAlmond method should make code"
_TERMS = ("stock", "release", "brown", "almond")
add("task_relevance", f"""WITH p AS (SELECT p_partkey, {_pick(_KINDS, 1)} AS kind, replace(p_name, ' ', '_') AS name, p_type AS signature, p_brand AS container, {_pick(_PARTS, 1)} || '/' || {_pick(_FILES, 3)} AS path FROM part),
 c AS (SELECT *, string_split_regex(lower(regexp_replace(name, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1_\\2', 'g')), '[_\\- ]+') AS np, string_split_regex(lower(regexp_replace(container, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1_\\2', 'g')), '[_\\- ]+') AS cp FROM p),
 s AS (SELECT p_partkey, kind, {" + ".join(f"CASE WHEN lower(name) = '{t}' THEN 20 WHEN list_contains(np, '{t}') THEN 12 WHEN contains(lower(name), '{t}') THEN 6 ELSE 0 END + CASE WHEN list_contains(cp, '{t}') THEN 4 ELSE 0 END + CASE WHEN contains(lower(signature), '{t}') THEN 3 ELSE 0 END + CASE WHEN contains(lower(path), '{t}') THEN 2 ELSE 0 END" for t in _TERMS)} AS v FROM c)
 SELECT p_partkey, CAST(v + CASE WHEN v > 0 AND kind IN ('function', 'method', 'struct', 'class', 'trait', 'interface', 'enum', 'type', 'constructor', 'module') THEN 2 ELSE 0 END AS DOUBLE) AS score FROM s""", bare=True)(
    lambda s, p: s.read.parquet(f"{p}/part.parquet").select("p_partkey", T.lexical_score(F.replace("p_name", F.lit(" "), F.lit("_")), _choose(_KINDS, 1), F.col("p_type"), F.col("p_brand"), F.concat_ws("/", _choose(_PARTS, 1), _choose(_FILES, 3)), T.task_terms(_TASK)).alias("score"))
)


def _choose(xs, k):
    return F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.expr(f"p_partkey div {k}"), F.lit(len(xs))) + 1).cast("int"))


_Q = ["nicht", "thble", "antion"]
_bm = ", st AS MATERIALIZED (" + _stems.format("SELECT doc_id AS k, text FROM docs") + f"""), dl AS (SELECT k AS chunk_id, count(*) AS dl FROM st GROUP BY 1), sz AS (SELECT count(*) AS n, greatest(avg(dl), 1.0) AS a FROM dl),
 h AS (SELECT k AS chunk_id, t AS term, count(*) AS tf FROM st WHERE t IN ('{"','".join(_Q)}') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
 bm AS (SELECT chunk_id, CAST(round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 4) AS DOUBLE) AS score FROM h JOIN df USING (term) JOIN dl USING (chunk_id), sz GROUP BY chunk_id HAVING score > 0 ORDER BY score DESC, chunk_id LIMIT 200)"""
_vec = """, q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0), vt AS (SELECT vec_id AS chunk_id, CAST(round(list_sum(list_transform(list_zip(embedding, qe), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 4) AS DOUBLE) AS score FROM embeddings, q ORDER BY score DESC, chunk_id LIMIT 200)"""
_rrf = f"""{_bm}{_vec}, ra AS (SELECT chunk_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, chunk_id)) AS a FROM bm), rb AS (SELECT chunk_id, 2.5 / (60 + row_number() OVER (ORDER BY score DESC, chunk_id)) AS b FROM vt),
 fu AS (SELECT coalesce(ra.chunk_id, rb.chunk_id) AS chunk_id, CAST(round(coalesce(a, 0) + coalesce(b, 0), 8) AS DOUBLE) AS score FROM ra FULL JOIN rb ON ra.chunk_id = rb.chunk_id)"""


def _bm25(s, p):
    return H.bm25_scan(_whole(standin.docs(s, p)), _Q)


def _vectors(s, p):
    e = s.read.parquet(f"{p}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = e.where("chunk_id = 0").select(F.col("embedding").alias("qe"))
    return H.vector_topk(e.crossJoin(F.broadcast(q)), F.col("qe"))


add("bm25_topk", _bm + " SELECT * FROM bm")(_bm25)
add("vector_topk", _vec + " SELECT * FROM vt")(_vectors)
add("rrf_fusion", _rrf + " SELECT * FROM fu")(lambda s, p: H.fuse(_bm25(s, p), _vectors(s, p), H.weights("where is nicht thble")))


_ASK = "nicht thble doc src1 de"


@add("hybrid_rerank", _rrf + f""", c AS (SELECT fu.*, path, lang, doc_id % 3 = 0 AS def, count(*) OVER (PARTITION BY path) AS many, 1 + CASE WHEN lang = 'de' THEN 1 ELSE 0 END + CASE WHEN path LIKE 'src1/%' THEN 1 ELSE 0 END AS p, CASE WHEN doc_id % 3 = 0 THEN 'doc' ELSE 'doc_' || doc_id END AS name, 1 AS line_start FROM fu JOIN docs ON doc_id = chunk_id)
 SELECT path, name, line_start, CAST(round(score + CASE WHEN def THEN 0.012 ELSE 0 END + 0.004 + 0.012 * p * (0.5 + p / 5.0) + 0.004 * ln(many) - 0.05 - CASE WHEN contains(path, '/test') THEN 0.04 ELSE 0 END - CASE WHEN contains(path, '/vendor/') THEN 0.016 ELSE 0 END, 6) AS DOUBLE) AS score FROM c ORDER BY score DESC, path LIMIT 20""")
def _rerank(s, p):
    d, made = standin.docs(s, p), F.col("doc_id") % 3 == 0
    chunks = d.select(F.col("doc_id").alias("chunk_id"), "path", F.when(made, "doc").otherwise(T.file_stem(F.col("path"))).alias("name"), F.when(made, "function").otherwise("file").alias("kind"), F.lit(1).alias("line_start"))
    return H.rerank(H.fuse(_bm25(s, p), _vectors(s, p), (1.0, 2.5)), chunks, _ASK)


add("hash_embedding")(lambda s, p: H.hash_embedding(s.read.parquet(f"{p}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")))


# maintenance: two snapshots
def _snapshots(s, p):
    d = standin.docs(s, p)
    a = d.select("path", "lang", "size", F.col("doc_id").alias("mtime_ns"), "hash")
    b = d.where("doc_id % 11 <> 3").select(
        F.when(F.col("doc_id") % 13 == 5, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), "lang", "size",
        (F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("mtime_ns"), F.when(F.col("doc_id") % 15 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")).alias("hash"),
    )
    return a, b


_snap = """, a AS (SELECT path, lang, size, doc_id AS mtime, hash FROM docs), b AS (SELECT CASE WHEN doc_id % 13 = 5 THEN 'moved/' || path ELSE path END AS path, lang, size, doc_id + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS mtime, CASE WHEN doc_id % 15 = 0 THEN hash || 'x' ELSE hash END AS hash FROM docs WHERE doc_id % 11 <> 3),
 ch AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.size = b.size AND a.mtime = b.mtime THEN 'same' WHEN a.hash = b.hash THEN 'touched' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.path = b.path)"""


def _classified(s, p):
    a, b = _snapshots(s, p)
    return store.classify(b, a), a, b


add("change_detect", _snap + " SELECT * FROM ch")(lambda s, p: _classified(s, p)[0])
add("rename_detect", _snap + " SELECT min(a.path) AS old_path, b.path AS new_path FROM a JOIN ch c ON c.path = a.path AND c.status = 'deleted' JOIN b ON b.hash = a.hash AND b.size = a.size AND b.lang = a.lang JOIN ch n ON n.path = b.path AND n.status = 'added' GROUP BY b.path")(lambda s, p: (lambda c: store.renames(c[2], c[1], c[0]))(_classified(s, p)))
add("changed_symbols", _snap + " SELECT ch.path, upper(status[1]) AS status, coalesce(list_sort(list(DISTINCT name) FILTER (name IS NOT NULL)), []) AS symbols FROM ch LEFT JOIN docs ON docs.path = ch.path LEFT JOIN symbols USING (doc_id) WHERE status IN ('added', 'changed', 'deleted') GROUP BY 1, 2")(
    lambda s, p: Y.changed_symbols(_classified(s, p)[0].where("status in ('added', 'changed', 'deleted')").withColumn("status", F.upper("status")), standin.docs(s, p), standin.symbols(standin.docs(s, p)))
)


def _segments(s, p):
    d = standin.docs(s, p).select((F.col("doc_id") % F.lit(23) % F.lit(9)).alias("segment"), "doc_id")
    return d, d.where("doc_id % 7 = 0")


add("tombstone_live", " SELECT doc_id % 23 % 9 AS segment, doc_id FROM docs WHERE doc_id % 7 <> 0")(lambda s, p: store.live(*_segments(s, p)))
add("compaction_plan", ", z AS (SELECT doc_id % 23 % 9 AS segment, count(*) AS n FROM docs WHERE doc_id % 7 <> 0 GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n, segment) AS rn, count(*) OVER () AS t FROM z) SELECT segment, n FROM r WHERE t > 4 AND rn <= t - 2 + 1")(lambda s, p: store.compaction_plan(store.live(*_segments(s, p)).groupBy("segment").agg(F.count("*").alias("n")), 4))
_why = "CASE WHEN size > 4000 THEN 'too_large' WHEN size < 100 THEN 'empty' WHEN contains(path, 'vendor/') THEN 'excluded' END"


def _skips(s, p, which):
    return tree.skip_report(standin.docs(s, p).select(F.col("path").alias("rel"), F.expr(_why).alias("reason")).where("reason is not null"))[which]


add("skip_accounting", f" SELECT {_why} AS reason, count(*) AS n FROM docs WHERE reason IS NOT NULL GROUP BY 1")(lambda s, p: _skips(s, p, 0))
add("skip_sample", f" SELECT path AS rel, {_why} AS reason FROM docs WHERE reason IS NOT NULL ORDER BY rel LIMIT 100")(lambda s, p: _skips(s, p, 1))


# savings
def _log(s, p):
    e = s.read.parquet(f"{p}/events.parquet")
    return e.select(F.unix_timestamp("ts").alias("ts"), F.col("event_type").alias("kind"), F.lit(1).alias("results"), F.floor(F.col("value") * 100).alias("baseline_chars"), (F.col("event_id") % 500).alias("returned_chars"))


_log_sql = "WITH log AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS kind, CAST(floor(value * 100) AS BIGINT) AS b, event_id % 500 AS r FROM events), x AS (SELECT *, greatest(b - r, 0) // 4 AS saved FROM log)"
_agg = "CAST(count(*) AS BIGINT) AS queries, CAST(count(*) AS BIGINT) AS results, CAST(sum(b) AS BIGINT) AS baseline_chars, CAST(sum(r) AS BIGINT) AS returned_chars, CAST(sum(saved) AS BIGINT) AS tokens_saved, CAST(CASE WHEN sum(b) > 0 THEN round(greatest(sum(b) - sum(r), 0) / sum(b), 6) ELSE 0 END AS DOUBLE) AS ratio"


@add("savings_report", _log_sql + f", w AS (SELECT * FROM (VALUES ('24h', 86400), ('7d', 604800), ('all', NULL)) v(\"window\", back)), n AS (SELECT max(ts) AS now FROM x) SELECT \"window\", {_agg} FROM x, w, n WHERE back IS NULL OR now - ts BETWEEN 0 AND back GROUP BY 1", bare=True)
def _report(s, p):
    log = _log(s, p)
    now = log.agg(F.max("ts").alias("now"))
    return A.report(log.crossJoin(F.broadcast(now)), F.col("now"))


add("savings_by_kind", _log_sql + f" SELECT kind, {_agg} FROM x GROUP BY kind", bare=True)(lambda s, p: A.by_kind(_log(s, p)))
@add("token_savings", ", h AS (SELECT path, size, list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'nicht')), lambda x: strlen(x))) AS got FROM docs WHERE contains(text, 'nicht')) SELECT CAST(sum(greatest(size - got, 0) // 4) AS BIGINT) AS tokens_saved, CAST(round(greatest(sum(size) - sum(got), 0) / sum(size), 6) AS DOUBLE) AS ratio, CAST(count(*) AS BIGINT) AS files FROM h")
def _token_savings(s, p):
    got = F.aggregate(F.filter(F.split("text", "\n"), lambda x: x.contains("nicht")), F.lit(0), lambda a, x: a + F.octet_length(x))
    h = standin.docs(s, p).where(F.col("text").contains("nicht")).select("size", got.alias("got"))
    return h.agg(F.sum(A.tokens_saved(F.col("size"), F.col("got"))).alias("tokens_saved"), F.round(A.ratio(F.sum("size"), F.sum("got")), 6).alias("ratio"), F.count("*").alias("files"))


add("range_size", " SELECT path, CAST(coalesce(list_sum(list_transform(string_split(text, chr(10))[2:4], lambda x: strlen(x) + 1)), 0) AS INT) AS chars FROM docs")(lambda s, p: A.range_size(standin.docs(s, p), F.lit(2), F.lit(4)))


# extraction over code that is made of the documents' words
def _sources(s, p):
    d = standin.docs(s, p)
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", " "), " +"), lambda x: F.length(x) > 3)

    def functions(w):
        part = lambda x, i: F.concat(F.lit("def "), x, F.lit("_x(a):\n    return "), F.coalesce(F.get(w, i + 1), F.lit("name")), F.lit("_x(a)\n\n"))
        return F.array_join(F.transform(w, part), "")

    # the words are bound to a variable; else they would be cut again for each
    code = F.transform(F.array(words), functions)[0]
    head = "import os\n\nclass Name_x:\n    def name_x(self, a):\n        return os.path.join(a)\n\n"
    return d.withColumn("text", F.concat(F.lit(head), code)).withColumn("lang", F.lit("python"))


#: (doc_id, path, i, w, nxt): the words that functions are made of, in order, as in _sources.
_code_words = """, cw AS (SELECT doc_id, path, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), ' +'), lambda x: length(x) > 3) AS ws FROM docs),
 fn AS (SELECT doc_id, path, unnest(ws) AS w, unnest(list_concat(ws[2:], ['name'])) AS nxt, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS i FROM cw)"""
add("python_symbols", _code_words + """ SELECT doc_id, i + 2 AS sym_idx, w || '_x' AS name, 'function' AS kind, 7 + 3 * i AS line_start, 8 + 3 * i AS line_end, CAST(NULL AS VARCHAR) AS container, 'def ' || w || '_x(a):' AS signature FROM fn
 UNION ALL SELECT doc_id, 0, 'Name_x', 'class', 3, 5, NULL, 'class Name_x:' FROM docs UNION ALL SELECT doc_id, 1, 'name_x', 'method', 4, 5, 'Name_x', 'def name_x(self, a):' FROM docs""")(lambda s, p: X.extract(_sources(s, p))[0])
add("python_calls", _code_words + """ SELECT doc_id, nxt || '_x' AS name, 'call' AS kind, 8 + 3 * i AS line, 12 AS "column" FROM fn
 UNION ALL SELECT doc_id, 'os', 'import', 1, 8 FROM docs UNION ALL SELECT doc_id, 'join', 'call', 5, 24 FROM docs""")(lambda s, p: X.extract(_sources(s, p))[1])


@add("structural_match", _code_words + """ SELECT path, 'python' AS lang, 7 + 3 * i AS line_start, 8 + 3 * i AS line_end, 'FunctionDef' AS kind, 'def ' || w || '_x(a):' || chr(10) || '    return ' || nxt || '_x(a)' AS text, 'NAME=' || w || '_x:' || (7 + 3 * i) AS captures FROM fn
 UNION ALL SELECT path, 'python', 4, 5, 'FunctionDef', 'def name_x(self, a):' || chr(10) || '        return os.path.join(a)', 'NAME=name_x:4' FROM docs""")
def _structural(s, p):
    found = X.structural(_sources(s, p), "def $NAME($$$): $$$", "python", None)
    return found.withColumn("captures", F.array_join(F.transform("captures", lambda c: F.concat(c["name"], F.lit("="), c["text"], F.lit(":"), c["line"].cast("string"))), ","))


@add("stream_incremental_index", " SELECT lang, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM docs WHERE doc_id % 11 <> 3 GROUP BY lang")
def _stream(s, p):
    """All documents arrive as events, then deletions of some; the index follows through a file stream."""
    base = shared.new_path(s, "stream")
    d = standin.docs(s, p).withColumn("mtime_ns", F.col("doc_id"))
    ev = d.withColumn("seq", F.lit(1)).withColumn("op", F.lit("put"))
    ev.write.parquet(f"{base}/events/1")
    ev.where("doc_id % 11 = 3").withColumn("seq", F.lit(2)).withColumn("op", F.lit("delete")).write.parquet(f"{base}/events/2")
    index = store.Store(s, f"{base}/index", lambda docs: (standin.symbols(docs), standin.refs(docs)))
    schema = s.read.parquet(f"{base}/events/1").schema

    def now(batch):
        try:
            state = index.table("docs").select(*d.columns)
        except store.Corrupt:
            state = batch.select(*d.columns).limit(0)
        return shared.checkpoint(watch.apply(state, batch))

    stream = s.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{base}/events/*")
    watch.follow(stream, index, now, f"{base}/progress", once=True).awaitTermination()
    return index.table("docs").groupBy("lang").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
