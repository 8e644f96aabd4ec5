"""The requests of the engine as methods, over an index in a folder or any DataFrames of docs, symbols and refs."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as T
from .operators import callgraph, extract, hybrid, pack, savings, search, static_model, symbols
from .sources import store, tree

#: So many changed files are opened by name; of more, the whole tree is listed again.
FEW = 10_000
LOG_BYTES = 8 << 20
SAVINGS = "ts long, kind string, results long, baseline_chars long, returned_chars long"
EMBEDDER = "hash256"

def discover(start: str) -> str:
    """The nearest folder at or above start that holds an index, else start."""
    here = os.path.abspath(start)
    while True:
        if os.path.isdir(os.path.join(here, tree.INDEX_DIR)):
            return here
        up = os.path.dirname(here)
        if up == here:
            return os.path.abspath(start)
        here = up


def inside(root: str, path: str) -> str:
    """path, if it lies under root; for servers that take roots from callers."""
    real, top = os.path.realpath(path), os.path.realpath(root)
    if real != top and not real.startswith(top.rstrip("/") + "/"):
        raise ValueError("path outside of the server's root")
    return real


class Engine:
    """One project. Every query method gives a DataFrame; nothing runs before it is asked for rows."""

    def __init__(self, spark: SparkSession, root: str, config: tree.Config | None = None, model: str | None = None):
        """model: the folder of a static embedding model, which all executors share; else terms are hashed."""
        self.model = model
        self.spark, self.root = spark, os.path.abspath(root)
        self.folder = f"{self.root}/{tree.INDEX_DIR}"
        self.config = config or tree.Config.load(f"{self.folder}/config.toml")
        self.store = store.Store(spark, self.folder, extract.extract, self.config.merge_threshold)

    # state

    def ping(self) -> str:
        return "pong"

    def init(self) -> None:
        os.makedirs(self.folder, exist_ok=True)
        with open(f"{self.folder}/.gitignore", "w") as f:
            f.write("*\n")

    def clean(self) -> None:
        self.store.clean()

    def status(self) -> dict:
        return self.store.status()

    def _sources(self, fresh: bool = False) -> tuple[DataFrame, DataFrame]:
        """(docs, skipped) of the tree as it is. Files of the size and time that the index has aren't read, unless fresh."""
        entries, skipped = tree.walk(self.spark, self.root, self.config)
        try:
            if fresh:
                raise store.Corrupt("not asked for")
            self.store.check()
            state = self.docs.drop("segment")
        except store.Corrupt:
            docs, binary = tree.read(self.spark, self.root, self.config, entries)
            return docs, skipped.unionByName(binary)
        known = state.select(F.col("path").alias("rel"), "size", "mtime_ns")
        todo = entries.join(known, ["rel", "size", "mtime_ns"], "left_anti")
        few = [r.rel for r in todo.select("rel").limit(FEW + 1).collect()]  # FEW + 1 rows at most
        docs, binary = tree.read(self.spark, self.root, self.config, todo, few if len(few) <= FEW else None)
        same = state.join(entries.select(F.col("rel").alias("path"), "size", "mtime_ns"), ["path", "size", "mtime_ns"], "left_semi")
        return same.select(*docs.columns).unionByName(docs), skipped.unionByName(binary)

    def _head(self) -> list[str] | None:
        found = tree.head(self.root)
        return list(found) if found else None

    def reindex(self, force: bool = False) -> dict:
        """Builds or updates the index; counts of what changed and what was skipped."""
        self.init()
        docs, skipped = self._sources(force)
        counts = {"added": self.store.full(docs, self._head()).doc_count} if force else self.store.incremental(docs, self._head())
        by, sample = tree.skip_report(skipped)
        return counts | {"skipped_by_reason": {r.reason: r.n for r in by.collect()}, "skipped_sample": [(r.rel, r.reason) for r in sample.collect()]}

    def ensure_indexed(self) -> bool:
        self.init()
        return self.store.ensure(self._sources(True)[0])

    def is_dirty(self) -> bool:
        return self.store.is_dirty(self._sources()[0])

    def compact(self) -> None:
        self.store.compact(everything=True)

    def verify(self) -> None:
        """Raises if a file of the index isn't as it was written."""
        self.store.verify()

    @property
    def docs(self) -> DataFrame:
        return self.store.table("docs")

    @property
    def symbols_table(self) -> DataFrame:
        return self.store.table("symbols")

    @property
    def refs_table(self) -> DataFrame:
        return self.store.table("refs")

    # queries

    def search(self, query: search.Query) -> DataFrame:
        """By the index; if its files aren't all there, by a scan of the tree, without the bonus for definitions."""
        try:
            self.store.check()
            return search.indexed(self.docs, self.store.table("postings"), query, self.symbols_table)
        except Exception:  # whatever ails the index, the scan answers
            return search.search(self._sources(True)[0], query)

    def symbols(self, name: str, **options) -> DataFrame:
        return symbols.lookup(self.docs, self.symbols_table, name, **options)

    def refs(self, name: str, limit: int = 100, offset: int = 0) -> DataFrame:
        return search.references(self.docs, name, self.symbols_table, limit, offset)

    def refs_resolved(self, name: str, limit: int | None = 100, offset: int = 0) -> DataFrame:
        return callgraph.resolved_references(self.docs, self.symbols_table, self.refs_table, name, limit, offset)

    def callers(self, name: str, limit: int = 100, offset: int = 0) -> DataFrame:
        return callgraph.callers(self.docs, self.symbols_table, self.refs_table, name, limit, offset)

    def callees(self, name: str, limit: int = 100, offset: int = 0) -> DataFrame:
        return callgraph.callees(self.docs, self.symbols_table, self.refs_table, name, limit, offset)

    def blast_radius(self, name: str, depth: int = 3, limit: int = 200) -> DataFrame:
        return callgraph.impact(self.docs, self.symbols_table, self.refs_table, name, depth, limit)

    def _identifier(self, path: str, line: int, column: int):
        row = self.docs.where(F.col("path") == symbols.safe_path(path)).select("text", "lang").first()  # one document
        found = extract.identifier_at(row.text, row.lang, line, column) if row else None
        if found is None:
            raise ValueError(f"no identifier at {path}:{line}:{column}")
        return found

    def definition(self, path: str, line: int, column: int) -> DataFrame:
        name, call, member, type_, _ = self._identifier(path, line, column)
        return callgraph.definition(self.docs, self.symbols_table, self.refs_table, path, name, call, member, type_)

    def references_at(self, path: str, line: int, column: int) -> DataFrame:
        return self.refs_resolved(self._identifier(path, line, column)[0], None)

    def structural(self, pattern: str, lang: str, limit: int = 50, offset: int = 0) -> DataFrame:
        return extract.structural(self.docs, pattern, lang, limit, offset)

    def context_pack(self, task: str, budget: int = 8000) -> DataFrame:
        return pack.pack(self.docs, self.symbols_table, self.refs_table, task, budget)

    def outline(self, path: str) -> DataFrame:
        return symbols.outline(self.docs, self.symbols_table, symbols.safe_path(path))

    def snippet(self, path: str, start: int, end: int, context: int = 3) -> DataFrame:
        return symbols.snippet(self.docs, path, start, end, context)

    def summary(self) -> DataFrame:
        return symbols.summary(self.docs, self.symbols_table)

    def blame(self, path: str, line: int) -> DataFrame:
        return tree.blame(self.spark, self.root, symbols.safe_path(path), line)

    def history(self, name: str, limit: int = 20) -> DataFrame:
        best = symbols.definitions(self.docs, self.symbols_table, name).orderBy(F.desc(T.path_score(F.col("path"))), F.desc("doc_id"), F.desc("sym_idx")).first()  # one row
        if best is None:
            raise ValueError(f"no symbol {name}")
        return tree.history(self.spark, self.root, best.path, best.line_start, best.line_end, limit)

    def changed_since(self, rev: str) -> DataFrame:
        return symbols.changed_symbols(tree.changed_since(self.spark, self.root, rev), self.docs, self.symbols_table)

    # semantic index

    def _semantic(self) -> str:
        """The folder of the semantic index of the present state, built if it isn't there; the ones before go."""
        m = self.store.manifest()
        embedder = static_model.load(self.model).id if self.model else EMBEDDER
        name = f"semantic-{m.last_indexed}-{m.next_segment_id}-{embedder}"
        path = f"{self.folder}/{name}"
        if not self.store.folder.exists(f"{name}/done"):
            self.store.folder.delete(name)
            hybrid.chunks(self.docs, self.symbols_table).write.parquet(f"{path}/chunks")
            chunks = self.spark.read.parquet(f"{path}/chunks")
            hybrid.terms(chunks).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
            self._embed(chunks, "embedded").write.parquet(f"{path}/vectors")
            lengths = self.spark.read.parquet(f"{path}/terms").groupBy("chunk_id").agg(F.first("dl").alias("dl"))
            lengths.agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl")).write.parquet(f"{path}/size")
            self.store.folder.write(f"{name}/done", embedder)
            for old in self.store.folder.names():
                if old.startswith("semantic-") and old != name:
                    self.store.folder.delete(old)
        return path

    def _embed(self, texts: DataFrame, text: str) -> DataFrame:
        return static_model.embedding(texts, self.model, text) if self.model else hybrid.hash_embedding(texts, text=text)

    def build_semantic(self) -> int:
        """Builds the semantic index if need be; its number of chunks."""
        return self.spark.read.parquet(f"{self._semantic()}/chunks").count()

    def semantic_search(self, query: str, k: int = 20) -> DataFrame:
        """Chunks by BM25 and hashed vectors, fused and re-ranked; from tables kept beside the segments."""
        path = self._semantic()
        chunks, terms, vectors, size = (self.spark.read.parquet(f"{path}/{t}") for t in ("chunks", "terms", "vectors", "size"))
        asked = self.spark.createDataFrame([(0, query)], "chunk_id long, text string")
        words = [r.t for r in asked.select(F.explode(hybrid.stems(F.col("text"))).alias("t")).distinct().collect()]
        lexical = hybrid.bm25(terms, words, size=size)
        q = self._embed(asked, "text").select(F.col("embedding").alias("q"))
        dense = hybrid.vector_topk(vectors.crossJoin(F.broadcast(q)), F.col("q"))
        return hybrid.rerank(hybrid.fuse(lexical, dense, hybrid.weights(query)), chunks.drop("text", "embedded"), query, k)

    # savings

    def record_savings(self, hits: DataFrame, kind: str) -> None:
        savings.record(hits, self.docs, kind, int(time.time())).write.mode("append").json(f"{self.folder}/savings")
        if self.store.folder.measure("savings")[1] > LOG_BYTES:  # the newer half stays
            log = self.spark.read.schema(SAVINGS).json(f"{self.folder}/savings")
            middle = log.agg(F.percentile_approx("ts", 0.5)).first()[0]
            log.where(F.col("ts") >= middle).coalesce(1).write.mode("overwrite").json(f"{self.folder}/savings.new")
            self.store.folder.delete("savings")
            self.store.folder.rename("savings.new", "savings")

    def savings_report(self) -> tuple[DataFrame, DataFrame]:
        log = self.spark.read.schema(SAVINGS).json(f"{self.folder}/savings")
        return savings.report(log, F.lit(int(time.time()))), savings.by_kind(log)


REQUESTS = ("ping", "status", "summary", "reindex", "search", "symbols", "refs", "refs_resolved", "callers", "callees", "blast_radius", "definition", "references_at", "structural", "context_pack", "blame", "history", "changed_since", "outline", "snippet", "build_semantic", "semantic_search", "is_dirty", "ensure_indexed", "compact", "verify", "clean", "init", "savings_report")


def request(engine: Engine, message: dict):
    """Answers {"method": name, ...arguments}: plain values or lists of rows."""
    name = re.sub(r"(?<=[a-z])(?=[A-Z])", "_", str(message.get("method", ""))).lower()
    if name not in REQUESTS:
        raise ValueError(f"unknown request {name!r}")
    args = {k: v for k, v in message.items() if k != "method"}
    out = engine.search(search.Query(**args)) if name == "search" else getattr(engine, name)(**args)
    frames = out if isinstance(out, tuple) else (out,)
    done = [[r.asDict(True) for r in f.collect()] if isinstance(f, DataFrame) else f for f in frames]
    return done if isinstance(out, tuple) else done[0]


def serve(engine_of, lines, write, idle_seconds: float = 600.0) -> None:
    """Answers requests, one JSON object a line, in turn, until the input ends. engine_of: root -> Engine.

    A request may name its root; engines are kept by root, and dropped when they were not asked for so long.
    """
    kept: dict[str, tuple[Engine, float]] = {}
    for line in lines:
        if not line.strip():
            continue
        now, asked = time.monotonic(), None
        try:
            message = json.loads(line)
            asked, root = message.pop("id", None), message.pop("root", ".")
            kept = {r: x for r, x in kept.items() if now - x[1] < idle_seconds}
            engine = kept[root][0] if root in kept else engine_of(root)
            kept[root] = (engine, now)
            write(json.dumps({"id": asked, "result": request(engine, message)}, default=str, ensure_ascii=False))
        except Exception as e:  # the next request is answered whatever this one was
            write(json.dumps({"id": asked, "error": f"{type(e).__name__}: {e}"}, ensure_ascii=False))
