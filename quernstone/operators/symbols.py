"""Symbols, outlines, snippets and summaries."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

HIT = ["path", "lang", "name", "kind", "line_start", "line_end", "container", "signature", "score"]


def live(docs: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Documents without a tombstone."""
    return docs if tombstones is None else docs.join(tombstones.select("doc_id").distinct(), "doc_id", "left_anti")


def lookup(docs: DataFrame, symbols: DataFrame, name: str, kind: str | None = None, exact: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """Symbols of a name, best first. Exact ignores ASCII case; else equal, prefix, acronym, substring, subsequence score in turn."""
    s = symbols if kind is None else symbols.where(F.col("kind") == kind)
    if exact:
        s = s.where(T.ascii_lower(F.col("name")) == name.lower()).withColumn("match", F.lit(100.0))
    else:
        s = s.withColumn("match", T.fuzzy_score(F.col("name"), name)).where(F.col("match").isNotNull())
    hits = s.join(docs.select("doc_id", "path", "lang"), "doc_id").withColumn("score", F.round(F.col("match") + T.path_score(F.col("path")), 4))
    page = hits.orderBy(F.desc("score"), F.octet_length("name"), "path", "line_start", "sym_idx").offset(offset).limit(limit)
    return page.select(*HIT)


def outline(docs: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    """Symbols of one file in order of line."""
    own = docs.where(F.col("path") == path).select("doc_id", "path", "lang")
    return symbols.join(own, "doc_id").withColumn("score", F.lit(1.0)).orderBy("line_start", "sym_idx").select(*HIT)


def definitions(docs: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of exactly this name, with their files."""
    return symbols.where(F.col("name") == name).join(docs.select("doc_id", "path", "lang"), "doc_id")


def enclosing(sites: DataFrame, symbols: DataFrame, key: list[str]) -> DataFrame:
    """Adds caller: the name of the innermost symbol around each site's line, null outside of all; key tells sites apart.

    Sites meet the symbols of their own document only. Of equal spans the symbol stored first counts.
    """
    s = symbols.select(F.col("doc_id").alias("_d"), F.col("name").alias("caller"), "sym_idx", "line_start", "line_end")
    inside = (F.col("doc_id") == F.col("_d")) & F.col("line").between(F.col("line_start"), F.col("line_end"))
    best = F.min_by("caller", F.struct(F.col("line_end") - F.col("line_start"), "sym_idx")).alias("caller")
    return sites.join(s, inside, "left").groupBy(*key).agg(best)


def safe_path(path: str) -> str:
    """The path, if it stays in the tree; absolute paths and .. are refused."""
    if not path or path.startswith(("/", "\\")) or ":" in path.split("/")[0] or ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"path outside of the tree: {path!r}")
    return posixpath.normpath(path)


def snippet(docs: DataFrame, path: str, start: int, end: int, context: int = 0) -> DataFrame:
    """(path, start_line, end_line, total_lines, text): a range of lines, clamped into the file."""
    d = docs.where(F.col("path") == safe_path(path)).withColumn("ls", F.split("text", r"\r?\n"))
    d = d.withColumn("ls", F.when(F.element_at("ls", -1) == "", F.slice("ls", F.lit(1), F.size("ls") - 1)).otherwise(F.col("ls"))).withColumn("n", F.size("ls"))
    lo = F.greatest(F.least(F.lit(max(start - context, 1)), F.col("n")), F.least(F.lit(1), F.col("n")))
    d = d.withColumn("lo", lo).withColumn("hi", F.greatest(F.least(F.lit(end + context), F.col("n")), F.col("lo")))
    part = F.when(F.col("n") == 0, F.lit("")).otherwise(F.array_join(F.slice("ls", F.greatest("lo", F.lit(1)), F.col("hi") - F.col("lo") + 1), "\n"))
    return d.select("path", F.col("lo").cast("int").alias("start_line"), F.col("hi").cast("int").alias("end_line"), F.col("n").cast("int").alias("total_lines"), part.alias("text"))


def summary(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(section, key, files, bytes, symbols): totals, languages by files, and the 15 largest first path parts."""
    total = docs.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).crossJoin(symbols.agg(F.count("*").alias("symbols"))).select(F.lit("total").alias("section"), F.lit("").alias("key"), "files", "bytes", "symbols")
    none = F.lit(None).cast("long")
    langs = docs.groupBy(F.col("lang").alias("key")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).select(F.lit("language").alias("section"), "key", "files", "bytes", none.alias("symbols"))
    dirs = docs.groupBy(F.split("path", "/")[0].alias("key")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "key").limit(15)
    return total.unionByName(langs).unionByName(dirs.select(F.lit("top_dir").alias("section"), "key", "files", none.alias("bytes"), none.alias("symbols")))


def changed_symbols(changes: DataFrame, docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, status, symbols): changed files with the sorted names that they define."""
    names = docs.select("doc_id", "path").join(symbols, "doc_id").groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("symbols"))
    return changes.join(names, "path", "left").select("path", F.substring("status", 1, 1).alias("status"), F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"))


