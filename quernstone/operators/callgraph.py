"""Callers, callees, impact, resolved references and definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .. import shared
from ..functions import text as T
from . import search, symbols as S


def callers(docs: DataFrame, symbols: DataFrame, refs: DataFrame, name: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Call sites of a name with the symbol around each, in order of path and line."""
    sites = refs.where((F.col("name") == name) & (F.col("kind") == "call"))
    out = S.enclosing(sites, symbols, ["doc_id", "line", "column"]).join(docs.select("doc_id", "path", "lang"), "doc_id")
    return out.select("caller", F.lit(name).alias("callee"), "path", "lang", "line", "column").orderBy("path", "line", "column").offset(offset).limit(limit)


def callees(docs: DataFrame, symbols: DataFrame, refs: DataFrame, name: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Calls within the definitions of a name."""
    own = S.definitions(docs, symbols, name).select(F.col("doc_id"), "path", "lang", "line_start", "line_end")
    calls = refs.where(F.col("kind") == "call").select("doc_id", F.col("name").alias("callee"), "line", "column")
    inside = calls.join(own, "doc_id").where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    out = inside.select(F.lit(name).alias("caller"), "callee", "path", "lang", "line", "column").dropDuplicates(["path", "callee", "line", "column"])
    return out.orderBy("callee", "path", "line", "column").offset(offset).limit(limit)


def in_degree(refs: DataFrame) -> DataFrame:
    """(name, n): calls of each name."""
    return refs.where(F.col("kind") == "call").groupBy("name").agg(F.count("*").alias("n"))


def edges(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct (caller, callee) by name; made once for a walk."""
    calls = refs.where(F.col("kind") == "call").join(symbols.select("name").distinct(), "name", "left_semi")
    sites = S.enclosing(calls, symbols, ["doc_id", "line", "column", "name"])
    return sites.where("caller is not null").select("caller", F.col("name").alias("callee")).distinct()


def impact(docs: DataFrame, symbols: DataFrame, refs: DataFrame, name: str, depth: int = 3, limit: int | None = 200) -> DataFrame:
    """Symbols that reach the name by at most depth calls, with their distance; distance 0 is the name's own definitions.

    A hop is a join of the frontier with the edges; reached names are kept in the shared folder, so no hop repeats one.
    """
    e = shared.checkpoint(edges(symbols, refs))
    spark = docs.sparkSession
    seen = spark.createDataFrame([(name, 0)], "name string, distance int")
    frontier = seen
    for d in range(1, depth + 1):
        step = e.join(frontier.select(F.col("name").alias("callee")), "callee").select(F.col("caller").alias("name")).distinct()
        frontier = shared.checkpoint(step.join(seen, "name", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    hits = symbols.join(seen, "name").join(docs.select("doc_id", "path", "lang"), "doc_id")
    out = hits.select("name", "kind", "path", "lang", "line_start", "line_end", "distance").orderBy("distance", "path", "line_start", "name")
    return out if limit is None else out.limit(limit)


def resolved_references(docs: DataFrame, symbols: DataFrame, refs: DataFrame, name: str, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Definitions, calls and imports of a name."""
    defs = S.definitions(docs, symbols, name).select("path", "lang", "name", F.lit("definition").alias("kind"), F.col("line_start").alias("line"), F.lit(1).alias("column"), "container")
    sites = S.enclosing(refs.where(F.col("name") == name), symbols, ["doc_id", "kind", "line", "column"])
    used = sites.join(docs.select("doc_id", "path", "lang"), "doc_id").select("path", "lang", F.lit(name).alias("name"), "kind", "line", "column", F.col("caller").alias("container"))
    order = F.when(F.col("kind") == "definition", 0).when(F.col("kind") == "call", 1).otherwise(2)
    out = defs.unionByName(used).orderBy(order, "path", "line", "column").offset(offset)
    return out if limit is None else out.limit(limit)


def imported_names(refs: DataFrame, doc_id: int) -> DataFrame:
    return refs.where((F.col("doc_id") == doc_id) & (F.col("kind") == "import")).select("name").distinct()


def definition(docs: DataFrame, symbols: DataFrame, refs: DataFrame, path: str, name: str, is_call: bool = False, is_member: bool = False, is_type: bool = False, gap: float = 12.0) -> DataFrame:
    """Candidates for the definition of a name used in path, best first; text references, unresolved, if there is none."""
    here = docs.where(F.col("path") == path).select("doc_id")
    taken = imported_here(refs, here, name)
    c = S.definitions(docs, symbols, name)
    kind = F.col("kind")
    score = 10.0 + T.path_score(F.col("path")) + F.when(F.col("path") == path, 40.0).otherwise(0.0) + 2.0 * T.shared_prefix(F.col("path"), F.lit(path))
    member = kind.isin("method", "field", "property")
    if is_member:
        score = score + F.when(member, 25.0).otherwise(0.0)
    else:
        score = score + F.when(~member, 8.0).otherwise(0.0)
    if is_call:
        score = score + F.when(kind.isin("function", "method", "macro", "constructor"), 6.0).otherwise(0.0)
    if is_type:
        score = score + F.when(kind.isin("struct", "class", "interface", "enum", "type", "trait", "record"), 12.0).otherwise(0.0)
    c = c.crossJoin(F.broadcast(taken)).withColumn("score", F.round(score + F.when(F.col("taken") & (F.col("path") != path), 15.0).otherwise(0.0), 4))
    w = Window.orderBy(F.desc("score"), "path", "line_start", "sym_idx")  # the definitions of one name
    ranked = c.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    resolved = (F.col("rn") == 1) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= gap))
    out = ranked.select("path", "lang", "name", "kind", "line_start", "line_end", "container", "signature", "score", resolved.alias("resolved"))
    fallback = text_uses(docs, symbols, name)
    none = c.agg((F.count("*") == 0).alias("none"))
    return out.unionByName(fallback.crossJoin(F.broadcast(none)).where("none").drop("none"))


def text_uses(docs: DataFrame, symbols: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Text references of a name as unresolved candidates, what definition gives for a name that nothing defines."""
    found = search.references(docs, name, symbols, limit)
    return found.select(
        "path", "lang", F.lit(name).alias("name"), F.lit("text").alias("kind"), F.col("line").alias("line_start"), F.col("line").alias("line_end"), F.lit(None).cast("string").alias("container"), F.col("text").alias("signature"), "score", F.lit(False).alias("resolved")
    )


def imported_here(refs: DataFrame, here: DataFrame, name: str) -> DataFrame:
    """One row: whether the document imports the name."""
    return refs.where((F.col("name") == name) & (F.col("kind") == "import")).join(here, "doc_id", "left_semi").agg((F.count("*") > 0).alias("taken"))
