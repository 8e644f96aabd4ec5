"""Context packs: symbols that fit a task, with their code, within a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .. import shared
from ..functions import text as T
from . import callgraph

SEEDS, CALLEES, EXTRA_LINES = 8, 12, 60


def candidates(docs: DataFrame, symbols: DataFrame, refs: DataFrame, task: str) -> DataFrame:
    """Symbols whose words fit the task; how often they are called and where they stand counts too."""
    terms = T.task_terms(task)
    s = symbols.join(docs.select("doc_id", "path", "lang"), "doc_id")
    s = s.withColumn("lex", T.lexical_score(F.col("name"), F.col("kind"), F.col("signature"), F.col("container"), F.col("path"), terms)).where(F.col("lex") > 0)
    named = refs.join(s.select("name").distinct(), "name", "left_semi")
    s = s.join(callgraph.in_degree(named), "name", "left")
    score = F.col("lex") + F.log1p(F.coalesce("n", F.lit(0))) * 1.5 + T.path_score(F.col("path"))
    return s.select("doc_id", "sym_idx", "path", "lang", "name", "kind", "line_start", "line_end", "signature", F.round(score, 4).alias("score"), F.lit("match").alias("reason"))


def expand(found: DataFrame, docs: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """found, and the definitions of what its best symbols call, at 0.3 of their score; one row a (name, first line)."""
    order = [F.desc("score"), "doc_id", "sym_idx"]
    seeds = found.orderBy(*order).limit(SEEDS).withColumn("seed", F.row_number().over(Window.orderBy(*order)))  # eight rows
    calls = refs.where(F.col("kind") == "call").select("doc_id", F.col("name").alias("callee"), "line", "column")
    inside = calls.join(F.broadcast(seeds.select("doc_id", "seed", F.col("name").alias("of"), "score", "line_start", "line_end", "path")), "doc_id").where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    ranked = inside.withColumn("rn", F.row_number().over(Window.partitionBy("seed").orderBy("callee", "path", "line", "column"))).where(F.col("rn") <= CALLEES)
    near = symbols.join(ranked.select("seed", "rn", "of", F.col("callee").alias("name"), F.col("score").alias("from")), "name").join(docs.select("doc_id", "path", "lang"), "doc_id")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("name", "line_start").orderBy("seed", "rn", "doc_id", "sym_idx"))).where("rank = 1")
    near = near.join(found.select("name", "line_start").distinct(), ["name", "line_start"], "left_anti")
    near = near.select("doc_id", "sym_idx", "path", "lang", "name", "kind", "line_start", "line_end", "signature", F.round(F.col("from") * 0.3, 4).alias("score"), F.concat(F.lit("callee of "), F.col("of")).alias("reason"))
    return found.unionByName(near)


def pack(docs: DataFrame, symbols: DataFrame, refs: DataFrame, task: str, budget: int = 8000) -> DataFrame:
    """(rank, path, lang, name, kind, line_start, line_end, code, reason, score, cost, used_tokens, truncated).

    Items are taken best first; one that no longer fits is skipped, the first is always taken; rank counts those taken.
    Once an item of some cost is skipped, so are all later ones of that cost, and budget // cost of them fill the budget.
    So only the first and the best budget // cost of each cost are folded: about budget * ln(budget) rows whatever the
    number of candidates. Texts are read for costs alone, and again for the items taken.
    """
    found = shared.checkpoint(expand(candidates(docs, symbols, refs, task), docs, symbols, refs))
    code = F.array_join(F.slice(F.split("text", "\n"), F.col("line_start"), F.least(F.col("line_end"), F.col("line_start") + EXTRA_LINES) - F.col("line_start") + 1), "\n")
    cost = F.greatest(F.lit(1), F.floor((F.octet_length(code) + F.octet_length(F.coalesce("signature", F.lit("")))) / 4)).cast("int")
    order = [F.desc("score"), "doc_id", "sym_idx"]
    items = shared.checkpoint(found.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "sym_idx", "line_start", "score", cost.alias("cost")))
    best = items.where(F.col("cost") <= budget).withColumn("rn", F.row_number().over(Window.partitionBy("cost").orderBy(*order))).where(F.col("rn") <= budget)
    best = best.where(F.col("rn") * F.col("cost") <= budget).drop("rn").unionByName(items.orderBy(*order).limit(1)).dropDuplicates(["doc_id", "sym_idx", "line_start", "cost"])
    key = F.struct((-F.col("score")).alias("s"), "doc_id", "sym_idx", "line_start", "cost")
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<s:double,doc_id:bigint,sym_idx:int,line_start:int,cost:int>>").alias("taken"))

    def step(a, x):
        full = (F.size(a["taken"]) > 0) & (a["used"] + x["cost"] > budget)
        return F.when(full, a).otherwise(F.struct((a["used"] + x["cost"]).alias("used"), F.concat(a["taken"], F.array(x)).alias("taken")))

    fold = best.agg(F.array_sort(F.collect_list(key)).alias("xs")).select(F.aggregate("xs", start, step).alias("f"))
    total = items.agg(F.count("*").alias("n"))
    taken = fold.crossJoin(total).select(F.col("f.used").alias("used_tokens"), (F.col("n") > F.size("f.taken")).alias("truncated"), F.posexplode("f.taken").alias("p", "t"))
    taken = taken.select((F.col("p") + 1).alias("rank"), F.col("t.doc_id").alias("doc_id"), F.col("t.sym_idx").alias("sym_idx"), F.col("t.cost").alias("cost"), "used_tokens", "truncated")
    out = found.join(F.broadcast(taken), ["doc_id", "sym_idx"]).join(docs.select("doc_id", "text"), "doc_id").withColumn("code", code)
    return out.select("rank", "path", "lang", "name", "kind", "line_start", "line_end", "code", "reason", "score", "cost", "used_tokens", "truncated").orderBy("rank")
