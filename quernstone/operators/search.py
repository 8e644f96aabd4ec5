"""Content search: literal, case-insensitive, whole-word and regular-expression matching with ranking and paging.

Texts are filtered by a predicate that the scan can push down before anything is exploded. A pattern that stays within
a line is matched line by line; another over the whole text. Neither shuffles; the one exchange is that of the cap of
hits a file, and the page is a top-k. A literal scan of documents of any number of matches does one pass.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import regexlang, text as T, trigram

MATCH_CAP = 4096
_BEGIN, _END = "\x01", "\x02"
_WORD = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]"


@dataclass(frozen=True)
class Query:
    """A content query. Exhaustive: every matching line in order of path and line; no limit, offset or cap."""

    pattern: str
    regex: bool = False
    case_insensitive: bool = False
    whole_word: bool = False
    lang: str | None = None
    path: str | None = None
    limit: int = 50
    offset: int = 0
    max_per_file: int = 20
    exhaustive: bool = False


def java_pattern(q: Query) -> str:
    return regexlang.translate(q.pattern, q.case_insensitive) if q.regex else regexlang.literal(q.pattern, q.case_insensitive)


def in_scope(docs: DataFrame, q: Query) -> DataFrame:
    """Documents that the filters admit; predicates on lang, path and text reach the scan."""
    if q.lang is not None:
        docs = docs.where(F.col("lang") == q.lang)
    if q.path:
        docs = docs.where(F.col("path").contains(q.path))
    if not q.regex and not q.case_insensitive:
        return docs.where(F.col("text").contains(q.pattern))
    if q.regex and not q.case_insensitive:
        for piece in regexlang.required_literals(q.pattern):
            docs = docs.where(F.col("text").contains(piece))
    return docs.where(F.col("text").rlike(java_pattern(q)))


def _matches(text: Column, pattern: str) -> Column:
    """Pieces after each match of a text: the match, an end mark, and what follows it; the first piece is before all."""
    clean = F.translate(text, _BEGIN + _END, "��")
    return F.split(F.regexp_replace(clean, pattern, f"{_BEGIN}$0{_END}"), _BEGIN, -1)


def _located(text: Column, pattern: str, whole_word: bool, cap: int | None = None) -> Column:
    """struct<n, hits: array<struct<line, column>>>: number of matches that count, and the first of each line, by one fold.

    cap: only so many first matches are looked at.
    """
    pieces = _matches(text, pattern)

    def breaks_in(c: Column) -> Column:
        return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))

    zero = F.struct(
        F.lit(-1).alias("n"), F.lit(0).alias("line"), F.lit(0).alias("bytes"), F.lit("").alias("before"), F.lit(0).alias("last"), F.array().cast("array<struct<line:int,column:int>>").alias("hits")
    )

    def step(acc: Column, piece: Column) -> Column:
        first = acc["n"] < 0
        match = F.when(first, F.lit("")).otherwise(F.substring_index(piece, _END, 1))
        whole = F.when(first, piece).otherwise(F.replace(piece, F.lit(_END), F.lit("")))
        ok = ~first & (F.length(match) > 0)
        if whole_word:
            nxt = F.substring(piece, F.length(match) + 2, F.lit(1))
            ok = ok & ~acc["before"].rlike(_WORD) & ~nxt.rlike(_WORD)
        if cap is not None:
            ok = ok & (acc["n"] < cap)
        line = (acc["line"] + 1).cast("int")
        new = F.array(F.struct(line.alias("line"), (acc["bytes"] + 1).cast("int").alias("column")))
        breaks = breaks_in(whole)
        tail = F.octet_length(F.substring_index(whole, "\n", -1))
        return F.struct(
            F.when(first, 0).otherwise(acc["n"] + F.when(ok, 1).otherwise(0)).alias("n"),
            (acc["line"] + breaks).alias("line"),
            F.when(breaks > 0, tail).otherwise(acc["bytes"] + tail).alias("bytes"),
            F.when(F.length(whole) > 0, F.substring(whole, -1, 1)).otherwise(acc["before"]).alias("before"),
            F.when(ok, line).otherwise(acc["last"]).alias("last"),
            F.when(ok & (acc["last"] != line), F.concat(acc["hits"], new)).otherwise(acc["hits"]).alias("hits"),
        )

    return F.aggregate(pieces, zero, step, lambda a: F.struct(a["n"].alias("n"), a["hits"].alias("hits")))


def hit_lines(docs: DataFrame, q: Query) -> DataFrame:
    """(doc_id, path, lang, line, column, raw): one row a line with a match, with the byte column of the first."""
    if not q.pattern:
        return docs.select("doc_id", "path", "lang", F.lit(0).alias("line"), F.lit(0).alias("column"), "text").withColumnRenamed("text", "raw").limit(0)
    docs, pattern = in_scope(docs, q), java_pattern(q)
    by_line = regexlang.stays_in_line(q.pattern) if q.regex else "\n" not in q.pattern
    if by_line:
        lines = docs.select("doc_id", "path", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
        plain = not q.regex and not q.case_insensitive
        lines = lines.where(F.col("raw").contains(q.pattern) if plain else F.col("raw").rlike(pattern))
        if plain and not q.whole_word:
            at = F.octet_length(F.substring_index("raw", q.pattern, 1)) + 1
            found = lines.select("doc_id", "path", "lang", (F.col("pos") + 1).alias("line"), at.cast("int").alias("column"), "raw", T.count_of(F.col("raw"), q.pattern).cast("int").alias("n"))
        else:
            if q.whole_word:  # holds for every line with a whole word, so that the fold sees few others
                lines = lines.where(F.col("raw").rlike(f"(?<!{_WORD})(?:{pattern})(?!{_WORD})"))
            hits = lines.withColumn("m", _located(F.col("raw"), pattern, q.whole_word)).where(F.size("m.hits") > 0)
            found = hits.select("doc_id", "path", "lang", (F.col("pos") + 1).alias("line"), F.col("m.hits")[0]["column"].alias("column"), "raw", F.col("m.n").alias("n"))
        if not q.exhaustive:
            before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("line")) - F.col("n")
            found = found.withColumn("before", before).where(F.col("before") < MATCH_CAP).drop("before")
        return found.drop("n")
    hits = _located(F.col("text"), pattern, q.whole_word, None if q.exhaustive else MATCH_CAP)["hits"]
    rows = docs.select("doc_id", "path", "lang", F.split("text", "\n").alias("all"), F.explode(hits).alias("h"))
    return rows.select("doc_id", "path", "lang", F.col("h.line").alias("line"), F.col("h.column").alias("column"), F.col("all")[F.col("h.line") - 1].alias("raw"))


def scored(hits: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Adds the score: 1, the path's, and 3 where a symbol starts on the line (without symbols: a scan, no such bonus)."""
    base = 1.0 + T.path_score(F.col("path"))
    if symbols is None:
        return hits.withColumn("score", F.round(base, 4))
    starts = symbols.select("doc_id", F.col("line_start").alias("line"), F.lit(3.0).alias("bonus")).distinct()
    return hits.join(starts, ["doc_id", "line"], "left").withColumn("score", F.round(base + F.coalesce("bonus", F.lit(0.0)), 4)).drop("bonus")


def search(docs: DataFrame, q: Query, symbols: DataFrame | None = None) -> DataFrame:
    """(path, lang, line, column, text, score): a page of ranked hits, or all in order."""
    hits = scored(hit_lines(docs, q), symbols)
    out = ["path", "lang", "line", "column", T.display(F.col("raw")).alias("text"), "score"]
    if q.exhaustive:
        return hits.select(*out).orderBy("path", "line", "column")
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "line")
    kept = hits.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= q.max_per_file)
    page = kept.orderBy(F.desc("score"), "path", "line").offset(q.offset).limit(q.limit)
    return page.select(*out)


def plan(q: Query) -> trigram.Plan:
    """What the index must hold of a document that matches."""
    if q.regex:
        return trigram.regex_plan(q.pattern, q.case_insensitive)
    return trigram.ignore_case_plan(q.pattern) if q.case_insensitive else trigram.literal_plan(q.pattern)


def indexed(docs: DataFrame, postings: DataFrame, q: Query, symbols: DataFrame | None = None) -> DataFrame:
    """As search, over the documents that the postings admit: few trigrams are read, and texts of candidates alone matched."""
    return search(trigram.candidates(postings, docs, plan(q)), q, symbols)


def references(docs: DataFrame, name: str, symbols: DataFrame | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Whole-word occurrences of a name in texts."""
    return search(docs, Query(name, whole_word=True, limit=limit, offset=offset), symbols)


def by_file(page: DataFrame) -> DataFrame:
    """(path, lang, rank, hits): the files of a page in order of their best hit, with [line, column, text] in rank order."""
    ranked = page.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path", "line")))  # a page is small by its limit
    files = ranked.groupBy("path", "lang").agg(F.min("rank").alias("rank"), F.array_sort(F.collect_list(F.struct("rank", "line", "column", "text"))).alias("h"))
    return files.select("path", "lang", "rank", F.transform("h", lambda h: F.concat_ws(":", h["line"].cast("string"), h["column"].cast("string"), h["text"])).alias("hits"))


def exhaustive(q: Query) -> Query:
    return replace(q, exhaustive=True)
