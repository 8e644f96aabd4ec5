"""Savings log: what queries returned against what whole files would have taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DAY = 86_400


def tokens_saved(baseline: Column, returned: Column) -> Column:
    return F.floor(F.greatest(baseline - returned, F.lit(0)) / 4)


def ratio(baseline: Column, returned: Column) -> Column:
    return F.when(baseline > 0, F.greatest(baseline - returned, F.lit(0)) / baseline).otherwise(0.0)


def record(hits: DataFrame, docs: DataFrame, kind: str, ts: int) -> DataFrame:
    """One row of the log for a page of hits: results, size of their distinct files, characters returned."""
    sizes = hits.select("path").distinct().join(docs.select("path", "size"), "path").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("baseline_chars"))
    got = hits.agg(F.count("*").alias("results"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*hits.columns)))), F.lit(0)).alias("returned_chars"))
    return sizes.crossJoin(got).select(F.lit(ts).alias("ts"), F.lit(kind).alias("kind"), "results", "baseline_chars", "returned_chars")


def _sums(when: Column | None = None) -> list[Column]:
    c = (lambda x: F.sum(F.when(when, x).otherwise(0))) if when is not None else F.sum
    b, r = c(F.col("baseline_chars")), c(F.col("returned_chars"))
    return [c(F.lit(1)).alias("queries"), c(F.col("results")).alias("results"), b.alias("baseline_chars"), r.alias("returned_chars"), c(tokens_saved(F.col("baseline_chars"), F.col("returned_chars"))).alias("tokens_saved"), F.round(ratio(b, r), 6).alias("ratio")]


def report(log: DataFrame, now: Column) -> DataFrame:
    """(window, ...): the last day, the last week and all, both ends included. One pass over the log."""
    windows = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(s).cast("long").alias("back")) for n, s in (("24h", DAY), ("7d", 7 * DAY), ("all", None))])
    rows = log.select("*", F.explode(windows).alias("w")).where(F.col("w.back").isNull() | ((now - F.col("ts") >= 0) & (now - F.col("ts") <= F.col("w.back"))))
    return rows.groupBy(F.col("w.window").alias("window")).agg(*_sums())


def by_kind(log: DataFrame) -> DataFrame:
    return log.groupBy("kind").agg(*_sums()).orderBy(F.desc("tokens_saved"), "kind")


def range_size(docs: DataFrame, start: Column, end: Column) -> DataFrame:
    """(path, chars): bytes and one a line of a range of lines of each document."""
    part = F.slice(F.split("text", "\n"), F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0)))
    return docs.select("path", F.aggregate(part, F.lit(0), lambda a, x: a + F.octet_length(x) + 1).alias("chars"))
