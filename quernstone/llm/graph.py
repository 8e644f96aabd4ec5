"""Candidate pairs of buckets without squares of their sizes, and connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from . import common


#: At most so many rounds of further leaders, while more than so many pairs are left; members of a block of pairs.
ROUNDS, FEW, BLOCK = 3, 1_000_000, 2000


def star_edges(members: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Verified edges (v, u, similarity) among (v, bucket), v > u, that connect all that meet in a bucket and verify.

    Each member is compared with its bucket's leader, the least v: one edge a member, however large the bucket. While
    the pairs of buckets whose members are in different components are many, rounds of other leaders join components. Then all such pairs are compared: a pair is left out only if its two are connected already.
    A bucket of n members that nothing connects thus takes n^2 / 2 comparisons, in blocks. verify gets (v, u).
    """
    # an aggregate and a join, not a window: partial aggregates shrink a hot bucket, and a skewed join can be split
    leads = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("v").alias("lead")).where("size > 1")
    shared = common.checkpoint(members.join(leads, "bucket"))
    pairs = common.checkpoint(shared.where("v <> lead").select("v", F.col("lead").alias("u")).distinct())
    edges = common.checkpoint(verify(pairs))
    shared = shared.where("size > 2").select("v", "bucket")
    for i in range(ROUNDS + 1):
        label = components(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
        parts = common.checkpoint(shared.join(label, "v", "left").select("v", "bucket", F.coalesce("label", "v").alias("label")))
        n = parts.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("size"), F.sum(F.col("n").cast("double") * F.col("n")).alias("inside")).where("size * size > inside")
        mixed = common.checkpoint(n)
        members_left, pairs_left = mixed.agg(F.sum("size"), F.sum((F.col("size").cast("double") * F.col("size") - F.col("inside")) / 2)).first()
        if not members_left:
            return edges
        parts = parts.join(mixed.select("bucket", "size"), "bucket")
        if i == ROUNDS or pairs_left <= FEW:
            break
        other = parts.groupBy("bucket").agg(F.min_by(F.struct("v", "label"), F.xxhash64("v", F.lit(i))).alias("lead"))
        met = parts.join(other, "bucket").where("label <> lead.label").select(F.greatest("v", "lead.v").alias("v"), F.least("v", "lead.v").alias("u")).distinct()
        met = common.checkpoint(met.join(pairs, ["v", "u"], "left_anti"))
        pairs, edges = common.checkpoint(pairs.unionByName(met)), common.checkpoint(edges.unionByName(verify(met)))
    blocks = F.ceil(F.col("size") / BLOCK)
    mine = parts.select("v", "label", "bucket", F.pmod(F.xxhash64("v"), blocks).alias("block"))
    others = parts.select(F.col("v").alias("u"), F.col("label").alias("other"), "bucket", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    more = mine.join(others, ["bucket", "block"]).where("v > u and label <> other").select("v", "u").distinct()
    more = more.join(pairs, ["v", "u"], "left_anti")
    return edges.unionByName(common.checkpoint(verify(common.checkpoint(more))))


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the least vertex of each vertex's component. edges: (a, b). By star contraction."""
    e = common.checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        ms = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(ms, "a")
        e = common.checkpoint(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(ms.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return e.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("v"), "label")
        last = now
