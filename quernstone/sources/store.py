"""The index on disk: immutable segments of Parquet, a manifest swapped by rename, and incremental maintenance.

A reader takes its files from the manifest, never from a listing of folders, so it sees a whole state or the one before.
A segment's documents, symbols, references and trigram postings (in order of trigram) are written first, and their
files' sums; the manifest's rename is the only commit. The folder may be on any file system that Hadoop knows.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions import trigram
from .fs import Folder

SCHEMA_VERSION = 2
TABLES = ("docs", "symbols", "refs", "postings")


class Corrupt(RuntimeError):
    """The index can't be read as it is; build it anew."""


@dataclass
class Manifest:
    schema_version: int = SCHEMA_VERSION
    segments: list[int] = field(default_factory=list)
    next_segment_id: int = 1
    last_indexed: int = 0
    doc_count: int = 0
    symbol_count: int = 0
    tombstones: list[int] = field(default_factory=list)  # ids of generations of dead rows
    measures: dict[str, list[int]] = field(default_factory=dict)  # [files, bytes] of each folder of a segment
    head: list[str] | None = None  # commit and branch of the tree, where it is a repository


def classify(walk: DataFrame, state: DataFrame) -> DataFrame:
    """(path, status): added, changed, touched, deleted or same, of two snapshots of (path, size, mtime_ns, hash)."""
    a = walk.select("path", F.col("size").alias("s1"), F.col("mtime_ns").alias("m1"), F.col("hash").alias("h1"))
    b = state.select("path", F.col("size").alias("s0"), F.col("mtime_ns").alias("m0"), F.col("hash").alias("h0"))
    same_stat = (F.col("s1") == F.col("s0")) & (F.col("m1") == F.col("m0"))
    status = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "deleted").when(same_stat, "same").when(F.col("h1") == F.col("h0"), "touched").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def renames(walk: DataFrame, state: DataFrame, changes: DataFrame) -> DataFrame:
    """(old_path, new_path): deleted files whose content, size and language an added file has; one old for each new."""
    old = state.join(changes.where("status = 'deleted'"), "path").select(F.col("path").alias("old_path"), "hash", "size", "lang")
    new = walk.join(changes.where("status = 'added'"), "path").select(F.col("path").alias("new_path"), "hash", "size", "lang")
    return new.join(old, ["hash", "size", "lang"]).groupBy("new_path").agg(F.min("old_path").alias("old_path")).select("old_path", "new_path")


def live(docs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows of (segment, doc_id) without a tombstone."""
    return docs.join(tombstones.select("segment", "doc_id").distinct(), ["segment", "doc_id"], "left_anti")


def compaction_plan(sizes: DataFrame, threshold: int) -> DataFrame:
    """(segment, n) of the smallest segments to merge, when there are more than threshold, down to half of it."""
    total = sizes.agg(F.count("*").alias("total"))
    ranked = sizes.withColumn("rn", F.row_number().over(Window.orderBy("n", "segment"))).crossJoin(F.broadcast(total))  # a row a segment
    return ranked.where((F.col("total") > threshold) & (F.col("rn") <= F.col("total") - max(threshold // 2, 1) + 1)).select("segment", "n")


class Store:
    """An index in a folder. extract: docs -> (symbols, refs)."""

    def __init__(self, spark: SparkSession, root: str, extract, threshold: int = 16):
        self.spark, self.root, self.extract, self.threshold = spark, root, extract, threshold
        self.folder = Folder(spark, root)

    # manifest

    def manifest(self) -> Manifest:
        if not self.folder.exists("manifest.json"):
            return Manifest()
        try:
            m = Manifest(**json.loads(self.folder.read("manifest.json")))
        except (ValueError, TypeError, Py4JJavaError) as e:
            raise Corrupt(str(e)) from e
        if m.schema_version != SCHEMA_VERSION:
            raise Corrupt(f"schema version {m.schema_version}")
        return m

    def publish(self, m: Manifest) -> None:
        m.last_indexed = int(time.time())
        self.folder.write("manifest.json", json.dumps(asdict(m)))

    def check(self, m: Manifest | None = None) -> None:
        """Whether all files that the manifest counts are there, in number and size; no data is read."""
        m = m or self.manifest()
        if not m.segments:
            raise Corrupt("no index")
        for name, measure in m.measures.items():
            if self.folder.measure(name) != measure:
                raise Corrupt(f"{name} isn't as it was written")

    def verify(self) -> None:
        """Reads every file again and compares its checksum with the one taken when it was written."""
        m = self.manifest()
        self.check(m)
        for i in m.segments:
            bad = self._sums(i).exceptAll(self.spark.read.parquet(f"{self.root}/segment-{i}/sums")).limit(1).collect()
            if bad:
                raise Corrupt(f"{bad[0].name} of segment {i} has changed")

    def _sums(self, segment: int) -> DataFrame:
        """(name, size, crc) of the files of a segment's tables."""
        paths = [f"{self.root}/segment-{segment}/{t}" for t in TABLES]
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(paths)
        return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.crc32("content").alias("crc"))

    # reading

    def _dead(self, m: Manifest) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.root}/dead-{i}" for i in m.tombstones]) if m.tombstones else None

    def table(self, name: str, m: Manifest | None = None) -> DataFrame:
        """Live rows of docs, symbols or refs."""
        m = m or self.manifest()
        if not m.segments:
            raise Corrupt("no index")
        parts = [self.spark.read.parquet(f"{self.root}/segment-{i}/{name}").withColumn("segment", F.lit(i)) for i in m.segments]
        rows, dead = reduce(DataFrame.unionByName, parts), self._dead(m)
        return rows if dead is None else live(rows, dead)

    # writing

    def _write(self, docs: DataFrame, m: Manifest, carried: dict[str, DataFrame] | None = None, moved: DataFrame | None = None) -> int:
        """A new segment. carried: its other tables. moved: (old_id, doc_id), whose symbols and references are those of old_id."""
        n = m.next_segment_id
        m.next_segment_id += 1
        name = f"segment-{n}"
        self.folder.delete(name)
        path = f"{self.root}/{name}"
        docs.write.parquet(f"{path}/docs")
        here = self.spark.read.parquet(f"{path}/docs")
        if carried is None:
            fresh = here if moved is None else here.join(moved, "doc_id", "left_anti")
            carried = dict(zip(("symbols", "refs"), self.extract(fresh), strict=True)) | {"postings": trigram.postings(here)}
            if moved is not None:
                for t in ("symbols", "refs"):
                    own = self.table(t, m).drop("segment").withColumnRenamed("doc_id", "old_id").join(moved, "old_id").drop("old_id")
                    carried[t] = carried[t].unionByName(own)
        for t in ("symbols", "refs"):
            carried[t].write.parquet(f"{path}/{t}")
        # each file in order of trigram, where its documents' postings are made: to order them all would make them twice and move them
        carried["postings"].sortWithinPartitions("tri", "doc_id").write.parquet(f"{path}/postings")
        self._sums(n).write.parquet(f"{path}/sums")
        m.segments.append(n)
        m.measures |= {f"{name}/{t}": self.folder.measure(f"{name}/{t}") for t in (*TABLES, "sums")}
        return n

    def _counts(self, m: Manifest) -> None:
        m.doc_count, m.symbol_count = self.table("docs", m).count(), self.table("symbols", m).count()
        kept = {f"segment-{i}" for i in m.segments} | {f"dead-{i}" for i in m.tombstones}
        m.measures = {k: v for k, v in m.measures.items() if k.split("/")[0] in kept}

    def full(self, docs: DataFrame, head: list[str] | None = None) -> Manifest:
        """All documents in one new segment; what was there goes after the swap."""
        try:
            old = self.manifest()
        except Corrupt:
            old = Manifest(next_segment_id=1 + max([0, *(int(x.split("-")[1]) for x in self.folder.names() if x.startswith(("segment-", "dead-")))]))
        m = Manifest(next_segment_id=old.next_segment_id, head=head)
        self._write(docs, m)
        self._counts(m)
        self.publish(m)
        self.sweep(m)
        return m

    def incremental(self, docs: DataFrame, head: list[str] | None = None) -> dict[str, int]:
        """Brings the index to the given documents by a new segment of what changed and tombstones of what went.

        What was only moved keeps its symbols and references. An index that doesn't hold together (files missing, or a
        path that is live twice) is built anew.
        """
        try:
            m = self.manifest()
            self.check(m)
            state = self.table("docs", m)
            if not state.groupBy("path").count().where("count > 1").isEmpty():
                raise Corrupt("a path is live twice")
        except Corrupt:
            self.full(docs, head)
            return {"added": self.manifest().doc_count}
        m.head = head
        changes = classify(docs, state).where("status <> 'same'").cache()
        counts = {r["status"]: r["count"] for r in changes.groupBy("status").count().collect()}  # four rows at most
        gone, new = changes.where("status in ('deleted', 'changed')"), changes.where("status in ('added', 'changed')")
        moved = None
        if counts.get("deleted") and counts.get("added"):
            pairs = renames(docs, state, changes)
            ids = state.select(F.col("path").alias("old_path"), F.col("doc_id").alias("old_id"))
            moved = pairs.join(ids, "old_path").join(docs.select(F.col("path").alias("new_path"), "doc_id"), "new_path").select("old_id", "doc_id").cache()
            counts["renamed"] = moved.count()
        if counts.get("added", 0) + counts.get("changed", 0):
            before = Manifest(**asdict(m))
            n = self._write(docs.select(*[c for c in state.columns if c != "segment"]).join(new, "path", "left_semi"), before, moved=moved if counts.get("renamed") else None)
            m.next_segment_id, m.measures = before.next_segment_id, before.measures
            m.segments.append(n)
        if counts.get("deleted", 0) + counts.get("changed", 0):
            i = m.next_segment_id
            m.next_segment_id += 1
            state.join(gone, "path", "left_semi").select("segment", "doc_id").write.mode("overwrite").parquet(f"{self.root}/dead-{i}")
            m.tombstones.append(i)
            m.measures[f"dead-{i}"] = self.folder.measure(f"dead-{i}")
        if counts.keys() - {"touched"}:
            self._counts(m)
            self.publish(m)
            if len(m.segments) > self.threshold:
                self.compact(m)
        changes.unpersist()
        if moved is not None:
            moved.unpersist()
        return counts

    def compact(self, m: Manifest | None = None, everything: bool = False) -> Manifest:
        """Merges the smallest segments, or all; symbols and references are carried over, not extracted anew."""
        m = m or self.manifest()
        if everything:
            some = list(m.segments)
        else:
            sizes = self.table("docs", m).groupBy("segment").agg(F.count("*").alias("n"))
            some = [r.segment for r in compaction_plan(sizes, self.threshold).collect()]  # a row a segment
        if len(some) < 2:
            return m
        rows = {t: self.table(t, m).where(F.col("segment").isin(some)).drop("segment") for t in TABLES}
        new = Manifest(**asdict(m))
        self._write(rows.pop("docs"), new, rows)
        new.segments = [s for s in new.segments if s not in some]
        if everything:
            new.tombstones = []
        self._counts(new)
        self.publish(new)
        self.sweep(new)
        return new

    def sweep(self, m: Manifest) -> None:
        """Deletes what the manifest doesn't name."""
        keep = {f"segment-{i}" for i in m.segments} | {f"dead-{i}" for i in m.tombstones}
        for name in self.folder.names():
            if name.startswith(("segment-", "dead-")) and name not in keep:
                self.folder.delete(name)

    def is_dirty(self, walk: DataFrame) -> bool:
        """Whether a file is new, changed or missing."""
        try:
            return not classify(walk, self.table("docs")).where("status in ('added', 'changed', 'deleted')").isEmpty()
        except Corrupt:
            return True

    def ensure(self, docs: DataFrame) -> bool:
        """Builds the index if it is absent, empty or unreadable."""
        try:
            self.check()
            if self.table("docs").limit(1).count():
                return False
        except Exception:  # any damage is mended by a rebuild
            pass
        self.full(docs)
        return True

    def status(self) -> dict:
        m = self.manifest()
        return {"root": self.root, "indexed": bool(m.segments), "segments": len(m.segments), "doc_count": m.doc_count, "symbol_count": m.symbol_count, "last_indexed": m.last_indexed, "head": m.head}

    def clean(self) -> None:
        self.folder.delete()
