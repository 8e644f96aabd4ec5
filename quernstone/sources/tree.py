"""Source trees as documents: ignore rules, skip reasons, binary and size filters, and a commit source."""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T

INDEX_DIR = ".quernstone"
SAMPLE = 100


@dataclass(frozen=True)
class Config:
    """Which files count. Environment variables QUERNSTONE_<FIELD> win over what is given."""

    max_file_size: int = 4 << 20
    index_binary: bool = False
    index_empty: bool = False
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ("**/node_modules/**", "**/target/**", "**/.git/**", f"**/{INDEX_DIR}/**")
    merge_threshold: int = 16
    extra: dict = field(default_factory=dict)

    @staticmethod
    def load(path: str | None = None) -> Config:
        import tomllib

        c = Config()
        given = tomllib.loads(Path(path).read_text()) if path and os.path.exists(path) else {}
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in Config.__dataclass_fields__}
        for k in ("max_file_size", "merge_threshold"):
            if (v := os.environ.get(f"QUERNSTONE_{k.upper()}")) and v.isdigit():
                known[k] = int(v)
        for k in ("index_binary", "index_empty"):
            if v := os.environ.get(f"QUERNSTONE_{k.upper()}"):
                known[k] = v.lower() in ("1", "true", "yes")
        return replace(c, **known)


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob, or an ignore rule's form of it."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i:]:
            j = glob.index("]", i)
            out, i = out + "[" + glob[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def ignore_rules(root: str) -> list[tuple[str, bool]]:
    """(pattern of relative paths, whether it ignores) of all ignore files of a tree, in order; the last that fits wins."""
    rules: list[tuple[str, bool]] = []
    for folder, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not d.startswith("."))
        rel = os.path.relpath(folder, root)
        base = "" if rel == "." else re.escape(rel) + "/"
        for name in (".gitignore", ".ignore"):
            if name not in files:
                continue
            for line in Path(folder, name).read_text(errors="replace").splitlines():
                rule = line.rstrip()
                if not rule or rule.startswith("#"):
                    continue
                keep = rule.startswith("!")
                rule = rule[keep:].removeprefix("\\")
                only_dir, anchored = rule.endswith("/"), "/" in rule.strip("/") or rule.startswith("/")
                body = ("" if anchored else "(?:.*/)?") + glob_pattern(rule.strip("/"))
                rules.append((f"^{base}{body}" + ("/.*$" if only_dir else "(?:/.*)?$"), not keep))
    return rules


def walk(spark: SparkSession, root: str, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(entries, skipped): files of a tree with size and time of change, and what was left out, by reason.

    entries: rel, size, mtime_ns. skipped: rel, reason. Contents aren't read.
    """
    root = os.path.abspath(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^file:/*", "/")
    files = files.select(F.substring(rel, len(root.rstrip("/")) + 2, 1 << 20).alias("rel"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    empty = [(os.path.relpath(os.path.join(d, f), root), 0, os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, fs in os.walk(root) for f in fs if os.path.getsize(os.path.join(d, f)) == 0]
    if empty:  # the file source leaves files of no bytes out
        files = files.where("size > 0").unionByName(spark.createDataFrame(empty, "rel string, size long, mtime_ns long"))
    ignored = F.lit(False)
    for pattern, yes in ignore_rules(root):
        ignored = F.when(F.col("rel").rlike(pattern), F.lit(yes)).otherwise(ignored)
    out = F.lit(False)
    for g in config.exclude:
        out = out | F.col("rel").rlike("^" + glob_pattern(g.removeprefix("!")) + "$")
    if config.include:
        allowed = F.lit(False)
        for g in config.include:
            if not g.startswith("!"):
                allowed = allowed | F.col("rel").rlike("^" + glob_pattern(g) + "$")
        out = out | ~allowed
        for g in config.include:
            if g.startswith("!"):
                out = out | F.col("rel").rlike("^" + glob_pattern(g[1:]) + "$")
    reason = F.when(F.col("rel").rlike(r"(^|/)\."), "hidden").when(ignored, "ignored").when(out, "excluded")
    if config.max_file_size:
        reason = reason.when(F.col("size") > config.max_file_size, "too_large")
    judged = files.withColumn("reason", reason.when(F.col("size") == 0, "empty"))
    skipped = judged.where("reason is not null").select("rel", "reason")
    return judged.where("reason is null").select("rel", "size", "mtime_ns"), skipped.where("reason <> 'empty'") if config.index_empty else skipped


def read(spark: SparkSession, root: str, config: Config = Config(), entries: DataFrame | None = None, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs, skipped): contents decoded with replacement; files with a NUL byte are skipped as binary unless asked for.

    entries: those of a walk to read, instead of a walk made here; skipped then holds binary files alone. only: their
    paths, where they are few, so that no other file is opened.
    """
    root = os.path.abspath(root)
    if entries is None:
        entries, skipped = walk(spark, root, config)
    else:
        skipped = spark.createDataFrame([], "rel string, reason string")
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = source.load(root if only is None else [os.path.join(root, x) for x in only] or root)
    rel = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(root.rstrip("/")) + 2, 1 << 20)
    found = files.select(rel.alias("rel"), "content").join(entries, "rel")
    # one character a byte, so that a NUL byte is a NUL character
    found = found.withColumn("binary", F.instr(F.decode("content", "ISO-8859-1"), "\0") > 0)
    if not config.index_binary:
        skipped = skipped.unionByName(found.where("binary").select("rel", F.lit("binary").alias("reason")))
        found = found.where("not binary")
    text = F.expr("try_validate_utf8(content)")
    text = F.coalesce(text.cast("string"), F.expr("make_valid_utf8(content)").cast("string"))
    docs = found.select(F.xxhash64("rel").alias("doc_id"), F.col("rel").alias("path"), T.language_of(F.col("rel")).alias("lang"), "size", "mtime_ns", F.xxhash64("content").alias("hash"), text.alias("text"))
    return docs.withColumn("lines", T.line_count(F.col("text"))), skipped


def skip_report(skipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exact count of each reason, a sample of at most 100 paths)."""
    return skipped.groupBy("reason").agg(F.count("*").alias("n")), skipped.orderBy("rel").limit(SAMPLE)


# commits


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or "git failed")
    return done.stdout


def head(root: str) -> tuple[str, str] | None:
    """(sha, branch), or None outside of a repository."""
    try:
        return _git(root, "rev-parse", "HEAD").strip(), _git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()
    except (RuntimeError, FileNotFoundError):
        return None


def blame(spark: SparkSession, root: str, path: str, line: int) -> DataFrame:
    """(path, line, commit, author, author_time, summary, content) of one line."""
    fields = {"path": path, "line": line}
    for i, x in enumerate(_git(root, "blame", "--porcelain", "-L", f"{line},{line}", "--", path).split("\n")):
        key, _, value = x.partition(" ")
        if i == 0:
            fields["commit"] = key[:12]
        elif x.startswith("\t"):
            fields["content"] = x[1:]
        elif key in ("author", "summary"):
            fields[key] = value
        elif key == "author-time":
            fields["author_time"] = int(value)
    return spark.createDataFrame([tuple(fields.get(k) for k in ("path", "line", "commit", "author", "author_time", "summary", "content"))], "path string, line int, commit string, author string, author_time long, summary string, content string")


def history(spark: SparkSession, root: str, path: str, start: int, end: int, limit: int = 20) -> DataFrame:
    """(commit, author, author_time, summary) of the commits that touched a range of lines, else the file."""
    form = "--format=%x01%H%x02%an%x02%at%x02%s"
    try:
        text = _git(root, "log", f"-n{limit}", form, "-s", f"-L{start},{end}:{path}")
    except RuntimeError:
        text = _git(root, "log", f"-n{limit}", form, "--", path)
    rows = [x.split("\n")[0].split("\x02") for x in text.split("\x01")[1:]]
    return spark.createDataFrame([(r[0][:12], r[1], int(r[2]), r[3]) for r in rows], "commit string, author string, author_time long, summary string")


def changed_since(spark: SparkSession, root: str, rev: str) -> DataFrame:
    """(path, status): files changed since a revision; of a rename the new path."""
    if rev.startswith("-"):
        raise ValueError("not a revision")
    rows = [x.split("\t") for x in _git(root, "diff", "--name-status", rev).splitlines() if x]
    return spark.createDataFrame([(r[-1], r[0][:1]) for r in rows], "path string, status string")
