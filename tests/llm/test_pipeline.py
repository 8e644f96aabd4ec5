"""The pipeline's stages, each on what the stage before it kept, against plain Python."""

from __future__ import annotations

import os
import re

import pytest

import corpus_pipeline
from quernstone.llm import packing, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns and {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
    before, after = kept["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.doc_id for r in toxicity.scores(before, toxicity.train(before, labels)).where("rejected").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = kept["line_dedup"]
    seen, want = set(), {}
    for r in before.orderBy("doc_id").collect():
        out = []
        for line in r.text.split("\n"):
            s = line.strip()
            if len(s) < 10 or s not in seen:
                out.append(line)
            seen.add(s)
        if "\n".join(out).strip() or len(out) == len(r.text.split("\n")):
            want[r.doc_id] = "\n".join(out)
    got = {r.doc_id: r.text for r in after.collect()}
    assert set(got) <= set(want) and sum(got.get(i) == t for i, t in want.items()) >= 0.98 * len(want)
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = kept["near_dedup"]
    words = lambda t: tuple(re.findall(r"[^\W_]+", t.lower()))
    texts = [words(r.text) for r in after.collect() if words(r.text)]
    assert len(texts) == len(set(texts))
    before, after = kept["decontamination"]
    grams = {g for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words(r.text)] for g in zip(*[w[i:] for i in range(8)], strict=False)}
    hit = {r.doc_id for r in before.collect() if any(g in grams for g in zip(*[words(r.text)[i:] for i in range(8)], strict=False))}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - hit
    before, after = kept["packing"]
    assert {r.doc_id: r[1] for r in after.groupBy("doc_id").sum("length").collect()} == {r.doc_id: r.n_tokens for r in packing.lengths(before).where("n_tokens > 0").collect()}
