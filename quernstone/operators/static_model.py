"""Static embeddings: a table of token vectors, read from a folder that all executors share, and their mean over a text.

The folder holds tokenizer.json and model.safetensors with a tensor "embeddings" (tokens x dim), if need be "mapping"
(token id to row) and "weights" (by token id), and maybe config.json with "normalize". Such a model needs no session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MOST_TOKENS = 512
_TYPES = {"F64": np.float64, "F32": np.float32, "F16": np.float16, "I64": np.int64, "I32": np.int32, "U32": np.uint32, "U8": np.uint8, "I8": np.int8, "BOOL": np.bool_}
_loaded: dict[str, StaticModel] = {}


def tensors(data: bytes) -> dict[str, np.ndarray]:
    """The tensors of a safetensors file: eight bytes of length, a JSON header of that length, and the values."""
    n = int.from_bytes(data[:8], "little")
    if len(data) < 8 or n > len(data) - 8:
        raise ValueError("not a safetensors file")
    out = {}
    for name, x in json.loads(data[8 : 8 + n]).items():
        if name == "__metadata__":
            continue
        a, b = x["data_offsets"]
        raw = data[8 + n + a : 8 + n + b]
        if x["dtype"] == "BF16":  # the high half of a 32-bit float
            flat = (np.frombuffer(raw, np.uint16).astype(np.uint32) << 16).view(np.float32)
        elif x["dtype"] in _TYPES:
            flat = np.frombuffer(raw, _TYPES[x["dtype"]])
        else:
            raise ValueError(f"tensor {name} has type {x['dtype']}")
        out[name] = flat.reshape(x["shape"])
    return out


class StaticModel:
    """Mean of the weighted vectors of a text's tokens, of length one if the model says so; zeros for no token."""

    def __init__(self, folder: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        raw = Path(folder, "model.safetensors").read_bytes()
        found = tensors(raw)
        if "embeddings" not in found or found["embeddings"].ndim != 2 or not found["embeddings"].shape[1]:
            raise ValueError("the model has no table of embeddings")
        self.table = found["embeddings"].astype(np.float32)
        self.mapping, self.weights = found.get("mapping"), found.get("weights")
        config = Path(folder, "config.json")
        self.normalize = bool(json.loads(config.read_text()).get("normalize", True)) if config.exists() else True
        self.unknown = self.tokenizer.token_to_id("[UNK]")
        lengths = sorted(len(t) for t in self.tokenizer.get_vocab())
        self.most_bytes = MOST_TOKENS * max(lengths[len(lengths) // 2] if lengths else 1, 1)
        self.dim = self.table.shape[1]
        self.id = f"static-{self.dim}-{len(self.table)}-{len(raw)}"

    def embed(self, texts: list[str]) -> np.ndarray:
        capped = [t if len(t) * 4 <= self.most_bytes else t.encode()[: self.most_bytes].decode(errors="ignore") for t in texts]
        out = np.zeros((len(texts), self.dim))
        for i, e in enumerate(self.tokenizer.encode_batch(capped, add_special_tokens=False)):
            ids = np.array([x for x in e.ids if x != self.unknown][:MOST_TOKENS], np.int64)
            if not len(ids):
                continue
            rows, w = ids, np.ones(len(ids))
            if self.mapping is not None:
                rows = np.where(ids < len(self.mapping), np.maximum(self.mapping[np.minimum(ids, len(self.mapping) - 1)], 0), 0)
            if self.weights is not None:
                w = np.where(ids < len(self.weights), self.weights[np.minimum(ids, len(self.weights) - 1)], 1.0)
            there = rows < len(self.table)
            out[i] = w[there] @ self.table[rows[there]].astype(np.float64) / len(ids)
        out = out.astype(np.float32)
        if self.normalize:
            out /= np.sqrt((out * out).sum(axis=1, keepdims=True)) + np.float32(1e-32)
        return out


def load(folder: str) -> StaticModel:
    """The model, read once in each process."""
    if folder not in _loaded:
        _loaded[folder] = StaticModel(folder)
    return _loaded[folder]


def embedding(texts: DataFrame, folder: str, text: str = "text") -> DataFrame:
    """(chunk_id, embedding) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = load(folder).embed([t or "" for t in b.column("text").to_pylist()])
            offs = pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.ListArray.from_arrays(offs, pa.array(v.ravel()))], ["chunk_id", "embedding"])

    return texts.select("chunk_id", F.col(text).alias("text")).mapInArrow(run, "chunk_id long, embedding array<float>")
