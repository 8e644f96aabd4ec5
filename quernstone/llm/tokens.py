"""Exact token ids of public vocabularies, a whole Arrow batch at a time.

The pre-tokeniser of the byte-level vocabularies always cuts before a single space that stands between two other
characters, and the piece-based vocabulary joins a space to the word after it, so a text can be cut there and each piece
encoded apart. Pieces repeat: a batch is split and dictionary-encoded by Arrow, its distinct pieces are encoded in one
call, and the ids are gathered back by index. A text in which the rule fails (a space beside a space, white space on
both sides of one, the piece mark itself) is encoded whole. Results equal those of the library on each whole text.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZERS = "/opt/tokenizers"
#: The pre-tokeniser pattern published with the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WHOLE = rf"  |{_SPACE} {_SPACE}|\x{{2581}}|^ | $"
_CALL = 1 << 17
_BYTES = 4 << 20


class Vocabulary:
    """name: a file of the tokenizers' folder, .tiktoken or .model. data: its bytes. Ids fit 16 bits in both kinds."""

    def __init__(self, name: str, data: bytes):
        self.name = name
        if name.endswith(".tiktoken"):
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
            self.whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.size = max(ranks.values()) + 1
            self.starts = np.zeros(self.size, bool)
            self.starts[[i for b, i in ranks.items() if b[:1] == b" "]] = True
            self.is_byte = np.zeros(self.size, bool)
            self.is_byte[[i for b, i in ranks.items() if len(b) == 1 and b[0] >= 128]] = True
            self.prefixed = False
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.whole, self.size = sp.encode, sp.vocab_size()
            self.starts = np.array([sp.id_to_piece(i)[:1] == "▁" for i in range(self.size)])
            self.is_byte = np.array([sp.is_byte(i) for i in range(self.size)])
            self.prefixed = True

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that each follow a space, and their number for each piece."""
        parts, counts = [], []
        for lo in range(0, len(pieces), _CALL):
            some = pieces.slice(lo, _CALL)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_py()
            ids = np.asarray(self.whole(joined if self.prefixed else " " + joined), dtype=np.int32)
            at = np.flatnonzero(self.starts[ids])
            n = np.diff(np.append(at, len(ids)))
            if len(n) != len(some) or (len(at) and at[0]):
                each = [self.whole(p if self.prefixed else " " + p) for p in some.to_pylist()]
                ids, n = np.array([i for e in each for i in e], dtype=np.int32), np.array([len(e) for e in each])
            parts.append(ids)
            counts.append(n)
        if not parts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        return np.concatenate(parts), np.concatenate(counts)

    def encode(self, col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of the texts). A null text counts as empty."""
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        col = pc.fill_null(col, "")
        n = len(col)
        ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64))
        if n > 1 and ends[-1] > _BYTES:  # a few at a time, for the worker's memory
            parts, lo = [], 0
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _BYTES, "right")))
                parts.append(self.encode(col.slice(lo, hi - lo)))
                lo = hi
            lengths = np.concatenate([np.diff(o) for _, o in parts])
            return np.concatenate([i for i, _ in parts]), np.concatenate([[0], np.cumsum(lengths)])
        whole = pc.match_substring_regex(col, _WHOLE).to_numpy(zero_copy_only=False)
        empty = pc.equal(col, "").to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~whole & ~empty)
        lists = pc.split_pattern(col.take(pa.array(rest)), " ")
        offs = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py() if len(rest) else np.zeros(1, np.int64)
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        words = coded.dictionary
        flat, count = self._pieces(words)
        start = np.concatenate([[0], np.cumsum(count)])[:-1] if len(count) else np.empty(0, np.int64)
        n_each, at = count[index], start[index]
        apart: list[tuple[int, np.ndarray]] = []
        if not self.prefixed and len(rest):
            first = offs[:-1]
            memo: dict[int, np.ndarray] = {}
            n_each = n_each.copy()
            for j, w in zip(first.tolist(), index[first].tolist(), strict=True):
                if w not in memo:
                    memo[w] = np.asarray(self.whole(words[w].as_py()), dtype=np.int32)
                n_each[j] = len(memo[w])
                apart.append((j, memo[w]))
        ends = np.cumsum(n_each)
        ids = flat[np.repeat(at - (ends - n_each), n_each) + np.arange(ends[-1])] if len(ends) and not apart else None
        if ids is None:
            ids = self._gather(flat, at, n_each, ends, apart)
        bounds = np.concatenate([[0], ends])[offs] if len(rest) else np.zeros(1, np.int64)
        if not whole.any():
            lengths = np.zeros(n, np.int64)
            lengths[rest] = np.diff(bounds)
            return ids, np.concatenate([[0], np.cumsum(lengths)])
        parts, lengths, k = [], np.zeros(n, np.int64), 0
        for i in range(n):
            if whole[i]:
                part = np.asarray(self.whole(col[i].as_py()), dtype=np.int32)
            elif not empty[i]:
                part = ids[bounds[k] : bounds[k + 1]]
                k += 1
            else:
                continue
            parts.append(part)
            lengths[i] = len(part)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])

    @staticmethod
    def _gather(flat, at, n_each, ends, apart) -> np.ndarray:
        """As flat[at : at + n_each] for each piece, but for the pieces that stand first in their texts."""
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return np.empty(0, np.int32)
        src = np.repeat(at - (ends - n_each), n_each)
        src += np.arange(total)
        ids = flat[np.minimum(src, max(len(flat) - 1, 0))] if len(flat) else np.empty(total, np.int32)
        for j, own in apart:
            ids[ends[j] - len(own) : ends[j]] = own
        return ids


_loaded: dict[str, Vocabulary] = {}


def load(name: str, data: bytes) -> Vocabulary:
    """The vocabulary, built once in each worker."""
    if name not in _loaded:
        _loaded[name] = Vocabulary(name, data)
    return _loaded[name]


def read_file(folder: str, name: str) -> bytes:
    with open(f"{folder}/{name}", "rb") as f:
        return f.read()
