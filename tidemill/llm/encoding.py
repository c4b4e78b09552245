"""Encoding of a whole corpus with a public byte-level BPE tokenizer (problem 8).

The text is split by the tokenizer's pattern; every piece is encoded by itself. A piece's bytes are
the leaves of a segment tree whose inner nodes hold the leftmost minimum of the pair ranks below
them. Each merge takes the root's pair, joins the two neighbours in a linked list of live parts,
and updates the ranks of at most three leaves, each along one path to the root. So a piece of n
bytes takes O(n log n) steps however long it is; there is no quadratic case and no cut.

Pieces repeat by Zipf's law, so a worker keeps the ids of the pieces it has seen in a table of
bounded size; what does not fit is simply encoded again. The vocabulary is read once a worker from
``path`` (a parameter; the file is not part of this repository).

Defined results: null and empty texts give an empty list; special tokens are never produced, and
their names in a text are ordinary text; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The folder with the public vocabularies and the file used by default.
TOKENIZERS, NAME = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker keeps, and the longest of them in characters.
KEPT, KEPT_LENGTH = 400_000, 48
_NONE = 1 << 30


class RankTree:
    """A segment tree over pair ranks: the leftmost least rank, and point updates in log n steps."""

    def __init__(self, ranks: list[int]):
        self.n = 1
        while self.n < len(ranks):
            self.n *= 2
        self.tree = [_NONE] * self.n + ranks + [_NONE] * (self.n - len(ranks))
        for i in range(self.n - 1, 0, -1):
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = a if a <= b else b

    def set(self, i: int, rank: int) -> None:
        tree = self.tree
        i += self.n
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a <= b else b
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1

    def first(self) -> int:
        """The leaf of the leftmost least rank."""
        tree, i, least = self.tree, 1, self.tree[1]
        while i < self.n:
            i *= 2
            if tree[i] != least:
                i += 1
        return i - self.n


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece of a text."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the live part that begins at a byte
        rank = lambda a, b: ranks.get(piece[a:b], _NONE)
        tree = RankTree([rank(i, i + 2) for i in range(n - 1)])
        while tree.tree[1] != _NONE:
            i = tree.first()
            j = end[i]
            end[i] = end[j]
            if end[i] < n:
                before[end[i]] = i
            if j < n - 1:
                tree.set(j, _NONE)
            tree.set(i, rank(i, end[end[i]]) if end[i] < n else _NONE)
            if before[i] >= 0:
                tree.set(before[i], rank(before[i], end[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


@functools.lru_cache(maxsize=2)
def _worker(path: str) -> tuple[Vocabulary, regex.Pattern, dict[str, list[int]]]:
    return Vocabulary(path), regex.compile(PATTERN), {}


def encode_texts(texts: list[str | None], path: str) -> list[list[int]]:
    vocabulary, pattern, kept = _worker(path)
    out = []
    for text in texts:
        ids: list[int] = []
        for piece in pattern.findall(text or ""):
            got = kept.get(piece)
            if got is None:
                got = vocabulary.encode_piece(piece.encode())
                if len(kept) < KEPT and len(piece) <= KEPT_LENGTH:
                    kept[piece] = got
            ids += got
        out.append(ids)
    return out


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{NAME}") -> DataFrame:
    """``key`` and ids of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ids = encode_texts(b[1].to_pylist(), path)
                flat = np.fromiter((x for row in ids for x in row), np.int32, sum(map(len, ids)))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b[0], pa.ListArray.from_arrays(offsets, flat)], [key, "ids"])

    rows = docs.select(docs[key], docs[text])
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(ids: list[int], path: str = f"{TOKENIZERS}/{NAME}") -> str:
    """The text of a list of ids."""
    back = {v: k for k, v in _worker(path)[0].ranks.items()}
    return b"".join(back[i] for i in ids).decode()
