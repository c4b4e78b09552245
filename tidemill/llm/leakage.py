"""Evaluation passages inside a corpus (problem 9).

Texts become sequences of word hashes (case, punctuation, spacing and invisible characters do not
count). Candidates come from locality-sensitive hashing under edit distance: the CGK random walk
maps a window of ``WINDOW`` words to ``STEPS`` symbols so that a small edit distance becomes a small
Hamming distance; ``REPEATS`` times, ``BITS`` of these symbols, drawn at random, are the bucket. Item
windows start at every word, document windows at every ``STRIDE``-th, so a leaked stretch of a third
of a passage holds several of them. A window with more than ``EDITS`` words that no item has cannot
lie within ``EDITS`` edits of one and is not hashed.

Every candidate is verified exactly: a third of the passage's words in a row must lie within an edit distance of one word in
``EDIT_SHARE`` of a part of the document. Along a diagonal these are replaced words, counted in all windows of that size that
begin and end with an equal word; over near diagonals, where words were lost or added, the edit distance is computed in a band.
A pair's stretch that is free of edits over a window is found for certain; with two edits in a window the chance of
one window is about 0.85, and of a stretch's several windows above 0.98.

The items are the stated query set: their hash tables are made in blocks of ``BLOCK`` items and broadcast (about 5 KB an item); all
blocks are searched in one pass over the corpus. Nothing of the corpus is collected. Windows have ``WINDOW`` words, and fewer
for items whose third is shorter.

Defined results: null and empty texts contain nothing; an item without a word leaks nowhere; items
that share a passage are each reported; a passage that occurs twice in a document is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import tokens

WINDOW, STRIDE, STEPS, BITS, REPEATS, EDITS = 16, 4, 32, 6, 8, 4
#: Items of a block; the part of a passage that is a case; words of a stretch for every edit it may hold.
BLOCK, SHARE, EDIT_SHARE, SEED = 4_000, 3, 8, 20


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after another, and how many each text has."""
    flat = tokens.Flat(column, without=tokens.HIDDEN)
    start, end = flat.runs(tokens.LETTER | tokens.MARK | tokens.DIGIT)
    return flat.hashes(start, end), np.bincount(flat.row_of(start), minlength=flat.rows)


def allowed(need: int) -> int:
    """Edits that a stretch of ``need`` words may hold."""
    return (need + EDIT_SHARE // 2) // EDIT_SHARE


class Family:
    """Items whose third is long enough for windows of ``w`` words, and their hash table."""

    def __init__(self, items: list[tuple[int, np.ndarray]], w: int, stride: int) -> None:
        self.w, self.stride, self.steps = w, stride, 2 * w
        self.items, self.needs = items, np.array([-(-len(p) // SHARE) for _, p in items])
        self.vocabulary = np.unique(np.concatenate([p for _, p in items]))
        v = len(self.vocabulary)
        rng = np.random.default_rng(SEED)
        bits = min(BITS, w)
        self.moves = rng.integers(0, 2, (REPEATS, self.steps, v + 2), dtype=np.int8)
        self.drawn = np.stack([np.sort(rng.choice(self.steps, bits, replace=False)) for _ in range(REPEATS)])
        coded = [np.searchsorted(self.vocabulary, p).astype(np.int32) for _, p in items]
        self.passages = np.full((len(items), max(map(len, coded))), -2, np.int32)
        for i, c in enumerate(coded):
            self.passages[i, : len(c)] = c
        self.lengths = np.array([len(c) for c in coded])
        flat = np.concatenate(coded)
        start = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        at = np.concatenate([np.arange(max(0, n - w + 1)) + s for n, s in zip(self.lengths, start)])
        item = np.repeat(np.arange(len(items)), np.maximum(0, self.lengths - w + 1))
        self.tables = []
        for r in range(REPEATS):
            key = self.keys(flat, at, r)
            order = np.argsort(key, kind="stable")
            self.tables.append((key[order], item[order].astype(np.int32), (at - start[item])[order].astype(np.int32)))

    def keys(self, flat: np.ndarray, at: np.ndarray, r: int) -> np.ndarray:
        """Buckets of the windows that begin at ``at``: a walk of ``steps`` symbols, of which the drawn ones are hashed."""
        i = np.zeros(len(at), np.int32)
        key = np.full(len(at), r, np.uint64)
        pad = len(self.vocabulary) + 1
        padded = np.append(flat, np.int32(pad))
        drawn, last = set(self.drawn[r].tolist()), int(self.drawn[r][-1])
        for step in range(last + 1):
            symbol = padded[np.where(i < self.w, at + i, len(flat))]
            if step in drawn:
                key = (key ^ symbol.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            i += self.moves[r, step][symbol]
        return key

    def search(self, flat64: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
        """(row, item id) of documents given as their word hashes one after another."""
        if not len(flat64):
            return []
        v = len(self.vocabulary)
        code = np.minimum(np.searchsorted(self.vocabulary, flat64), v - 1).astype(np.int32)
        known = self.vocabulary[code] == flat64
        code[~known] = v
        seen = np.concatenate([[0], np.cumsum(~known)])
        start = np.concatenate([[0], np.cumsum(sizes)])
        row_of = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(flat64) - self.w + 1) if len(flat64) >= self.w else np.zeros(0, int)
        at = at[((at - start[row_of[at]]) % self.stride == 0) & (at + self.w <= start[row_of[at] + 1])]
        at = at[seen[at + self.w] - seen[at] <= min(EDITS, self.w // 4)]
        if not len(at):
            return []
        found = []
        for r, (keys, item, pos) in enumerate(self.tables):
            k = self.keys(code, at, r)
            a, b = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            n = b - a
            hit = np.repeat(np.arange(len(at)), n)
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            found.append(np.unique(np.stack([row_of[at[hit]], item[entry], at[hit] - start[row_of[at[hit]]] - pos[entry]], 1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return self._verified(pairs, code, start)

    def _verified(self, pairs: np.ndarray, code: np.ndarray, start: np.ndarray) -> list[tuple[int, int]]:
        good, most = np.zeros(len(pairs), bool), np.zeros(len(pairs), int)
        for lo in range(0, len(pairs), 10_000):
            good[lo : lo + 10_000], most[lo : lo + 10_000] = self._stretch(pairs[lo : lo + 10_000], code, start)
        out = {(int(r), int(i)) for r, i, _ in pairs[good]}
        # Where words were lost or added, a stretch goes on along a near diagonal.
        part: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (r, i, g), n in zip(pairs[most > 1], most[most > 1]):
            part.setdefault((int(r), int(i)), []).append((int(g), int(n)))
        for (r, i), spans in part.items():
            need = int(self.needs[i])
            if (r, i) not in out and len(spans) > 1:
                tried = {g for g, _ in spans if sum(n for h, n in spans if abs(g - h) <= EDITS) >= need - allowed(need)}
                doc, passage = code[start[r] : start[r + 1]], self.passages[i, : self.lengths[i]]
                if any(edited(doc, passage, need, g) for g in sorted(tried)):
                    out.add((r, i))
        return [(r, self.items[i][0]) for r, i in out]

    def _stretch(self, p: np.ndarray, code: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a pair's diagonal holds a stretch of enough passage words that begins and ends with an equal word and has no
        more than the allowed number of others; and the most equal words that so many in a row have."""
        row, item, diagonal = p[:, 0], p[:, 1], p[:, 2]
        low, high, length = start[row], start[row + 1], self.lengths[item]
        q = np.arange(int(length.max()) if len(p) else 0)
        at = (low + diagonal)[:, None] + q
        inside = (at >= low[:, None]) & (at < high[:, None]) & (q < length[:, None])
        same = inside & (code[np.where(inside, at, 0)] == self.passages[item][:, : len(q)])
        total = np.concatenate([np.zeros((len(p), 1), np.int32), np.cumsum(same, 1, dtype=np.int32)], 1)
        good, most = np.zeros(len(p), bool), np.zeros(len(p), int)
        for need in np.unique(self.needs[item]):
            k, edits = np.nonzero(self.needs[item] == need)[0], allowed(int(need))
            for size in range(need, min(need + edits, len(q)) + 1):
                equal = total[k, size:] - total[k, : total.shape[1] - size]
                most[k] = np.maximum(most[k], equal.max(1, initial=0)) if size == need else most[k]
                good[k] |= ((equal >= size - edits) & same[k, : equal.shape[1]] & same[k, size - 1 :][:, : equal.shape[1]]).any(1)
        return good, most


def edited(doc: np.ndarray, passage: np.ndarray, need: int, diagonal: int) -> bool:
    """Whether ``need`` passage words in a row lie within the allowed edit distance of a part of the document near a diagonal."""
    limit = allowed(need)
    for q in range(len(passage) - need + 1):
        a = max(0, q + diagonal - EDITS)
        part = doc[a : max(0, q + diagonal + need + EDITS)]
        step = np.arange(len(part) + 1)
        cost = np.zeros(len(part) + 1, int)
        for word in passage[q : q + need]:
            new = np.append(cost[0] + 1, np.minimum(cost[:-1] + (part != word), cost[1:] + 1))
            cost = np.minimum.accumulate(new - step) + step  # added words of the document
            if cost.min() > limit:
                break
        if cost.min() <= limit:
            return True
    return False


def families(items: list[tuple[int, np.ndarray]]) -> list[Family]:
    by: dict[tuple[int, int], list] = {}
    for key, p in items:
        need = -(-len(p) // SHARE)
        if need:
            shape = (WINDOW, STRIDE) if need >= WINDOW + STRIDE - 1 else (max(1, (need + 1) // 2), 1)
            by.setdefault(shape, []).append((key, p))
    return [Family(rows, *shape) for shape, rows in by.items()]


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage") -> DataFrame:
    """``key``, ``item`` of every document that holds a third of an item's passage in one stretch."""
    spark = docs.sparkSession
    rows = docs.filter(docs[text].isNotNull()).select(docs[key].alias("key"), docs[text].alias("text"))
    kinds = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` {items.schema[item].dataType.simpleString()}"
    coded = items.filter(items[passage].isNotNull() & items[item].isNotNull()).select(items[item].alias("item"), items[passage].alias("text"))
    tables = []
    for lo, hi in _blocks(coded):
        block = coded.filter(F.col("item").between(lo, hi)).distinct().toArrow().combine_chunks()
        flat, sizes = words(block["text"].combine_chunks() if block.num_rows else pa.array([], pa.string()))
        each = np.split(flat, np.cumsum(sizes)[:-1])
        tables.append(spark.sparkContext.broadcast(families(list(zip(block["item"].to_pylist(), each)))))
    if not tables:
        return spark.createDataFrame([], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.pieces(batches, "text"):
            flat, sizes = words(b["text"])
            hits = [h for t in tables for f in t.value for h in f.search(flat, sizes)]
            yield pa.RecordBatch.from_arrays([b["key"].take(pa.array([r for r, _ in hits], pa.int64())), pa.array([i for _, i in hits], pa.int64())], [key, item])

    return rows.mapInArrow(run, kinds).distinct()


def _blocks(coded: DataFrame) -> list[tuple[int, int]]:
    """Ranges of item ids with at most about ``BLOCK`` items each."""
    n, lo, hi = coded.agg(F.count("item"), F.min("item"), F.max("item")).first()
    if not n:
        return []
    parts = -(-n // BLOCK)
    if parts == 1:
        return [(lo, hi)]
    cuts = coded.stat.approxQuantile("item", [k / parts for k in range(1, parts)], 0.001)
    edges = [lo, *sorted({int(c) for c in cuts if lo < int(c) <= hi}), hi + 1]
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]
