"""Subject areas of documents (problem 10).

1. Terms. Words and pairs of words whose labelled documents lie mostly in one subject (smoothed
   posterior of at least ``PURE`` and log-likelihood ratio of at least ``LEAST_G``), and which a document that has
   them repeats (``BURST`` times on average, counted over the whole corpus), are the features; names and
   the frames of sentences fall out. The hand-made labels are the only ones used. No number of terms is set.
2. Vectors. A document is the vector of its terms' counts, dampened and of unit length; the same for every sentence.
3. Bisecting k-means over all document vectors, to ``LEAVES`` leaves (the k of k-means). In every round the half of the
   leaves with the greatest spread (1 - cohesion squared, by the root of the size) is split, as far as it is above ``SPREAD``.
   Lloyd steps run over the whole corpus until no centre moves by more than ``MOVED`` (at most ``STEPS`` times): sums by
   (half, term) combine before anything reaches the driver, which sees at most leaves x terms numbers. Only the
   seeds of a split come from a bounded sample (``SEEDS`` documents with the smallest hashes): the best of ``TRIES`` pairs
   of centres of ``EACH`` documents. The centres are broadcast (leaves x terms numbers).
4. Leaves are labelled by their discriminative terms: the mixture of the subjects of the terms
   that weigh more in the leaf than in the corpus.
5. A document is a mixture of leaves: each of its sentences goes to the nearest leaf with its number of words. Its subjects are those
   that take up a third of the mixture of these leaves' subjects. Terms decide nothing but the leaf.

Defined results: null, empty and blank texts, and texts in which no known term occurs, get no
subject; several subjects are several rows; repeated documents get equal rows; labels of documents
that are not there, repeated labels and contradictory ones only shift counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import tokens
from tidemill.session import Scratch

#: Feature choice; share of the prose, with the tolerance of counting words.
PURE, LEAST_G, BURST, SHARE = 0.5, 11.0, 1.25, 1 / 3 - 0.01
#: Bisection: leaves, least spread of a leaf that is split, Lloyd steps and when they end, documents of which seeds are drawn, tries, documents of a seed.
LEAVES, SPREAD, STEPS, MOVED, SEEDS, TRIES, EACH = 256, 0.3, 5, 0.01, 4_000, 8, 6
#: A term's subject distribution is raised to this power: a label names a document, of which another subject may be a part.
SHARP = 3

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words in order: row and sentence. Of the terms (words, then the pairs within a sentence): hash and position (a pair stands at its first word)."""
    flat = tokens.Flat(column)
    start, end = flat.runs(tokens.LETTER | tokens.MARK)
    word, row = flat.hashes(start, end), flat.row_of(start)
    sentence = np.searchsorted(flat.sentence_ends(), start)
    new = np.append(True, (row[1:] != row[:-1]) | (sentence[1:] != sentence[:-1]))[: len(row)]
    both = np.nonzero(~new[1:])[0]
    with np.errstate(over="ignore"):
        x = word[both].view(np.uint64) * _K1 ^ (word[both + 1].view(np.uint64) + _K2) * _K2
        pair = (x ^ (x >> np.uint64(31))).view(np.int64)
    return row, np.cumsum(new) - 1, np.concatenate([word, pair]), np.concatenate([np.arange(len(word)), both]), np.nonzero(new)[0]


def labelled_terms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """term, subject, n, tf: documents with the term and the label, and the term's occurrences in them; a document with two labels counts half for each."""
    own = labels.filter("subject_id is not null").select(F.col("doc_id").alias("doc"), "subject_id").distinct()
    own = own.groupBy("doc").agg(F.sort_array(F.collect_set("subject_id")).alias("subjects"))
    rows = docs.join(own, "doc").select("text", "subjects")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.pieces(batches, "text"):
            row, _, term, at, _ = _terms(b["text"])
            sets = {}
            group = np.array([sets.setdefault(tuple(s), len(sets)) for s in b["subjects"].to_pylist()], int)
            known, code = np.unique(term, return_inverse=True)
            pair, count = np.unique(code * b.num_rows + row[at], return_counts=True)  # a term in a text
            key = (pair // b.num_rows) * len(sets) + group[pair % b.num_rows]
            slot, code = np.unique(key, return_inverse=True)
            n, tf = np.bincount(code, minlength=len(slot)), np.bincount(code, weights=count, minlength=len(slot))
            subjects = pa.array(list(sets), pa.list_(pa.string())).take(pa.array(slot % len(sets)))
            yield pa.RecordBatch.from_arrays([pa.array(known[slot // len(sets)]), subjects, pa.array(n.astype(float)), pa.array(tf)], ["term", "subjects", "n", "tf"])

    found = rows.mapInArrow(run, "term bigint, subjects array<string>, n double, tf double")
    each = F.size("subjects")
    found = found.select("term", F.explode("subjects").alias("subject"), (F.col("n") / each).alias("n"), (F.col("tf") / each).alias("tf"))
    return found.groupBy("term", "subject").agg(F.sum("n").alias("n"), F.sum("tf").alias("tf"))


def features(counts: DataFrame, prior: dict[str, float]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Sorted term hashes, their subject distributions, and the subjects' names.

    A term must nearly reach ``BURST`` in the labelled documents; it is counted over the whole corpus afterwards.
    """
    names = sorted(prior)
    if not names:
        return np.zeros(0, np.int64), np.zeros((0, 0)), names
    p = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(prior[k]))])
    total = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("tf").alias("tf"), F.sum(F.col("n") * F.log(F.col("n") / p[F.col("subject")])).alias("g"), F.max("n").alias("top"), F.map_from_entries(F.collect_list(F.struct("subject", "n"))).alias("by"))
    total = total.withColumn("g", 2 * (F.col("g") - F.col("n") * F.log("n")))
    kept = total.filter((F.col("g") >= LEAST_G) & (F.col("top") / (F.col("n") + 0.5) >= PURE) & (F.col("tf") >= (BURST - 0.1) * F.col("n")))
    rows = kept.select("term", "by").collect()
    rows.sort(key=lambda r: r["term"])
    dist = np.array([[r["by"].get(k, 0.0) + 0.3 * prior[k] for k in names] for r in rows]).reshape(len(rows), len(names))
    dist = (dist / dist.sum(1, keepdims=True)) ** SHARP
    return np.array([r["term"] for r in rows], np.int64), dist / dist.sum(1, keepdims=True), names


def sentences(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc, terms (in order of sentences), sizes (the terms of each sentence), lengths (its words); only sentences with a term."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.pieces(batches, "text"):
            row, sentence, term, at, first = _terms(b["text"])
            k = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
            hit = vocabulary[k] == term
            at, k = at[hit], k[hit].astype(np.int32)
            order = np.lexsort((k, at))
            at, k = at[order], k[order]
            ids, sizes = np.unique(sentence[at], return_counts=True)
            lengths = np.bincount(sentence, minlength=len(first))[ids] if len(ids) else ids
            per_row, of_row = np.bincount(row[first[ids]], minlength=b.num_rows), np.bincount(row[at], minlength=b.num_rows)
            out = pa.RecordBatch.from_arrays([b["doc"], tokens.lists(k, of_row), tokens.lists(sizes.astype(np.int32), per_row), tokens.lists(lengths.astype(np.int32), per_row)], ["doc", "terms", "sizes", "lengths"])
            yield out.filter(pa.array(of_row > 0))

    return docs.select("doc", "text").mapInArrow(run, f"doc {kind}, terms array<int>, sizes array<int>, lengths array<int>")


def _column(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after another, and how many each row has."""
    return b[name].flatten().to_numpy(zero_copy_only=False), np.diff(b[name].offsets.to_numpy())


def repeated_terms(rows: DataFrame, v: int) -> np.ndarray:
    """Which of the terms a document that has them repeats, over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tf, df = np.zeros(v), np.zeros(v)
        for b in batches:
            flat, n = _column(b, "terms")
            tf += np.bincount(flat, minlength=v)
            df += np.bincount(np.unique(np.repeat(np.arange(b.num_rows), n) * v + flat) % v, minlength=v)
        t = np.nonzero(df)[0].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(tf[t]), pa.array(df[t])], ["t", "tf", "df"])

    sums = rows.select("terms").mapInArrow(run, "t int, tf double, df double").groupBy("t").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).toArrow()
    keep = np.zeros(v, bool)
    keep[sums["t"].to_numpy()] = sums["tf"].to_numpy() / sums["df"].to_numpy() >= BURST
    return keep


def _vectors(flat: np.ndarray, row: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, terms and values of unit vectors of dampened counts."""
    key, count = np.unique(row.astype(np.int64) * v + flat, return_counts=True)
    r, x = key // v, np.sqrt(count)
    return r, key % v, x / np.sqrt(np.bincount(r, weights=x * x, minlength=n))[r]


def vectors(rows: DataFrame, keep: np.ndarray) -> DataFrame:
    """The rows with the kept terms alone, numbered anew, and with the document's vector: ``at``, ``x``."""
    to, v = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32), int(keep.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (flat, _), (sizes, many), (lengths, _) = (_column(b, c) for c in ("terms", "sizes", "lengths"))
            flat = to[flat]
            n = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[flat >= 0], minlength=len(sizes))
            row = np.repeat(np.arange(b.num_rows), many)
            some = n > 0
            per_row, of_row = np.bincount(row[some], minlength=b.num_rows), np.bincount(row, weights=n, minlength=b.num_rows).astype(int)
            flat = flat[flat >= 0]
            r, t, x = _vectors(flat, np.repeat(np.arange(b.num_rows), of_row), b.num_rows, v)
            own = np.bincount(r, minlength=b.num_rows)
            out = [b["doc"], tokens.lists(flat, of_row), tokens.lists(n[some].astype(np.int32), per_row), tokens.lists(lengths[some], per_row), tokens.lists(t.astype(np.int32), own), tokens.lists(x.astype(np.float32), own)]
            yield pa.RecordBatch.from_arrays(out, ["doc", "terms", "sizes", "lengths", "at", "x"]).filter(pa.array(of_row > 0))

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, terms array<int>, sizes array<int>, lengths array<int>, at array<int>, x array<float>")


class Tree:
    """Bisecting k-means. ``centres`` are those of the leaves; ``splits`` are the rounds' (leaf, new leaf, pair of centres)."""

    def __init__(self, rows: DataFrame, v: int):
        self.rows, self.v, self.spark = rows.select("at", "x"), v, rows.sparkSession
        seeds = rows.select("at", "x", F.xxhash64("at", "x").alias("h")).orderBy("h").limit(SEEDS).select("at", "x").toArrow().combine_chunks()
        self.sample = np.zeros((seeds.num_rows, v), np.float32)
        for k, (t, x) in enumerate(zip(seeds["at"].to_pylist(), seeds["x"].to_pylist())):
            self.sample[k, t] = x
        self.leaf = np.zeros(len(self.sample), int)
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.centres = np.zeros((1, v), np.float32)
        self.spread = np.ones(1)  # of a leaf, by the root of its size; 0 where it is no more split

    def grow(self) -> Tree:
        rng = np.random.default_rng(1)
        while True:
            n = len(self.centres)
            order = np.argsort(-self.spread, kind="stable")
            some = np.bincount(self.leaf, minlength=n)
            todo = np.array([k for k in order if self.spread[k] > 0 and some[k] >= 4][: min(LEAVES - n, n // 2 + 1)], int)
            if not len(todo):
                return self
            pairs = np.stack([_seeds(self.sample[self.leaf == k], rng) for k in todo])
            for _ in range(STEPS):
                sums, sizes = self._step(todo, pairs)
                norm = np.linalg.norm(sums, axis=2)
                new = np.where(norm[:, :, None] > 0, sums / np.maximum(norm, 1e-12)[:, :, None], pairs).astype(np.float32)
                moved = float((1 - (new * pairs).sum(2)).max())
                pairs, cohesion = new, norm / np.maximum(sizes, 1)
                if moved <= MOVED:
                    break
            spread = np.where(1 - cohesion**2 > SPREAD, (1 - cohesion**2) * np.sqrt(sizes), 0.0)
            at = n + np.arange(len(todo))
            self.splits.append((todo, at, pairs))
            self.centres, self.spread = np.concatenate([self.centres, pairs[:, 1]]), np.concatenate([self.spread, spread[:, 1]])
            self.centres[todo], self.spread[todo] = pairs[:, 0], spread[:, 0]
            for k, a, pair in zip(todo, at, pairs):
                mine = np.nonzero(self.leaf == k)[0]
                self.leaf[mine[self.sample[mine] @ (pair[1] - pair[0]) > 0]] = a

    def _step(self, todo: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and sizes of both halves of the leaves in ``todo``, over the whole corpus."""
        v, n = self.v, len(self.centres)
        shared = self.spark.sparkContext.broadcast([(a, b, p[:, 1] - p[:, 0]) for a, b, p in [*self.splits, (todo, n + np.arange(len(todo)), pairs)]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            splits = shared.value
            slot = np.full(n + len(todo), -1)
            slot[todo], slot[n:] = 2 * np.arange(len(todo)), 2 * np.arange(len(todo)) + 1
            total, sizes = np.zeros(2 * len(todo) * v), np.zeros(2 * len(todo))
            for b in batches:
                (t, per), x = _column(b, "at"), b["x"].flatten().to_numpy(zero_copy_only=False)
                to = slot[_descend(t, x, per, splits)]
                sizes += np.bincount(to[to >= 0], minlength=len(sizes))
                to = np.repeat(to, per)
                mine = to >= 0
                total += np.bincount(to[mine] * v + t[mine], weights=x[mine], minlength=len(total))
            at = np.nonzero(total)[0]
            half = np.nonzero(sizes)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, -1 - half])), pa.array(np.concatenate([total[at], sizes[half]]))], ["slot", "x"])

        got = self.rows.mapInArrow(run, "slot bigint, x double").groupBy("slot").agg(F.sum("x").alias("x")).toArrow()
        shared.unpersist()
        slot, x = got["slot"].to_numpy(), got["x"].to_numpy()
        sums, sizes = np.zeros(2 * len(todo) * v), np.zeros(2 * len(todo))
        sums[slot[slot >= 0]], sizes[-1 - slot[slot < 0]] = x[slot >= 0], x[slot < 0]
        return sums.reshape(len(todo), 2, v), sizes.reshape(len(todo), 2)


def _seeds(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The best of some pairs of centres, each begun with a few documents: so a group of like documents goes to one side as a whole."""
    best, found = -1.0, None
    each = max(1, min(EACH, len(x) // 2))
    unit = lambda c, old: c / n if (n := np.linalg.norm(c)) else old
    for _ in range(TRIES):
        p = rng.permutation(len(x))
        pair = np.stack([unit(x[p[:each]].sum(0), x[0]), unit(x[p[each : 2 * each]].sum(0), x[0])])
        for _ in range(6):
            side = x @ (pair[1] - pair[0]) > 0
            pair = np.stack([unit(x[~side].sum(0), pair[0]), unit(x[side].sum(0), pair[1])])
        near = float((x @ pair.T).max(1).sum())
        if near > best:
            best, found = near, pair
    return found


def _descend(t: np.ndarray, x: np.ndarray, per: np.ndarray, splits: list) -> np.ndarray:
    """The leaf of every vector."""
    leaf = np.zeros(len(per), int)
    row = np.repeat(np.arange(len(per)), per)
    for old, new, apart in splits:
        which = np.full(int(leaf.max(initial=0)) + 1, -1)
        inside = old < len(which)
        which[old[inside]] = np.nonzero(inside)[0]
        mine = which[leaf]
        on = mine[row]
        some = on >= 0
        side = np.bincount(row[some], weights=x[some] * apart[on[some], t[some]], minlength=len(per)) > 0
        leaf = np.where((mine >= 0) & side, new[np.maximum(mine, 0)], leaf)
    return leaf


def leaf_mixtures(centres: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """The subjects of the terms that weigh more in a leaf than in the corpus."""
    lift = np.maximum(0, centres - centres.mean(0)) if len(centres) > 1 else centres
    mix = (lift**2) @ dist
    total = mix.sum(1, keepdims=True)
    return np.where(total > 0, mix / np.where(total == 0, 1, total), 0)


class Subjects:
    def __init__(self, documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text"):
        self.scratch = Scratch(documents.sparkSession, "subjects")
        docs = documents.filter(documents[text].isNotNull()).select(documents[key].alias("doc"), documents[text].alias("text"))
        prior = {r["subject_id"]: r["n"] for r in labels.filter("subject_id is not null").groupBy("subject_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(prior.values())
        self.vocabulary, self.dist, self.names = features(labelled_terms(docs, labels), {k: n / total for k, n in prior.items()})
        self.key, self.kind, self.rows = key, documents.schema[key].dataType.simpleString(), None
        if not len(self.vocabulary):
            return
        first = self.scratch.keep(sentences(docs, self.vocabulary))
        keep = repeated_terms(first, len(self.vocabulary))
        if not keep.any():
            keep[:] = True
        self.dist = self.dist[keep]
        self.rows = self.scratch.keep(vectors(first, keep))
        self.scratch.drop(first)
        self.centres = Tree(self.rows, len(self.dist)).grow().centres
        self.mixtures = leaf_mixtures(self.centres, self.dist)

    def shares(self) -> DataFrame:
        """key, subject_id, share of every subject that takes part in a document."""
        kinds = f"`{self.key}` {self.kind}, subject_id string, share double"
        spark = self.scratch.spark
        if self.rows is None:
            return spark.createDataFrame([], kinds)
        names, key, v = self.names, self.key, len(self.dist)
        shared = spark.sparkContext.broadcast((np.ascontiguousarray(self.centres.T), self.mixtures))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, mixtures = shared.value
            for whole in batches:
                for lo in range(0, whole.num_rows, 1_000):
                    b = whole.slice(lo, 1_000)
                    (flat, _), (sizes, many), (lengths, _) = (_column(b, c) for c in ("terms", "sizes", "lengths"))
                    n = len(sizes)
                    r, t, x = _vectors(flat, np.repeat(np.arange(n), sizes), n, v)
                    near = np.add.reduceat(centres[t] * x.astype(np.float32)[:, None], np.searchsorted(r, np.arange(n)), axis=0)
                    mix = mixtures[near.argmax(1)] * lengths[:, None]
                    total = np.zeros((b.num_rows, len(names)))
                    np.add.at(total, np.repeat(np.arange(b.num_rows), many), mix)
                    share = total / np.maximum(total.sum(1, keepdims=True), 1e-9)
                    i, s = np.nonzero(share > 0.01)
                    yield pa.RecordBatch.from_arrays([b["doc"].take(pa.array(i)), pa.array([names[k] for k in s], pa.string()), pa.array(share[i, s])], [key, "subject_id", "share"])

        return self.rows.select("doc", "terms", "sizes", "lengths").mapInArrow(run, kinds)

    def found(self) -> DataFrame:
        return self.shares().filter(F.col("share") >= SHARE).select(self.key, "subject_id").distinct()
