"""Template residue, filler and error pages instead of an article (problem 7).

A regularised linear classifier over whole texts. Features: hashed word and punctuation n-grams
(one and two long), lengths, and how much of the title occurs in the text. It is trained on weak
labels: phrases of residue at a line's start, a placeholder, or a bad response status, in a text that has no line
of prose; and texts with lines of prose and none of the phrases. Texts that are neither are not
used for training. Hosts (of the article's address) whose hash falls into the held-out share take no part in the training
either; ``validation`` gives the agreement on all their labelled texts, those without any phrase apart.

The training rows are a bounded sample: the ``SAMPLE`` texts with the smallest hashes of the key, as far as
they get a label, and no more than ``TRAIN_ROWS`` of either; every text is scored.

Defined results: null, empty and blank texts hold no article and are cases; an article without a
title counts as sharing no word with it; repeated rows get equal scores. If a label has no rows
at all, the weak labels themselves decide.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import tokens
from tidemill.session import Scratch

#: Texts that are looked at for weak labels, rows of each that the model is fitted on, features, and the share of hosts held out, in percent.
SAMPLE, TRAIN_ROWS, WIDTH, HELD_OUT = 8_000, 3_000, 1 << 15, 20
#: Share of residue that the fit supposes, whatever the sample's; the probability from which a text is a case.
PRIOR, CASE = 0.05, 0.45

# Beginnings of lines that a page without its article shows.
PHRASES = (
    r"(error|http|status|page missing|server error)\W{0,3}\(?[45]\d\d\b", r"[45]\d\d (not found|bad gateway|service unavailable|internal server error|gateway time-?out|forbidden|unauthorized|too many requests)",
    r"(page|seite|story|article|document) (not found|nicht gefunden|is no longer available|introuvable)", r"(this|the) (story|page|article|site|content) (is no longer|is not|could not|cannot|needs scripts)",
    r"página no(t| )? ?(encontrada|found)", r"página não encontrada", r"page introuvable", r"страница не найдена", r"(access denied|forbidden|unauthorized)$", r"you have been blocked", r"are you a robot", r"checking your browser",
    r"(please )?(enable|turn on|switch on|activate) (javascript|scripts|cookies)", r"you need to (enable|switch on|turn on)", r"javascript is (disabled|required)", r"activez javascript", r"(bitte )?aktivieren sie javascript", r"(active|ative|activa) (el )?javascript",
    r"loading\W", r"your session has (ended|expired)", r"(fatal error|warning|notice|parse error): ", r"traceback \(most recent call last\)", r"[a-z]*(error|exception): ", r"undefined undefined|nan undefined|\[object object\]",
    r"this is a test (article|post|story)", r"(headline|title|body|intro|text)( \p{L}+){0,6} (goes here|to come)", r"tk tk\b", r"(\{\{|\{%|<%|\$\{|%%|@@|\[\[|__)",
)
# The first five letters of filler words.
FILLER = frozenset(("lorem", "ipsum", "dolor", "conse", "adipi", "eiusm", "tempo", "incid", "labor", "magna", "aliqu", "minim", "venia", "nostr", "exerc", "ullam", "commo", "irure", "velit", "cillu", "fugia", "nulla", "paria", "excep", "occae", "cupid", "culpa", "offic", "molli", "sedro", "sinte", "elitu", "quist"))
_MARK = re.compile(r"[{}<$%@\[_][{}%@\[_!]")
_BEGINS = re.compile("^(?:" + "|".join(p.replace(r"\p{L}", r"[^\W\d_]") for p in PHRASES) + ")")

_WORD = re.compile(r"[^\W\d_]{4,}")
_VISIBLE = tokens.PUNCT | tokens.END | tokens.CLOSE


class Tokens:
    """The words and runs of punctuation of texts: hash, text, line (of all texts' lines), whether a word, whether a filler word."""

    def __init__(self, column: pa.Array, flat: tokens.Flat | None = None):
        self.flat = flat = flat or tokens.Flat(column)
        start, end, kind = flat.split({tokens.LETTER | tokens.MARK: 1, _VISIBLE: 2})
        self.codes, self.row, self.word = flat.hashes(start, end), flat.row_of(start), kind == 1
        self.start, self.end = start, end
        five = np.nonzero(self.word & (end - start >= 5))[0]
        head = flat.hashes(start[five], start[five] + 5)
        at = np.minimum(np.searchsorted(_filler(), head), len(_filler()) - 1)
        self.filler = np.zeros(len(start), bool)
        self.filler[five] = _filler()[at] == head
        self.per_text = np.bincount(self.row, minlength=flat.rows)

    def line_sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters of every line of the texts, and the text it belongs to."""
        breaks = np.nonzero(self.flat.classes == tokens.LINE)[0]
        start = np.sort(np.concatenate([breaks + 1, self.flat.bounds[:-1]]), kind="stable")
        stop = np.sort(np.concatenate([breaks, self.flat.bounds[1:]]), kind="stable")
        per = np.diff(np.searchsorted(breaks, self.flat.bounds)) + 1
        return stop - start, np.repeat(np.arange(self.flat.rows), per)


@functools.lru_cache(maxsize=1)
def _filler() -> np.ndarray:
    flat = tokens.Flat(pa.array(sorted(FILLER)))
    return np.sort(flat.hashes(flat.bounds[:-1], flat.bounds[1:]))


def features(texts: Tokens, titles: list[str | None], status: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed n-gram slots of every row; their numbers; the plain features."""
    n, row = texts.per_text, texts.row
    rows = len(n)
    sizes, of = texts.line_sizes()
    longest = np.zeros(rows)
    np.maximum.at(longest, of, sizes)
    filler = np.bincount(row, weights=texts.filler, minlength=rows) / np.maximum(n, 1)
    prose = np.minimum(1.0, np.bincount(of, weights=sizes >= 90, minlength=rows) / 4)
    shared = np.zeros(rows)
    for i, (title, low) in enumerate(zip(titles, texts.flat.texts())):
        words = set(_WORD.findall((title or "").lower()))
        if words:
            shared[i] = sum(w in low for w in words) / len(words)
    bad = np.array([(code or 0) >= 400 for code in status], float)
    plain = np.stack([np.log1p(n) / 8, np.log1p(longest) / 8, np.where(filler > 0.3, 0, prose), filler, shared, bad], 1)
    h = texts.codes.view(np.uint64)
    both = row[:-1] == row[1:]
    with np.errstate(over="ignore"):
        pair = tokens.mix(h[:-1][both] * np.uint64(3) + h[1:][both])
    # In order of rows: the single tokens, then the pairs with the row they begin in.
    slot = (np.concatenate([h, pair]) % np.uint64(WIDTH)).astype(np.int64)
    order = np.argsort(np.concatenate([row, row[:-1][both]]), kind="stable")
    return slot[order], n + np.bincount(row[:-1][both], minlength=rows), plain


def weak_label(text: str | None, status: int | None) -> tuple[float | None, bool]:
    """1 for residue or a bad status without a line of prose, 0 for prose without residue, else None; None for blank texts.
    With it, whether a phrase, placeholder or filler line was there."""
    hit = prose = False
    for line in (text or "").lower().splitlines():
        words = line.split()
        if words:
            line = " ".join(words)
            filler = sum(w[:5] in FILLER for w in words)
            mark = bool(_MARK.search(line))
            phrase = bool(_BEGINS.match(line))
            hit |= phrase or mark or filler * 2 > len(words)
            prose |= len(words) >= 10 and not phrase and filler * 3 < len(words) and not mark
    if not text or text.isspace():
        return None, hit
    return (1.0 if not prose and (hit or (status or 0) >= 400) else 0.0 if prose and not hit else None), hit


def weak_labels(docs: DataFrame) -> DataFrame:
    """The rows, of which ``docs`` has doc, host, text, title, status, with their label and whether they have a phrase."""
    kind = docs.schema["doc"].dataType.simpleString()
    names = ["doc", "host", "text", "title", "status"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weak = [weak_label(t, s) for t, s in zip(b["text"].to_pylist(), b["status"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array([x for x, _ in weak], pa.float64()), pa.array([h for _, h in weak], pa.bool_())], [*names, "label", "phrase"])

    return docs.select(*names).mapInArrow(run, f"doc {kind}, host string, text string, title string, status int, label double, phrase boolean")


def _unseen(host: str = "host") -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(host), F.lit(""))), F.lit(100)) < HELD_OUT


def _margins(flat: np.ndarray, sizes: np.ndarray, plain: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of rows given as their n-gram slots one after another; a row's n-grams have unit length."""
    total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=w[flat], minlength=len(sizes))
    return total / np.sqrt(np.maximum(sizes, 1)) + plain @ w[WIDTH:-1] + w[-1]


def fit(flat: np.ndarray, sizes: np.ndarray, plain: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Logistic regression with an L2 penalty by accelerated gradient steps."""
    row, scale = np.repeat(np.arange(len(sizes)), sizes), 1 / np.sqrt(np.maximum(sizes, 1))
    weight = np.where(y == 1, PRIOR / max(1, (y == 1).sum()), (1 - PRIOR) / max(1, (y == 0).sum()))
    w = np.zeros(WIDTH + plain.shape[1] + 1)
    v, before = w.copy(), w.copy()
    rate = 1.0
    for k in range(steps):
        g = weight * (1 / (1 + np.exp(-np.clip(_margins(flat, sizes, plain, v), -30, 30))) - y)
        grad = np.concatenate([np.bincount(flat, weights=(g * scale)[row], minlength=WIDTH), plain.T @ g, [g.sum()]])
        grad[:-1] += ridge * v[:-1]
        w = v - rate * grad
        v = w + k / (k + 3) * (w - before)
        before = w
    return w


def probability(texts: Tokens, titles: list[str | None], status: list[int | None], w: np.ndarray) -> np.ndarray:
    """That the texts are residue; 1 for blank ones."""
    p = 1 / (1 + np.exp(-np.clip(_margins(*features(texts, titles, status), w), -30, 30)))
    seen = np.append(0, np.cumsum((texts.flat.classes & (tokens.SPACE | tokens.LINE)) == 0))
    return np.where(seen[texts.flat.bounds[1:]] == seen[texts.flat.bounds[:-1]], 1.0, p)


class Residue:
    """The sample and its labels, the fit, and the scores of all rows, for which the texts are read once."""

    def __init__(self, texts: DataFrame, articles: DataFrame):
        self.scratch = Scratch(texts.sparkSession, "residue")
        self.inputs = inputs(texts, articles)
        # The sample's keys are few, so that its texts are found without moving the others.
        keys = F.broadcast(texts.select("article_id", F.xxhash64("article_id").alias("h")).orderBy("h", "article_id").limit(SAMPLE).select("article_id").distinct())
        few = inputs(texts.join(keys, "article_id", "left_semi"), articles.join(keys, "article_id", "left_semi"))
        self.sample = self.scratch.keep(weak_labels(few).filter("label is not null"))
        self.weights = self._train()
        self.scratch.drop(self.sample)

    def _train(self) -> np.ndarray | None:
        seen = self.sample.filter(~_unseen()).withColumn("h", F.xxhash64("doc"))
        of = lambda v: seen.filter(F.col("label") == v).orderBy("h", "doc").limit(TRAIN_ROWS).select("label", "text", "title", "status")
        rows = of(1.0).union(of(0.0)).toArrow()
        y = rows["label"].to_numpy()
        if len(set(y)) < 2:
            return None
        # Piece by piece, as the driver has little memory.
        parts = [features(Tokens(b["text"]), b["title"].to_pylist(), b["status"].to_pylist()) for b in tokens.pieces(iter(rows.combine_chunks().to_batches()), "text")]
        return fit(np.concatenate([p[0].astype(np.int32) for p in parts]), *(np.concatenate([p[k] for p in parts]) for k in (1, 2)), y)

    def scored(self) -> DataFrame:
        """doc, host, residue (0 to 1) of every row."""
        own, w = self.inputs, self.weights
        if w is None:
            weak = weak_labels(self.inputs).select("doc", "label").distinct()
            blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\s\u00a0]")
            return own.join(weak, "doc", "left").select("doc", "host", F.when(blank, 1.0).otherwise(F.coalesce("label", F.lit(0.0))).alias("residue"))

        return self._score(own, "doc", "host")

    def _score(self, rows: DataFrame, *keep: str) -> DataFrame:
        """The ``keep`` columns of the rows, and residue by the fitted model."""
        w = self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in tokens.pieces(batches, "text"):
                p = probability(Tokens(b["text"]), b["title"].to_pylist(), b["status"].to_pylist(), w)
                yield pa.RecordBatch.from_arrays([*(b[k] for k in keep), pa.array(p)], [*keep, "residue"])

        kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
        return rows.select(*keep, "text", "title", "status").mapInArrow(run, f"{kinds}, residue double")

    def cases(self) -> DataFrame:
        """doc of every text that holds no article."""
        return self.scored().filter(F.col("residue") > CASE).select("doc").distinct()

    def validation(self) -> DataFrame:
        """All rows with a weak label on the hosts the training never saw, those with and without a phrase apart,
        how many of them the model calls residue, and how many agree with the label."""
        known = weak_labels(self.inputs.filter(_unseen())).filter("label is not null")
        scored = known.withColumn("residue", F.col("label")) if self.weights is None else self._score(known, "label", "phrase")
        case = F.col("residue") > CASE
        sums = F.count(F.lit(1)).alias("texts"), F.sum(case.cast("int")).alias("cases"), F.sum((case == (F.col("label") == 1.0)).cast("int")).alias("agreed")
        return scored.groupBy(F.col("label").cast("int").alias("label"), F.col("phrase").cast("int").alias("phrase")).agg(*sums)


def titles(articles: DataFrame) -> DataFrame:
    """article_id, title, status, host: those of an article's first row."""
    url = F.col("url") if "url" in articles.columns else F.lit(None).cast("string")
    first = articles.filter("article_id is not null").groupBy("article_id").agg(F.min_by(F.struct("headline", "collection_json", url.alias("url")), "ingest_seq").alias("a"))
    host = F.lower(F.regexp_extract("a.url", r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return first.select("article_id", F.col("a.headline").alias("title"), F.get_json_object("a.collection_json", "$.http_status").try_cast("int").alias("status"), host.alias("host"))


def inputs(texts: DataFrame, articles: DataFrame) -> DataFrame:
    """doc, host, text, title, status."""
    t = texts.select("article_id", F.col("content_text").alias("text"))
    return t.join(titles(articles).hint("shuffle_hash"), "article_id", "left").withColumnRenamed("article_id", "doc")
