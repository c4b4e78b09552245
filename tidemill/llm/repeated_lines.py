"""Lines repeated across one site's documents (problem 1).

The lines of a document become identifiers (a 64-bit hash of their letters in lower case). The
suffix array of a source is made over its documents' identifier sequences, and multi-line blocks
are the common prefixes of neighbouring suffixes. Three steps keep it distributed:

1. First symbol. Suffixes are bucketed by (source, first identifier) with a combining count of
   documents. A block starts with a line that by itself spans enough documents, so buckets below
   the threshold can hold no block and end here; this is also where a sequence is cut.
2. Suffixes. Every document gives the different suffixes of its remaining runs in sorted order, each with its first ``DEPTH``
   lines, so that their size is linear in the document's. For two
   neighbours in this order their common prefix goes out with weight -1, so that the weights of all
   suffixes below a prefix add up to documents, not to occurrences. Equal suffixes of a source are
   added up before the sort, so copies never meet in one task.
3. Array. The suffixes are range-partitioned by (source, suffix) and sorted. Each task walks its
   part with a stack of open common-prefix intervals and gives (source, block, documents). A block
   may be open at the edge of a part; those of different parts are added up by a last aggregation.

A line is deleted if a block that spans enough documents covers it.

Defined results: null and empty texts give no line; lines without a letter are never blocks and do
not interrupt one; a repeated row counts as a further article; a null source is a source of its
own; the text keeps its other lines and their line ends byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import tokens
from tidemill.session import Scratch

#: A line stands in at least so many articles of its source, and in at least this share of them.
MIN_ARTICLES, MIN_SHARE = 3, 0.02
#: Lines of a suffix. A longer passage appears as its overlapping blocks of so many lines, so every line of it is still covered.
DEPTH = 64


def with_line_ids(docs: DataFrame, text: str, name: str = "ids") -> DataFrame:
    """The rows with the identifiers of the text's lines in order: a hash of their letters in lower case, null for a line without letters."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.pieces(batches, text):
            ids, some, per = tokens.line_hashes(b[text])
            null = b[text].is_null().to_numpy(zero_copy_only=False)
            keep = ~np.repeat(null, per)
            offsets = np.append(0, np.cumsum(np.where(null, 0, per))).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids[keep], mask=~some[keep]), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, name])

    return docs.mapInArrow(run, f"{kinds}, `{name}` array<bigint>")


def by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on ``source`` so that null meets null; the right side's own column goes."""
    r = right.withColumnRenamed("source", "__source")
    out = left.join(r, left["source"].eqNullSafe(r["__source"]), how)
    return out.drop("__source")


def needed(docs: DataFrame, source: str) -> DataFrame:
    """The least number of articles for each source."""
    n = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", F.greatest(F.lit(MIN_ARTICLES), F.ceil(F.round(F.col("n") * MIN_SHARE, 6))).cast("bigint").alias("least"))


def _first_symbols(lines: DataFrame, least: DataFrame) -> DataFrame:
    once = lines.select("source", F.explode(F.array_distinct(F.filter("ids", lambda x: x.isNotNull()))).alias("id"))
    counted = once.groupBy("source", "id").agg(F.count(F.lit(1)).alias("n")).filter(f"n >= {MIN_ARTICLES}")
    kept = by_source(counted, least).filter("n >= least")
    # One row a source: of its lines, each in at least MIN_SHARE of the articles, there are at most lines-per-article / MIN_SHARE.
    return kept.groupBy("source", "least").agg(F.collect_set("id").alias("first"))


def _common(a: tuple, b: tuple) -> int:
    k, n = 0, min(len(a), len(b))
    while k < n and a[k] == b[k]:
        k += 1
    return k


def _suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for source, least, seq, n in zip(b["source"], b["least"], b["seq"], b["n"]):
            ids = list(seq)
            cut = [-1, *(i for i, x in enumerate(ids) if x == 0), len(ids)]
            # Equal suffixes of a document count once, so a line repeated over and over leaves no more than DEPTH of them.
            own = sorted({tuple(ids[i : min(j, i + DEPTH)]) for start, j in zip(cut, cut[1:]) for i in range(start + 1, j)})
            before: tuple = ()
            for s in own:
                rows.append((source, least, s, n))
                if k := _common(before, s):
                    rows.append((source, least, s[:k], -n))
                before = s
        if rows:
            yield pd.DataFrame({"source": [r[0] for r in rows], "least": [r[1] for r in rows], "suffix": [list(r[2]) for r in rows], "weight": [r[3] for r in rows]})


class _Intervals:
    """Walks sorted suffixes with a stack of open intervals [depth, weight]; one closes when the common prefix gets shorter."""

    def __init__(self) -> None:
        self.out: list[tuple] = []
        self.stack: list[list] = []
        self.before: tuple = ()
        self.edge: tuple | None = None  # the part's first suffix; its prefixes may go on in the part before
        self.at: tuple | None = None
        self.first_at: tuple | None = None

    def close(self, to: int, last: bool = False) -> None:
        while self.stack and self.stack[-1][0] > to:
            depth, weight = self.stack.pop()
            below = max(self.stack[-1][0] if self.stack else 0, to)
            # An interval gives its longest block, which covers the shorter ones' lines; one at the edge of the part may be shorter in the next.
            for d in range(below + 1, depth + 1):
                if last or (self.at == self.first_at and self.before[:d] == self.edge[:d]) or (d == depth and weight >= self.at[1]):
                    self.out.append((*self.at, self.before[:d], weight))
            if self.stack and self.stack[-1][0] == below:
                self.stack[-1][1] += weight
            elif below:
                self.stack.append([below, weight])

    def add(self, source: object, least: int, s: tuple, weight: int) -> None:
        if (source, least) != self.at:
            self.close(0)
            self.at, self.before = (source, least), ()
            if self.edge is None:
                self.edge, self.first_at = s, self.at
        k = _common(self.before, s)
        self.close(k)
        if self.stack and self.stack[-1][0] == len(s):
            self.stack[-1][1] += weight
        else:
            self.stack.append([len(s), weight])
        self.before = s

    def take(self) -> pd.DataFrame:
        rows, self.out = self.out, []
        return pd.DataFrame({"source": [r[0] for r in rows], "least": [r[1] for r in rows], "block": [list(r[2]) for r in rows], "weight": [r[3] for r in rows]}, columns=["source", "least", "block", "weight"])


def _intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    walk = _Intervals()
    for b in batches:
        for source, least, s, weight in zip(b["source"], b["least"], b["suffix"], b["weight"]):
            walk.add(source, least, tuple(s), weight)
        if walk.out:
            yield walk.take()
    if walk.at:
        walk.close(0, last=True)
        if walk.out:
            yield walk.take()


class RepeatedLines:
    """The blocks and lines that the documents of a source repeat; reads the texts once."""

    def __init__(self, docs: DataFrame, doc: str = "article_id", source: str = "source_id", text: str = "content_text", keep: tuple[str, ...] = ()):
        self.scratch = scratch = Scratch(docs.sparkSession, "repeated-lines")
        self.docs, self.doc, self.source, self.text = docs, doc, source, text
        self.kind = docs.schema[source].dataType.simpleString()
        named = docs.filter(docs[text].isNotNull()).select(F.col(doc).alias("doc"), F.col(source).alias("source"), F.col(text).alias("__text"), *(k for k in keep if k != text))
        named = with_line_ids(named, "__text")
        lines = scratch.keep(named.withColumnRenamed("__text", text) if text in keep else named.drop("__text"))
        first = _first_symbols(lines, needed(docs, source))
        marked = by_source(lines, first).select(
            "doc", "source", "least", F.transform("ids", lambda x: F.when(x.isNull(), None).when(F.array_contains("first", F.coalesce(x, F.lit(0))), x).otherwise(F.lit(0))).alias("hit")
        )
        self.marked = scratch.keep(marked.filter(F.exists("hit", lambda x: x != 0)))
        self.rows = lines
        if not keep:
            scratch.drop(lines)
        self.blocks = scratch.keep(self._blocks())

    def _blocks(self) -> DataFrame:
        # 0 is a line of no block; one of several in a row is enough to end a run.
        seq = self.marked.select("source", "least", F.filter("hit", lambda x: x.isNotNull()).alias("s")).select("source", "least", F.filter("s", lambda x, i: (x != 0) | ((i > 0) & (F.get("s", i - 1) != 0))).alias("seq"))
        seq = seq.groupBy("source", "least", "seq").agg(F.count(F.lit(1)).alias("n"))
        suffix = seq.mapInPandas(_suffixes, f"source {self.kind}, least bigint, suffix array<bigint>, weight bigint")
        suffix = suffix.groupBy("source", "least", "suffix").agg(F.sum("weight").alias("weight"))
        array = suffix.repartitionByRange("source", "suffix").sortWithinPartitions("source", "suffix")
        found = array.mapInPandas(_intervals, f"source {self.kind}, least bigint, block array<bigint>, weight bigint")
        return found.groupBy("source", "least", "block").agg(F.sum("weight").alias("articles")).filter("articles >= least").select("source", "block", "articles")

    def covered(self) -> DataFrame:
        """source, ids: the identifiers of all lines that a block covers; every line of a block is itself one."""
        return self.blocks.select("source", F.explode("block").alias("id")).groupBy("source").agg(F.collect_set("id").alias("covered"))

    def lines(self) -> DataFrame:
        """doc, line_no of every covered line, numbered from 1."""
        hit = by_source(self.marked, self.covered()).select("doc", F.posexplode("hit").alias("i", "id"), "covered")
        return hit.filter("id != 0 and array_contains(covered, id)").select("doc", (F.col("i") + 1).cast("int").alias("line_no"))

    def report(self) -> DataFrame:
        """Blocks of two and more lines that no longer block with as many articles extends to the right."""
        longer = self.blocks.select(F.col("source").alias("__s"), F.expr("slice(block, 1, size(block) - 1)").alias("__b"), F.col("articles").alias("__a"))
        b = self.blocks.filter("size(block) >= 2")
        maximal = b.join(longer, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")) & (F.col("articles") == F.col("__a")), "left_anti")
        return maximal.select(F.col("source").alias(self.source), F.transform("block", lambda x: F.hex(x)).alias("block_ids"), F.size("block").alias("block_lines"), "articles")

    def cleaned(self) -> DataFrame:
        """Every document without its covered lines, with their number; the other lines stay byte by byte."""
        mine = [f"`{x}`" for x in self.docs.columns if x != self.text]
        docs = with_line_ids(self.docs, self.text, "__ids")
        c = self.covered().withColumnRenamed("source", "__source").withColumnRenamed("covered", "__covered")
        left = docs.join(c, docs[self.source].eqNullSafe(c["__source"]), "left")
        lines = F.split(F.col(f"`{self.text}`"), "\n", -1)
        keep = F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains("__covered", F.get("__ids", i)), F.lit(False)))
        rest = F.when(F.col("__covered").isNull(), F.col(f"`{self.text}`")).otherwise(F.array_join(keep, "\n"))
        removed = F.when(F.col("__covered").isNull() | F.col(f"`{self.text}`").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(keep))
        return left.select(*mine, rest.alias(self.text), removed.alias("lines_removed"))
