"""New batches against all accepted history (problem 2).

A row repeats an accepted one if it is the same page (``address``), the same entry of the same feed,
or if its own prose is the same but for a tenth of its words. Rows count in order of ingest_seq, batches in order of arrival.

Content-defined chunking: a word's hash ends a chunk, on average every ``CHUNK`` words and after ``LONGEST`` at the latest, so
that an edit changes only the chunks around it. The persistent chunk table (chunk, text, bytes) gives the bytes that two
texts share; of a pair that covers ``COVER`` of the larger text's bytes the word sequences are compared, and ``SAME`` of them equal in
order make a repetition.

History: keys of accepted rows, chunks and words of accepted texts, one folder a batch, each divided into ``BUCKETS`` by key, chunk
and text. A batch counts once its marker is written; what a lost run left behind is written anew. Opening a
path finds the batches that are there. A new batch reads of each table only the buckets it touches, and of
these only what its own chunks and keys meet; the words of an old text are read only if a pair with it is to be compared.

Exact for every pair above ``COVER``: bytes in chunks of more than ``HOT`` texts are hot. A text of which no more than ``CROWDED`` is hot
shares at least ``COVER - CROWDED`` with the other in chunks that aren't. Of two texts that are crowded both keep the rarest of
their hot chunks, all but ``CROWDED`` of their bytes of the most frequent ones, and so meet in one of these.

Hot groups: equal texts are one text. Chunks with up to ``DIRECT`` crowded texts pair them like chunks that aren't hot. For larger
ones the links found so far are decided first; only crowded texts with an accepted row then meet in them. A chunk pairs each of them with the earliest accepted one only; those that match are
out, and the rest meets the next 32, 1,024 ... until all have met. Copies of one text match its first and are out after
the first round, so no step emits all pairs of a group. Then all is decided again: texts that have an accepted row though
they were out (their leader turned out to be a repetition) meet the other accepted ones anew, until no text is left that has an
accepted row and hasn't met all others that have one. At last repetitions meet the accepted texts before their kept row.

The order of decisions is kept by rounds: a row is accepted once no undecided earlier row could be
its original, and is a repetition as soon as an accepted earlier one is. The kept row is the earliest.

Defined results: words are runs of letters or digits, of which 63 characters count at most; null addresses, guids and texts take no part; empty own prose and texts that hold no
article (problem 7) never make a repetition; equal guids of different feeds don't either; a repeated
ingest_seq is one row. The residue model and the repeated lines are those of the texts given to ``own_words``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm import boilerplate, repeated_lines, residue, tokens
from tidemill.session import Scratch

#: A word of so many ends a chunk; the most words of a chunk; share of its bytes that two texts must have in common to be compared; texts from which a chunk is
#: hot; share of hot bytes from which a text is crowded; least share of equal words in order.
CHUNK, LONGEST, COVER, HOT, CROWDED, SAME = 5, 8, 0.35, 32, 0.3, 0.87
#: Crowded texts of a chunk up to which all of them meet; more than these meet by leaders.
DIRECT = 256
#: Parts of every table of the history, of which a batch reads those that its keys, chunks and texts fall into.
BUCKETS = 16

# Parameters that say where a reader came from, not what page it is; beginnings of hosts that serve the same pages.
TRACKING = r"^(utm_.*|gclid|fbclid|dclid|msclkid|yclid|mc_cid|mc_eid|cmp|cmpid|ref|referrer|source|at_.*|xtor|output=amp|amp(=.*)?|share|igshid|_ga|ns_.*|wt\..*|ito|smid|ocid|partner)(=.*)?$"
HOSTS = r"^(www\d?|m|mobile|amp)\."


def address(url: Column) -> Column:
    """One spelling of a page's address: no scheme, host variant, default port, fragment, tracking, amp, or closing slash; sorted parameters."""
    u = F.trim(F.regexp_replace(F.trim(url), "#.*$", ""))
    for code in "-._~":
        u = F.regexp_replace(u, f"(?i)%{ord(code):02x}", code)
    u = F.regexp_replace(u, r"^(?i)[a-z][a-z0-9+.\-]*://", "")
    rest = F.regexp_extract(u, r"^[^/?]*(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r":(80|443)$", ""), HOSTS, "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", ""), r"(/amp|/index\.html?)$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "[&;]"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(F.lit("")))


def _key(kind: str, *parts: Column) -> Column:
    return F.when(F.concat(*parts).isNotNull(), F.xxhash64(F.lit(kind), *parts))


_OWN = "text bigint, words array<bigint>, n int, chunks array<bigint>, sizes array<int>, total bigint"


def own_words(texts: DataFrame, articles: DataFrame, part: Column | None = None) -> DataFrame:
    """doc, text (a hash of its words), words (hashes in order), n, chunks, sizes, total of the own prose of every text that
    holds an article, and parts: the values of ``part`` (few) that the article's rows have."""
    lines = repeated_lines.RepeatedLines(texts, keep=("content_text",))
    parts = articles.filter("article_id is not null").groupBy("article_id").agg(F.collect_set(F.lit(0) if part is None else part).alias("parts"))
    rows, weights = boilerplate.scored(boilerplate.flagged(texts, lines=lines), residue.Residue(texts, articles), articles, parts)
    kind = texts.schema["article_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.pieces(batches, "content_text"):
            yield _own_words(b, weights)

    own = rows.select("article_id", "content_text", "hot", "title", "status", "parts").mapInArrow(run, f"doc {kind}, {_OWN}, parts array<int>")
    own = Scratch(texts.sparkSession, "own-words").keep(own)
    lines.scratch.drop(lines.rows, lines.marked, lines.blocks)
    return own


def _own_words(b: pa.RecordBatch, weights: np.ndarray | None) -> pa.RecordBatch:
    text, flat = b["content_text"], tokens.Flat(b["content_text"])
    case = np.zeros(b.num_rows, bool) if weights is None else residue.probability(residue.Tokens(text, flat), b["title"].to_pylist(), b["status"].to_pylist(), weights) > residue.CASE
    lines = [t.split("\n") for t in text.to_pylist()]
    own = np.array([o == 1 and not skip for own_of, skip in zip(map(boilerplate.own_lines, lines, b["hot"].to_pylist()), case.tolist()) for o in own_of], bool)
    start, end = flat.runs(tokens.LETTER | tokens.MARK | tokens.DIGIT)
    row = flat.row_of(start)
    keep = own[np.searchsorted(np.nonzero(flat.classes == tokens.LINE)[0], start) + row]  # lines before it: the breaks, and one a text
    start, end, row = start[keep], end[keep], row[keep]
    per = np.bincount(row, minlength=b.num_rows)
    out = chunked(b["article_id"], flat.hashes(start, end), np.minimum(end - start, 63), per, "doc")
    return out.append_column("parts", b["parts"].filter(pa.array(per > 0)))


def chunked(ids: pa.Array, words: np.ndarray, length: np.ndarray, per: np.ndarray, name: str) -> pa.RecordBatch:
    """``name`` and the columns of ``_OWN``, of texts given as their words one after another and their numbers of words; those without words are left out."""
    row = np.repeat(np.arange(len(per)), per)
    with np.errstate(over="ignore"):
        at = np.arange(len(words)) - np.repeat(np.cumsum(per) - per, per)
        x = tokens.mix(words.view(np.uint64) + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        text = np.zeros(len(per), np.uint64)
        np.add.at(text, row, x)
        text = tokens.mix(text)
    h, size, r = _cut(words, length, row)
    order = np.lexsort((h, r))
    h, size, r = h[order], size[order], r[order]
    new = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))[: len(h)]
    h, size, r = h[new], size[new], r[new]
    many = np.bincount(r, minlength=len(per))
    total = np.bincount(r, weights=size, minlength=len(per)).astype(np.int64)
    out = [ids, pa.array(text.view(np.int64)), tokens.lists(words, per), pa.array(per.astype(np.int32)), tokens.lists(h, many), tokens.lists(size.astype(np.int32), many), pa.array(total)]
    return pa.RecordBatch.from_arrays(out, [name, "text", "words", "n", "chunks", "sizes", "total"]).filter(pa.array(per > 0))


def _cut(words: np.ndarray, size: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk hash, bytes and row of all chunks; a boundary follows a word by its hash, every ``LONGEST`` words without one, and every row's end."""
    if not len(words):
        return words, size, row
    with np.errstate(over="ignore"):
        w = words.view(np.uint64)
        end = tokens.mix(w * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(CHUNK) == 0
        end |= np.append(row[1:] != row[:-1], True)
        # Words since the last boundary; a stretch without one is cut into parts.
        start = np.append(True, end[:-1])
        since = np.arange(len(w)) - np.maximum.accumulate(np.where(start, np.arange(len(w)), 0))
        start |= since % LONGEST == 0
        first = np.nonzero(start)[0]
        at = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
        x = tokens.mix((w + np.uint64(0x165667B19E3779F9)) * (at.astype(np.uint64) * np.uint64(2) + np.uint64(0x27D4EB2F165667C5)))
        total = tokens.mix(np.add.reduceat(x, first))
    return total.view(np.int64), np.add.reduceat(size, first), row[first]


def _equal_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs with enough coverage whose words are the same in order but for the tolerated share."""
    for b in batches:
        part = {}
        for c in ("a_words", "b_words", "a_chunks", "b_chunks", "a_sizes"):
            values, at = b[c].flatten().to_numpy(zero_copy_only=False), b[c].offsets.to_numpy()
            part[c] = (values, at - at[0])
        of = lambda c, k: part[c][0][part[c][1][k] : part[c][1][k + 1]]
        keep = []
        for k, (ta, tb) in enumerate(zip(b["a_total"].to_pylist(), b["b_total"].to_pylist())):
            shared = of("a_sizes", k)[np.isin(of("a_chunks", k), of("b_chunks", k), assume_unique=True)].sum()
            x, y = of("a_words", k), of("b_words", k)
            keep.append(bool(shared >= COVER * max(ta, tb)) and common(x, y) >= SAME * max(len(x), len(y)))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence; quick refusal if the bags of words share too little."""
    if len(np.intersect1d(x, y)) == 0:
        return 0
    ux, cx = np.unique(x, return_counts=True)
    uy, cy = np.unique(y, return_counts=True)
    both, i, j = np.intersect1d(ux, uy, return_indices=True)
    if np.minimum(cx[i], cy[j]).sum() < SAME * max(len(x), len(y)):
        return 0
    # Bit-parallel: one big integer holds the row of the table.
    masks: dict[int, int] = {}
    for k, w in enumerate(x.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(x)) - 1
    v = full
    for w in y.tolist():
        m = masks.get(w, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(x) - v.bit_count()


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


class History:
    """The persistent tables under ``path``; a batch counts once its marker is there. ``buckets`` holds for a new path only."""

    TABLES = {
        "keys": ("key", "key bigint, seq bigint"),
        "postings": ("chunk", "chunk bigint, text bigint, w bigint"),
        "texts": ("text", "text bigint, words array<bigint>, chunks array<bigint>, sizes array<int>, total bigint, first bigint"),
    }

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/_committed/{name}")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at(""))] if self.fs.exists(self._at("")) else []
        self.batches = sorted(int(n) for n in names if n.isdigit())
        kept = [int(n.split("=")[1]) for n in names if n.startswith("buckets=")]
        if kept:
            self.buckets = kept[0]
        else:
            self.fs.create(self._at(f"buckets={buckets}")).close()

    def read(self, name: str, touched: DataFrame, few: bool = True) -> DataFrame:
        """The rows of a table whose key is among those of ``touched``, a DataFrame with that one column; if they are ``few`` only their buckets are read."""
        key, schema = self.TABLES[name]
        if not self.batches:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, batch int, bucket int").parquet(f"{self.path}/{name}").filter(F.col("batch").isin(self.batches))
        if few:
            mine = [r[0] for r in touched.select(_bucket(key, self.buckets)).distinct().collect()]  # no more than there are buckets
            rows = rows.filter(F.col("bucket").isin(mine))
        rows = rows.drop("batch", "bucket")
        keys = touched.select(key).distinct()
        # Chunks are many and short: a hash join without a sort. Keys and texts asked for are few and may be broadcast.
        return rows.join(keys.hint("shuffle_hash") if name == "postings" else keys, key, "left_semi")

    def append(self, **tables: DataFrame) -> None:
        """Writes a batch; its marker comes last."""
        k = self.batches[-1] + 1 if self.batches else 0
        for name, df in tables.items():
            key, schema = self.TABLES[name]
            rows = df.select(*(c.split()[0] for c in schema.split(", ")), _bucket(key, self.buckets).alias("bucket"))
            rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batch={k}")
        self.fs.create(self._at(f"{k:06d}")).close()
        self.batches.append(k)


# A posting's numbers in one: whether the text is new, its words, its bytes, the chunk's bytes. Numbers that don't fit are
# taken as the largest that do, which lets only more pairs through to the comparison itself.
_NEW, _N, _TOTAL, _SIZE = (61, 1), (37, 24), (10, 27), (0, 10)


def _packed(n: Column, total: Column, size: Column) -> Column:
    put = lambda c, at: F.shiftleft(F.least(c.cast("bigint"), F.lit((1 << at[1]) - 1)), at[0])
    return put(n, _N).bitwiseOR(put(total, _TOTAL)).bitwiseOR(put(size, _SIZE))


def _part(w: str, at: tuple[int, int]) -> Column:
    return F.shiftright(F.col(w), at[0]).bitwiseAND(F.lit((1 << at[1]) - 1))


def _text_key(text: str) -> Column:
    return F.xxhash64(F.lit("text"), F.col(text))


class Batch:
    """Rows of articles held against a history and against each other. ``words`` has the columns of ``own_words``; ``history`` may be empty."""

    def __init__(self, articles: DataFrame, words: DataFrame, history: History | None = None):
        self.scratch, self.history = Scratch(articles.sparkSession, "history"), history
        rows = articles.select(F.col("ingest_seq").cast("bigint").alias("seq"), "source_id", "article_id", "guid", F.array_distinct(F.transform(F.array_distinct(F.array_compact(F.array("url", "canonical_url"))), address)).alias("pages"))
        keys = F.array_compact(F.concat(F.transform("pages", lambda p: F.when(p != "", F.xxhash64(F.lit("page"), p))), F.array(F.when(F.trim("guid") != "", _key("entry", F.col("source_id"), F.trim("guid"))))))
        rows = rows.filter("seq is not null").select("seq", "article_id", keys.alias("keys")).dropDuplicates(["seq"])
        named = rows.join(words.select("doc", "text"), rows["article_id"] == F.col("doc"), "left").select("seq", "text", "keys", "doc")
        self.rows = self.scratch.keep(named)
        # A batch of many rows touches every bucket.
        self.few = bool(history and history.batches) and self.rows.limit(8 * history.buckets).count() < 8 * history.buckets
        # Equal texts are one text, with the earliest row that has it; those that the history has are decided by their key.
        first = self.rows.filter("text is not null").groupBy("text").agg(F.min("seq").alias("first"), F.min_by("doc", "seq").alias("doc"))
        if history and history.batches:
            first = first.withColumn("key", _text_key("text"))
            first = first.join(history.read("keys", first.select("key"), self.few).select("key").distinct(), "key", "left_anti")
        self.texts = self.scratch.keep(first.select("first", "doc").join(words, "doc").select("first", *(c.split()[0] for c in _OWN.split(", "))))

    def _postings(self, texts: DataFrame) -> DataFrame:
        """chunk, text, w of every chunk of the texts."""
        out = texts.select("text", "n", "total", F.explode(F.arrays_zip("chunks", "sizes")).alias("c"))
        return out.select(F.col("c.chunks").alias("chunk"), "text", _packed(F.col("n"), F.col("total"), F.col("c.sizes")).alias("w"))

    def _met(self) -> tuple[DataFrame, DataFrame]:
        """a, b: near texts that share enough in chunks that aren't hot; chunk, text, new, n, first of crowded texts in hot chunks."""
        mine = self._postings(self.texts).withColumn("w", F.col("w").bitwiseOR(F.lit(1 << _NEW[0])))
        old = bool(self.history and self.history.batches)
        if old:
            mine = self.scratch.keep(mine.unionByName(self.history.read("postings", mine.select("chunk"), self.few)))
        counted = mine.groupBy("chunk").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        look = self.scratch.keep(mine.join(counted.hint("shuffle_hash"), "chunk"))  # one row a chunk, so the long side needs no sort
        # Crowded texts: of their hot chunks the rarest, all but CROWDED of the bytes.
        hot = look.filter(F.col("df") > HOT).withColumns({"size": _part("w", _SIZE), "total": _part("w", _TOTAL)})
        hot = hot.withColumn("all", F.sum("size").over(Window.partitionBy("text"))).filter(F.col("all") > CROWDED * F.col("total"))
        upto = F.sum("size").over(Window.partitionBy("text").orderBy(F.desc("df"), "chunk"))
        left = hot.withColumn("upto", upto).filter(F.col("upto") > CROWDED * F.col("total")).select("chunk", "text", "w")
        left = self.scratch.keep(left.join(left.groupBy("chunk").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1"), "chunk"))
        few = look.filter(F.col("df") <= HOT).select("chunk", "text", "w").unionByName(left.filter(F.col("crowd") <= DIRECT).drop("crowd"))
        side = lambda k: few.select("chunk", F.col("text").alias(k), F.col("w").alias(f"{k}_w"))
        n, m, t, u = _part("a_w", _N), _part("b_w", _N), _part("a_w", _TOTAL), _part("b_w", _TOTAL)
        met = side("a").join(side("b"), "chunk").filter((F.col("a") < F.col("b")) & (F.col("a_w").bitwiseOR(F.col("b_w")) >= F.lit(1 << _NEW[0])) & (F.least(n, m) >= SAME * F.greatest(n, m)))
        pairs = met.groupBy("a", "b").agg(F.sum(_part("a_w", _SIZE)).alias("shared"), F.max(F.greatest(t, u)).alias("larger"))
        found = self._confirmed(pairs.filter(F.col("shared") >= (COVER - CROWDED) * F.col("larger")).select("a", "b"))
        self.scratch.drop(look, mine)
        left = left.filter(F.col("crowd") > DIRECT).select("chunk", "text", (_part("w", _NEW) == 1).alias("new"), _part("w", _N).alias("n"))
        first = self.texts.select("text", "first")
        if old:
            first = first.unionByName(self.history.read("texts", left.filter("not new").select("text"), self.few).select("text", "first"))
        return found, left.join(first, "text")

    def _alive(self, crowd: DataFrame, state: DataFrame) -> DataFrame:
        """The texts of ``crowd`` that have an accepted row, with the earliest one's seq ``p``."""
        ok = self.rows.filter("text is not null").join(state.filter("state = 2"), "seq", "left_anti").groupBy("text").agg(F.min("seq").alias("own"))
        own = crowd.join(ok, "text", "left").withColumn("p", F.when(F.col("new"), F.col("own")).otherwise(F.col("first")))
        return self.scratch.keep(own.filter("p is not null").select("text", "p"))

    def _lead(self, left: DataFrame, alive: DataFrame, tested: DataFrame | None, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Links among the texts in ``alive``, the earliest ones leading, and the texts of them that have met all others.

        ``tested`` have met each other before; ``links`` are those that earlier calls found.
        """
        here = left.drop("first").join(alive, "text")
        if tested is None:
            here = here.withColumn("fresh", F.lit(True))
        else:
            here = here.join(tested.select("text", F.lit(False).alias("known")), "text", "left").withColumn("fresh", F.col("known").isNull()).drop("known")
            here = here.join(here.filter("fresh").select("chunk").distinct(), "chunk", "left_semi")
        cur, leaders, found = self.scratch.keep(here), 1, None
        while not cur.isEmpty():
            place = F.row_number().over(Window.partitionBy("chunk").orderBy("p", "text"))
            lead = self.scratch.keep(cur.withColumn("place", place).filter(F.col("place") <= leaders).drop("place"))
            ahead = lead.select("chunk", *(F.col(c).alias(f"a_{c}") for c in ("text", "new", "n", "p", "fresh")))
            met = cur.join(ahead, "chunk").filter("(a_p < p or a_p = p and a_text < text) and (a_new or new) and (a_fresh or fresh)").filter(F.least("a_n", "n") >= SAME * F.greatest("a_n", "n"))
            met = met.select(F.col("a_text").alias("a"), F.col("text").alias("b")).distinct()
            met = met if links is None else met.join(links, ["a", "b"], "left_anti")
            got = self._confirmed(met)
            found = got if found is None else found.union(got)
            # Texts of the history are accepted, whatever they match.
            rest = cur.join(lead, ["chunk", "text"], "left_anti").join(got.select(F.col("b").alias("text"), F.lit(True).alias("out")).distinct(), "text", "left").filter("out is null or not new").drop("out")
            following = self.scratch.keep(rest)
            self.scratch.drop(cur, lead)
            cur, leaders = following, leaders * 32
        old = left.filter("not new").select("text").distinct()
        out = found.select(F.col("b").alias("text")).distinct().join(old, "text", "left_anti")
        return found, self.scratch.keep(alive.select("text").join(out, "text", "left_anti"))

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose chunks cover enough and whose words confirm it."""
        pairs = self.scratch.keep(pairs)
        needed = pairs.select(F.col("a").alias("text")).union(pairs.select(F.col("b").alias("text"))).distinct()
        words = self.texts.select("text", "words", "chunks", "sizes", "total").join(needed, "text", "left_semi")
        if self.history and self.history.batches:
            words = words.unionByName(self.history.read("texts", needed, self.few).drop("first"))
        side = lambda k, *more: words.select(F.col("text").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("words", "chunks", "total", *more)))
        both = pairs.join(side("a", "sizes"), "a").join(side("b"), "b")
        found = self.scratch.keep(both.mapInArrow(_equal_words, "a bigint, b bigint"))
        self.scratch.drop(pairs)
        return found

    def decide(self) -> DataFrame:
        """kept_seq, dup_seq of every row that repeats an accepted one."""
        found, left = self._met()
        left = self.scratch.keep(left)
        state, repeats = self._decided(found)
        if left.isEmpty():
            return repeats
        crowd, tested, links = self.scratch.keep(left.select("text", "new", "n", "first").distinct()), None, None
        while True:
            alive = self._alive(crowd, state)
            fresh = alive if tested is None else alive.join(tested, "text", "left_anti")
            if fresh.isEmpty():
                break
            got, tested = self._lead(left, alive, tested, links)
            links = self.scratch.keep(got if links is None else links.union(got).distinct())
            state, repeats = self._decided(found.union(links))
        # The kept row is the earliest: accepted texts that a repetition left before it met them.
        last = repeats.join(self.rows.select(F.col("seq").alias("dup_seq"), "text"), "dup_seq").groupBy("text").agg(F.max("kept_seq").alias("kept"))
        gone = crowd.filter("new").join(alive.select("text"), "text", "left_anti").join(last, "text").select("text", "n", "kept")
        ahead = left.select("chunk", "text", "n").join(alive, "text").select("chunk", F.col("text").alias("a"), F.col("n").alias("a_n"), "p")
        met = left.select("chunk", "text").join(gone, "text").join(ahead, "chunk").filter(F.col("p") < F.col("kept")).filter(F.least("a_n", "n") >= SAME * F.greatest("a_n", "n"))
        met = met.select("a", F.col("text").alias("b")).distinct()
        known = found.union(links)
        met = met.join(known.select("a", "b").union(known.select("b", "a")), ["a", "b"], "left_anti")
        earlier = self._confirmed(met).join(alive.select(F.col("text").alias("a"), "p"), "a").groupBy(F.col("b").alias("text")).agg(F.min("p").alias("p"))
        earlier = self.rows.select(F.col("seq").alias("dup_seq"), "text").join(earlier, "text").select("dup_seq", "p")
        return repeats.join(earlier, "dup_seq", "left").select(F.least("kept_seq", "p").alias("kept_seq"), "dup_seq")

    def _decided(self, near: DataFrame) -> tuple[DataFrame, DataFrame]:
        """seq, state of the rows that any link or key could decide; kept_seq, dup_seq of the repetitions."""
        rows = self.rows
        partner = near.select("a", "b").union(near.select("b", "a")).distinct()
        own = rows.select("seq", F.explode(F.array_compact(F.concat("keys", F.array(F.when(F.col("text").isNotNull(), _text_key("text")))))).alias("key"))
        look = own.union(rows.join(partner, rows["text"] == partner["a"]).select("seq", _text_key("b").alias("key"))).distinct()
        past = None
        # Only keys that two rows meet in, or a row and the history, can decide anything.
        meet = look.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
        if self.history and self.history.batches:
            past = self.scratch.keep(self.history.read("keys", look.select("key"), self.few).groupBy("key").agg(F.min("seq").alias("seq")))
            meet = meet.union(past.select("key")).distinct()
        own, look = self.scratch.keep(own.join(meet, "key", "left_semi")), self.scratch.keep(look.join(meet, "key", "left_semi"))
        state = self.scratch.keep(look.select("seq").distinct().withColumn("state", F.lit(0)))  # 0 undecided, 1 accepted, 2 repetition
        accepted = None
        while True:
            s = own.join(state, "seq")
            per = s.groupBy("key").agg(F.min(F.when(F.col("state") == 1, F.col("seq"))).alias("acc"), F.min(F.when(F.col("state") == 0, F.col("seq"))).alias("open"))
            if past is not None:
                per = per.union(past.select("key", F.col("seq").alias("acc"), F.lit(None).cast("bigint").alias("open"))).groupBy("key").agg(F.min("acc").alias("acc"), F.min("open").alias("open"))
            seen = look.join(per, "key").groupBy("seq").agg(F.min("acc").alias("acc"), F.min("open").alias("open"))
            if state.filter("state = 0").isEmpty():
                accepted = seen
                break
            to = F.when(F.col("state") > 0, F.col("state")).when(F.col("acc") < F.col("seq"), 2).when(F.coalesce(F.col("open") < F.col("seq"), F.lit(False)), 0).otherwise(1)
            following = self.scratch.keep(state.join(seen, "seq", "left").select("seq", to.alias("state")))
            self.scratch.drop(state)
            state = following
        repeats = self.scratch.keep(state.filter("state = 2").join(accepted, "seq").select(F.col("acc").alias("kept_seq"), F.col("seq").alias("dup_seq")))
        self.scratch.drop(own, look)
        return state, repeats

    def accept(self, repetitions: DataFrame) -> None:
        """Appends the batch's accepted rows to the history."""
        ok = self.scratch.keep(self.rows.join(repetitions.select(F.col("dup_seq").alias("seq")), "seq", "left_anti"))
        keys = ok.select("seq", F.explode(F.array_compact(F.concat("keys", F.array(F.when(F.col("text").isNotNull(), _text_key("text")))))).alias("key")).groupBy("key").agg(F.min("seq").alias("seq"))
        # Only texts whose earliest row was no accepted one change; they are few beside the texts themselves.
        own = ok.filter("text is not null").groupBy("text").agg(F.min("seq").alias("own"))
        moved = self.texts.select("text", "first").join(own, "text", "left").filter("own is null or own != first").select("text", "own", F.lit(True).alias("moved"))
        kept = self.texts.join(self.scratch.keep(moved), "text", "left").filter("moved is null or own is not null").withColumn("first", F.coalesce("own", "first"))
        self.history.append(keys=keys, postings=self._postings(kept), texts=kept)


def repetitions(articles: DataFrame, texts: DataFrame, path: str | None = None, batches: int = 3) -> DataFrame:
    """The rows in ``batches`` parts by ingest_seq, each held against what the history under ``path`` (by default a new
    one in the shared folder) has accepted; the outcome doesn't depend on how rows are cut into batches."""
    spark = articles.sparkSession
    cuts = articles.agg(F.percentile_approx("ingest_seq", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    part = sum(((F.col("ingest_seq") > c).cast("int") for c in cuts), F.lit(0))
    own = own_words(texts, articles, part)
    scratch = Scratch(spark, "accepted")
    past = History(spark, path or f"{scratch.root}/history")
    out = None
    for k in range(len(cuts) + 1):
        batch = Batch(articles.filter(part == k), own.filter(F.array_contains("parts", k)), past)
        found = scratch.keep(batch.decide())
        if k < len(cuts) or path:
            batch.accept(found)
        batch.scratch.clear()
        out = found if out is None else out.union(found)
    return out
