"""Pairs of titles, keywords and slugs by inverted joins: tokens are exploded and met by equality, never all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.session import Scratch


# Fixed value: how many sets of a token one task meets with all others of that token; more of them are divided.
CHUNK = 1000


def _bits(ids: str) -> list[Column]:
    """256 bits in four columns, one for each number modulo 256; flat, for a join's condition reads nested ones slowly."""
    word = lambda i: F.aggregate(F.filter(ids, lambda x: F.floor(x % 256 / 64) == i), F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (x % 64).cast("int"))))
    return [word(i).alias(f"{ids}_{i}") for i in range(4)]


def common_bits(ids: str, a: str = "l_", b: str = "r_") -> Column:
    n = [F.bit_count(F.col(f"{a}{ids}_{i}").bitwiseAND(F.col(f"{b}{ids}_{i}"))) for i in range(4)]
    return n[0] + n[1] + n[2] + n[3]


def enough_bits(least: int) -> Column:
    """False only where less than ``least`` are shared; two tokens of a set with a bit in common (``lost``) count as shared."""
    return common_bits("s") + F.least("l_lost", "r_lost") >= least


def numbered(df: DataFrame, key: str, tokens: str, *marks: str, carried: DataFrame | None = None) -> DataFrame:
    """Sets as k, n (how many tokens), s (numbers of those that other sets have too, rarest first) and bits of s, written to the shared folder.

    ``marks`` name arrays with some of a set's tokens; their numbers and bits come along. So do the columns of ``carried`` (k, ...).
    Sets that share no token are left out.
    """
    sets = df.select(F.col(key).alias("k"), F.array_distinct(tokens).alias("s"), *marks)
    one = sets.select("k", F.size("s").alias("n"), F.explode("s").alias("t"), *marks)
    one = one.select("k", "n", "t", *[F.coalesce(F.array_contains(m, F.col("t")), F.lit(False)).alias(m) for m in marks])
    several = one.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").repartitionByRange("df", "t").sortWithinPartitions("df", "t")
    ids = several.select("t", F.monotonically_increasing_id().alias("id"))
    r = one.join(ids, "t").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("id", *marks))).alias("r"))
    marked = lambda m: F.transform(F.filter("r", lambda x: x[m]), lambda x: x["id"]).alias(m)
    out = r.select("k", "n", F.col("r.id").alias("s"), *map(marked, marks))
    out = out.select("*", *[w for m in ("s", *marks) for w in _bits(m)])
    out = out.withColumn("lost", F.size("s") - common_bits("s", "", ""))
    # Written once: numbers of a second run could differ from those of the first.
    return Scratch(df.sparkSession, "sets").keep(out.join(carried, "k", "left") if carried is not None else out)


def meet(left: DataFrame, right: DataFrame, least: int, once: Column) -> DataFrame:
    """l_*, r_* (the columns of ``numbered``) and the numbers they share, for pairs that share at least ``least`` and fulfil ``once``.

    Of two sets that share ``least`` tokens, the rarest shared one is among the |set| - least + 1 rarest of each; only these
    meet. A pair is given where it meets by its rarest shared token, and counted from the sets that came along, so pairs are
    neither made distinct nor joined again: what moves is in proportion to the sets. Bits tell most vain meetings apart before.
    """
    rows = lambda df, x: df.filter(F.size("s") >= least).select(F.explode(F.slice("s", F.lit(1), F.size("s") - (least - 1))).alias("t"), *[F.col(c).alias(x + c) for c in df.columns])
    a, b = rows(left, "l_"), rows(right, "r_")
    # At most one row for every CHUNK rows of ``a``.
    busy = F.broadcast(a.groupBy("t").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts")).filter("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    a = a.join(busy, "t", "left").withColumn("part", F.pmod(F.xxhash64("l_k"), parts).cast("int")).drop("parts")
    b = b.join(busy, "t", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    # As much work as there are meetings, not bytes: partitions that aren't put together for being small.
    tasks = 2 * int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = a.repartition(tasks, "t", "part").join(b.repartition(tasks, "t", "part").hint("shuffle_hash"), ["t", "part"]).filter(enough_bits(least) & once)
    # Exploded, so that what two sets share is computed once and not again for every condition.
    shared = met.withColumn("shared", F.explode(F.array(F.array_intersect("l_s", "r_s"))))
    return shared.filter((F.size("shared") >= least) & (F.col("shared")[0] == F.col("t"))).drop("t", "part")


def token_pairs(df: DataFrame, key: str, tokens: str, least: int = 1) -> DataFrame:
    """a < b and the number of tokens they share, for pairs that share at least ``least``."""
    sets = numbered(df, key, tokens)
    met = meet(sets, sets, least, F.col("l_k") < F.col("r_k"))
    return met.select(F.col("l_k").alias("a"), F.col("r_k").alias("b"), F.size("shared").alias("shared"), F.least("l_n", "r_n").alias("smaller"))


def titles_match(a: Column, b: Column) -> Column:
    """Whether the tokens of two titles share four, or three where the shorter has no more than four."""
    shared = F.size(F.array_intersect(a, b))
    return (shared >= 4) | ((shared >= 3) & (F.least(F.size(a), F.size(b)) <= 4))


def title_pairs(df: DataFrame, key: str, title: str, known: DataFrame | None = None) -> DataFrame:
    """a < b and the number of tokens they share, for titles that match (``titles_match``).

    With ``known`` (a < b, a row a pair), also whether the pair is among these; they move with the titles, so the pairs needn't.
    """
    t = df.select(key, text.title_tokens(F.col(title)).alias("tokens"))
    with_ = known.groupBy(F.col("a").alias("k")).agg(F.collect_list("b").alias("known")) if known is not None else None
    sets = numbered(t, key, "tokens", carried=with_)
    long = sets.filter("n > 4")
    first = F.col("l_k") < F.col("r_k")
    four = meet(long, long, 4, first)
    three = meet(sets.filter("n <= 4"), sets, 3, first | (F.col("r_n") > 4))
    met = four.unionByName(three)
    a, b = F.least("l_k", "r_k"), F.greatest("l_k", "r_k")
    more = [F.coalesce(F.array_contains(F.when(first, F.col("l_known")).otherwise(F.col("r_known")), b), F.lit(False)).alias("known")] if known is not None else []
    return met.select(a.alias("a"), b.alias("b"), F.size("shared").alias("shared"), *more)


def disjoint_round(pairs: DataFrame, a: str, b: str, rank: str) -> DataFrame:
    """The pairs that one greedy pass in order of ``rank`` (unique) takes: each whose ends no earlier taken pair has.

    A pair that comes first at both its ends is taken whatever the others are; all such pairs are taken at once,
    pairs that touch them go, and the rest is looked at again. Every step is an aggregation and two equi joins.
    """
    scratch = Scratch(pairs.sparkSession, "round")
    left, taken = scratch.keep(pairs.filter(F.col(a) != F.col(b))), None
    while not left.isEmpty():
        ends = left.select(F.col(a).alias("v"), rank).union(left.select(F.col(b).alias("v"), rank)).groupBy("v").agg(F.min(rank).alias("top"))
        first = scratch.keep(left.join(ends.select(F.col("v").alias(a), F.col("top").alias("__x")), a).join(ends.select(F.col("v").alias(b), F.col("top").alias("__y")), b).filter(f"__x = {rank} and __y = {rank}").select(*left.columns))
        used = first.select(F.col(a).alias("v")).union(first.select(F.col(b).alias("v")))
        following = scratch.keep(left.join(used, left[a] == used["v"], "left_anti").join(used, left[b] == used["v"], "left_anti"))
        scratch.drop(left)
        left, taken = following, first if taken is None else taken.union(first)
    return pairs.limit(0) if taken is None else taken
