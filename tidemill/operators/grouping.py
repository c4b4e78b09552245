"""Aggregations over groups of articles: pairs of groupings, majorities, coverage, winners, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A group's most frequent value; of several the one met first."""
    per = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return per.groupBy(key).agg(F.min_by(value, F.struct((-F.col("n")).alias("m"), "first")).alias(value), F.max("n").alias("n"))


def titles(df: DataFrame, key: str, headline: str, order: str) -> DataFrame:
    """A group's title: the shortest headline of at least 20 characters, else the shortest; of several the first."""
    size = F.length(headline)
    return df.filter(F.col(headline).isNotNull()).groupBy(key).agg(F.min_by(headline, F.struct((size < 20).alias("a"), size.alias("b"), F.col(order).alias("c"))).alias("title"))


def coverage(df: DataFrame, key: str, publisher: str, article: str) -> DataFrame:
    """Publishers, articles, further angles of a publisher (at most two each), and their score."""
    per = df.select(key, publisher, article).distinct().groupBy(key, publisher).agg(F.count(F.lit(1)).alias("n"))
    angles = F.least(F.greatest(F.col("n") - 1, F.lit(0)), F.lit(2))
    out = per.groupBy(key).agg(F.count(F.lit(1)).alias("publishers"), F.sum("n").alias("articles"), F.sum(angles).alias("angles"), F.sum((F.col("n") > 1).cast("int")).alias("multi_angle"))
    return out.withColumn("score", F.round(F.col("publishers") + 0.5 * F.col("angles"), 2))


def grouping_agreement(left: DataFrame, right: DataFrame, item: str, group: str) -> DataFrame:
    """How far two groupings of the same items put the same pairs together.

    Pairs are counted from group sizes, never listed: the pairs both have are those inside the meets of two groups.
    """
    two = lambda n: n * (n - 1) / 2
    pairs = lambda df, name, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(two(F.col("n"))), F.lit(0.0)).cast("bigint").alias("pairs")).withColumn("of", F.lit(name))
    a, b = left.select(item, F.col(group).alias("ga")), right.select(item, F.col(group).alias("gb"))
    three = pairs(a, "left", "ga").union(pairs(b, "right", "gb")).union(pairs(a.join(b, item), "shared", "ga", "gb"))
    out = three.agg(*[F.max(F.when(F.col("of") == k, F.col("pairs"))).alias(f"{k}_pairs") for k in ("left", "right", "shared")])
    union = F.col("left_pairs") + F.col("right_pairs") - F.col("shared_pairs")
    return out.withColumn("jaccard", F.when(union == 0, 1.0).otherwise(F.round(F.col("shared_pairs") / union, 4)))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int, place: str = "place") -> DataFrame:
    """The first ``k`` rows of every group; the limit reaches the partial side, so a hot group is cut before it moves."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(place) <= k)


def diverse(df: DataFrame, group: str, publisher: str, order: list[Column], k: int) -> DataFrame:
    """Each publisher's first row before any second one, then the rest, in order."""
    mine = F.row_number().over(Window.partitionBy(group, publisher).orderBy(*order))
    ranked = df.withColumn("__again", (mine > 1).cast("int"))
    return top_per_group(ranked, group, [F.col("__again"), *order], k).drop("__again")


def batches(df: DataFrame, bucket: str, order: str, size: int) -> DataFrame:
    """Numbers the rows of a bucket in batches of ``size``; the name tells the number only where there are several.

    A bucket's rows are numbered from counts of hash-free ranges, so no bucket is sorted in one task: rows are
    range-partitioned by (bucket, order), numbered inside a part, and shifted by the counts of the parts before.
    """
    part = df.repartitionByRange(F.col(bucket), F.col(order)).withColumn("__p", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("__p", bucket).orderBy(order))
    numbered = part.withColumn("__i", inside)
    counts = numbered.groupBy(bucket, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(bucket).orderBy("__p")) - F.col("__n")).withColumn("__all", F.sum("__n").over(Window.partitionBy(bucket)))
    joined = numbered.join(before.drop("__n"), [bucket, "__p"])
    number = F.ceil((F.col("__i") + F.col("__before")) / size).cast("int")
    return joined.select(*df.columns, number.alias("batch"), F.when(F.col("__all") > size, F.concat_ws("-", bucket, number)).otherwise(F.col(bucket)).alias("batch_name"))


def merge_reads(df: DataFrame, reader: str, item: str, ms: str, keep: int) -> DataFrame:
    """Read states of one reader from several devices: the latest time of every item, the newest ``keep`` items."""
    latest = df.groupBy(reader, item).agg(F.max(ms).alias("read_ms"))
    return top_per_group(latest, reader, [F.desc("read_ms"), F.col(item)], keep)
