"""Consolidating pairwise matches into groups (problem 4).

Connected components by seed-tree pruning. In each round every vertex points its neighbours and
itself to the smallest vertex of its neighbourhood. A vertex that is nobody's minimum leaves the
graph and hangs below the smallest minimum it was pointed to, in the propagation forest; the
minima that one vertex was pointed to are linked with each other and make the next, smaller graph.
When no link is left, the seeds' identifiers flow down the forest.

All steps are equi joins and aggregations that combine on the map side; a vertex with a third of
all links is one row of the joined side, and its links are split by adaptive skew joins. Each
round is written to the shared folder. Nothing is collected but the count of links left.

Defined results: pairs with a null end are dropped, pairs of a vertex with itself and repeated
pairs change nothing; an empty input gives an empty result. Vertices compare in byte order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import Scratch


def groups(pairs: DataFrame, a: str, b: str, vertex: str = "vertex", group: str = "group_id") -> DataFrame:
    """One row for each vertex that is linked with another: its group's smallest vertex."""
    spark = pairs.sparkSession
    scratch = Scratch(spark, "groups")
    link = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u != v")
    link = scratch.keep(link.union(link.select("v", "u")).distinct())
    kind = link.schema["u"].dataType
    forest, rounds = spark.createDataFrame([], f"x {kind.simpleString()}, parent {kind.simpleString()}"), 0
    while not link.isEmpty():
        rounds += 1
        least = link.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        to = link.join(least, "u").select(F.col("v").alias("x"), "m").union(least.select(F.col("u").alias("x"), "m"))
        to = scratch.keep(to.distinct())
        best = to.groupBy("x").agg(F.min("m").alias("parent"), F.max(F.col("m") == F.col("x")).alias("stays"))
        best = scratch.keep(best)
        forest = forest.union(best.filter("not stays").select("x", "parent"))
        between = to.join(best.select("x", "parent"), "x").filter("m != parent").select(F.col("m").alias("u"), F.col("parent").alias("v"))
        following = scratch.keep(between.union(between.select("v", "u")).distinct())
        scratch.drop(link, to)
        link = following
    # A tree is no deeper than there were rounds; doubling the pointers reaches every seed in log2 of that.
    for _ in range(max(0, rounds - 1).bit_length()):
        above = forest.select(F.col("x").alias("parent"), F.col("parent").alias("above"))
        forest = scratch.keep(forest.join(above, "parent", "left").select("x", F.coalesce("above", "parent").alias("parent")))
    seeds = forest.select("parent").distinct()
    return forest.select(F.col("x").alias(vertex), F.col("parent").alias(group)).union(seeds.select(F.col("parent").alias(vertex), F.col("parent").alias(group)))


def event_groups(reviews: DataFrame) -> DataFrame:
    """event_id, group_id of every event in a group of two or more, linked by any positive judgement."""
    return groups(reviews.filter("should_merge = 1"), "event_a", "event_b", "event_id", "group_id")


def all_event_groups(reviews: DataFrame, *carriers: DataFrame) -> DataFrame:
    """The same for every event_id that the reviews or the carriers name; one without links is its own group."""
    found = event_groups(reviews)
    named = reviews.select(F.col("event_a").alias("event_id")).union(reviews.select("event_b"))
    for c in carriers:
        named = named.union(c.select("event_id"))
    named = named.filter("event_id is not null").distinct()
    return named.join(found, "event_id", "left").select("event_id", F.coalesce("group_id", "event_id").alias("group_id"))
