"""The write algebra on snapshots: every operator takes the old rows and the new ones and gives the next snapshot.

Plain tables know no MERGE; each of these is one equi join or one aggregation on the key. Rows of a
null key are dropped. Ties are settled by the order column, so that no result depends on the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import Scratch


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key; an aggregate that combines before the shuffle, no sort of a hot key."""
    cols = df.columns
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("__r"))
    return best.select("__r.*")


def latest_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    cols = df.columns
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("__r")).select("__r.*")


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Old rows, and of the new keys each one's first row."""
    fresh = first_rows(new, key, order).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """New values win but for the ``keep`` columns, which stay as they were; null never overwrites."""
    n = latest_rows(new, key, order).select(key, *[F.col(c).alias(f"__n_{c}") for c in old.columns if c != key])
    both = old.join(n, key, "full_outer")
    pick = lambda c: F.coalesce(c, f"__n_{c}") if c in keep else F.coalesce(f"__n_{c}", c)
    return both.select(*[F.col(c) if c == key else pick(c).alias(c) for c in old.columns])


def guarded_update(df: DataFrame, guard: Column, column: str, value: Column) -> DataFrame:
    """Sets a column where the guard holds (null counts as not); ``changed`` tells where it made a difference."""
    g = F.coalesce(guard, F.lit(False))
    return df.withColumn("changed", (g & ~F.col(column).eqNullSafe(value)).cast("int")).withColumn(column, F.when(g, value).otherwise(F.col(column)))


def delete_cascade(parent: DataFrame, children: dict[str, DataFrame], key: str, gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    g = gone.select(key).distinct()
    return parent.join(g, key, "left_anti"), {n: c.join(g, key, "left_anti") for n, c in children.items()}


def repoint(df: DataFrame, column: str, mapping: DataFrame, loser: str, winner: str) -> DataFrame:
    """Rows of losers go to their winners; chains are the caller's (see components)."""
    m = mapping.select(F.col(loser).alias(column), F.col(winner).alias("__w"))
    return df.join(m, column, "left").withColumn(column, F.coalesce("__w", column)).drop("__w").select(*df.columns)


def follow_chains(mapping: DataFrame, loser: str, winner: str) -> DataFrame:
    """Every loser with the winner at the end of its chain. A loser has one winner; a ring of losers raises.

    Pointers are doubled until none moves any more, so a chain of n links takes log n joins."""
    scratch = Scratch(mapping.sparkSession, "chains")
    now, steps = scratch.keep(mapping.select(F.col(loser).alias("l"), F.col(winner).alias("w"))), 0
    while True:
        on = now.select(F.col("l").alias("w"), F.col("w").alias("further"))
        following = scratch.keep(now.join(on, "w", "left").select("l", F.coalesce("further", "w").alias("w"), F.col("further").isNotNull().alias("moved")))
        moved = not following.filter("moved").isEmpty()
        scratch.drop(now)
        now, steps = following.drop("moved"), steps + 1
        if not moved:
            return now.select(F.col("l").alias(loser), F.col("w").alias(winner))
        if steps > 64:
            raise ValueError("the mapping has a ring")


def replace_partition(members: DataFrame, item: str, group: str, old: str, parts: DataFrame) -> DataFrame:
    """``members`` with the items of group ``old`` put into the groups that ``parts`` (item, group) gives.

    Raises unless the parts hold each of the group's items once and no other, one part keeps the name ``old``, and the other
    names are new; each is one aggregation, so that nothing is replaced if anything is wrong."""
    mine = members.filter(F.col(group) == old).select(F.col(item).alias("i"), F.lit(1).alias("m"), F.lit(0).alias("p"))
    both = mine.union(parts.select(F.col(item), F.lit(0), F.lit(1))).groupBy("i").agg(F.sum("m").alias("m"), F.sum("p").alias("p"))
    if not both.filter("m != 1 or p != 1").isEmpty():
        raise ValueError("the parts don't hold every member exactly once")
    names = parts.select(F.col(group).alias("__n")).distinct()
    if names.filter(F.col("__n") == old).isEmpty():
        raise ValueError("no part keeps the old name")
    if not members.filter(F.col(group) != old).join(names, F.col(group) == F.col("__n"), "left_semi").isEmpty():
        raise ValueError("a part has the name of another group")
    to = parts.select(F.col(item).alias("__i"), F.col(group).alias("__g"))
    rest = members.join(to, (F.col(item) == F.col("__i")) & (F.col(group) == old), "left")
    return rest.select(*(F.coalesce("__g", group).alias(group) if c == group else F.col(c) for c in members.columns))
