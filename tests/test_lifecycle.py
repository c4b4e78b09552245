"""Chains of merges, partition replacement, greedy rounds, and states at their limits."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.functions import cohesion
from tidemill.operators import matching, mutations
from tidemill.plans import events, lifecycle


def test_chains_are_followed_to_their_end(spark):
    pairs = [(f"e{k + 1}", f"e{k}") for k in range(20)] + [("z", "y")]
    got = dict(map(tuple, mutations.follow_chains(spark.createDataFrame(pairs, "l string, w string"), "l", "w").collect()))
    assert got == {f"e{k + 1}": "e0" for k in range(20)} | {"z": "y"}
    assert mutations.follow_chains(spark.createDataFrame([], "l string, w string"), "l", "w").count() == 0
    with pytest.raises(ValueError):
        mutations.follow_chains(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "l string, w string"), "l", "w")


def test_partition_replacement(spark):
    m = spark.createDataFrame([("a", "e", 1), ("b", "e", 2), ("c", "f", 3), (None, "e", 4)], "i string, g string, x int").filter("i is not null")
    parts = lambda *rows: spark.createDataFrame(list(rows), "i string, g string")
    out = mutations.replace_partition(m, "i", "g", "e", parts(("a", "e"), ("b", "n")))
    assert sorted(map(tuple, out.collect())) == [("a", "e", 1), ("b", "n", 2), ("c", "f", 3)]
    for bad in (parts(("a", "e")), parts(("a", "e"), ("b", "e"), ("b", "n")), parts(("a", "n"), ("b", "o")), parts(("a", "e"), ("b", "f")), parts(("a", "e"), ("b", "e"), ("c", "n"))):
        with pytest.raises(ValueError):
            mutations.replace_partition(m, "i", "g", "e", bad)


@pytest.mark.parametrize("seed", [1, 2])
def test_disjoint_round_against_a_loop(spark, seed):
    rng = random.Random(seed)
    pairs = {(min(p), max(p)) for p in ([rng.randrange(30), rng.randrange(30)] for _ in range(120)) if p[0] != p[1]}
    rows = [(a, b, k) for k, (a, b) in enumerate(rng.sample(sorted(pairs), len(pairs)))] + [(5, 5, 1000)]
    used, want = set(), set()
    for a, b, k in sorted(rows, key=lambda r: r[2]):
        if a != b and not used & {a, b}:
            used |= {a, b}
            want.add((a, b, k))
    df = spark.createDataFrame(rows, "a int, b int, k int")
    assert {tuple(r) for r in matching.disjoint_round(df, "a", "b", "k").collect()} == want
    assert matching.disjoint_round(df.limit(0), "a", "b", "k").count() == 0


def test_event_states_at_their_limits(spark):
    now = datetime(2025, 1, 31)
    rows = [(k, now - timedelta(hours=h)) for k, h in enumerate((0, 48, 49, 720, 721))]
    df = spark.createDataFrame(rows, "k int, t timestamp").select("k", lifecycle.event_state(F.col("t"), F.lit(now)).alias("s"))
    assert [r["s"] for r in df.orderBy("k").collect()] == ["active", "active", "stale", "stale", "archived"]


def test_hot_keywords_need_enough_events_of_their_category(spark):
    rows = [(f"e{k}", "a", "common", 1) for k in range(5)] + [(f"e{k}", "a", f"own{k}", 2) for k in range(10)] + [(f"f{k}", "b", "common", 1) for k in range(7)]
    got = {tuple(r) for r in events.hot_keywords(spark.createDataFrame(rows, "event_id string, category string, keyword string, rank int")).collect()}
    assert got == {("a", "common", 5)}  # category b has too few events


def test_cohesion_strengths(spark):
    pairs = [("Mayor of Malmo opens Turning Torso tower", "Turning Torso tower in Malmo sold", 2), ("Court frees Anna Berg", "Anna Berg wins marathon", 1), ("City plan and health policy", "Health policy and city plan", 0), ("One word", "None here", 0), (None, "x", None)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    got = [r["s"] for r in df.select(cohesion.strength(cohesion.words(F.col("a")), cohesion.words(F.col("b"))).alias("s")).collect()]
    assert got[:4] == [p[2] for p in pairs[:4]]
