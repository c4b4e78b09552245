"""Pairs of titles that share popular words: all of them, while what moves stays in proportion to the titles."""

import itertools
import random

from pyspark.sql import functions as F

from tidemill.operators import matching


def shuffled(spark, run):
    """What ``run`` returns, and how many records its stages wrote to shuffles."""
    sc, jvm = spark.sparkContext, spark._jvm
    none, store = jvm.java.util.ArrayList(), sc._jsc.sc().statusStore()

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        return run(), written() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def titles(n):
    """Four words that all have, and one or two of a few others."""
    rng = random.Random(3)
    return [(f"e{i:04d}", " ".join(["harbour", "bridge", "waits", "again", "ferry", f"w{rng.randint(0, 20)}", f"v{rng.randint(0, 20)}"])) for i in range(n)]


def test_title_pairs_do_not_move(spark):
    rows = [*titles(300), ("x1", "bridge harbour waits"), ("x2", "Waits bridge harbour near"), ("x3", "one"), ("x4", ""), ("x5", None)]
    df = spark.createDataFrame(rows, "k string, title string")
    got, moved = shuffled(spark, lambda: {(r["a"], r["b"]): r["shared"] for r in matching.title_pairs(df, "k", "title").collect()})
    stop = {"again"}
    sets = {k: set((t or "").lower().split()) - stop for k, t in rows}
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n >= 4 or (n >= 3 and min(len(sets[a]), len(sets[b])) <= 4):
            want[a, b] = n
    assert got == want and len(want) > 300 * 299 / 2
    assert moved < 40 * len(rows)


def test_busy_tokens_are_divided(spark, monkeypatch):
    monkeypatch.setattr(matching, "CHUNK", 7)
    rng = random.Random(4)
    sets = {k: {rng.randint(0, 12) for _ in range(rng.randint(1, 9))} for k in range(150)}
    df = spark.createDataFrame([(k, sorted(map(str, s))) for k, s in sets.items()], "k int, t array<string>")
    for least in (1, 3):
        got = sorted((r["a"], r["b"], r["shared"], r["smaller"]) for r in matching.token_pairs(df, "k", "t", least).collect())
        want = sorted((a, b, len(sets[a] & sets[b]), min(len(sets[a]), len(sets[b]))) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= least)
        assert got == want


def test_numbers_beyond_the_bits(spark):
    sets = {k: {f"t{(k * 7 + j * j) % 400}" for j in range(40)} for k in range(80)}
    df = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "k int, t array<string>")
    got = {(r["a"], r["b"]): r["shared"] for r in matching.token_pairs(df, "k", "t", 4).collect()}
    assert got == {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 4}


def test_cohesion_pairs_do_not_move(spark, tmp_path):
    from tidemill.functions import cohesion
    from tidemill.plans import events

    rng = random.Random(5)
    names = ["Zorby", "zorby", "Kadin", "KADIN", "people", "Crisis", "war", "2024", "Q4", "Ferry", "ferry", "storm"]
    rows = [(i, f"a{i}", f"e{i:03d}", f"Harbour bridge waits {i % 9 + 100} under {i % 7 + 300} lamps") for i in range(400)]
    rows += [(i, f"a{i}", f"e{i:03d}", " ".join(rng.sample(names, rng.randint(2, 5)))) for i in range(400, 460)]
    df = spark.createDataFrame(rows, "ingest_seq bigint, article_id string, event_id string, headline string")
    df.write.parquet(f"{tmp_path}/articles.parquet")
    got, moved = shuffled(spark, lambda: sorted(map(tuple, events.d_cohesion(spark, str(tmp_path)).collect())))
    w = df.select("event_id", cohesion.words(F.col("headline")).alias("w"))
    x, y = w.selectExpr("event_id a", "w wa"), w.selectExpr("event_id b", "w wb")
    want = x.join(y, F.col("a") < F.col("b")).select("a", "b", cohesion.strength(F.col("wa"), F.col("wb")).alias("strength")).filter("strength > 0")
    assert got == sorted(map(tuple, want.collect())) and {s for _, _, s in got} == {1, 2} and len(got) > 400 * 399 / 2
    assert moved < 50 * len(rows)


def test_candidates_do_not_move(spark, tmp_path):
    from tidemill.plans import articles

    rows = [(i, f"a{i}", k, t) for i, (k, t) in enumerate([*titles(300), ("x1", "one two three"), ("x2", "three two one four"), ("x3", "one"), ("x4", "two")])]
    spark.createDataFrame(rows, "ingest_seq bigint, article_id string, event_id string, headline string").write.parquet(f"{tmp_path}/articles.parquet")
    reviews = [("e0002", "e0001"), ("e0001", "e0002"), ("e0007", "e0299"), ("x2", "x1"), ("x3", "x4"), ("x4", "x3"), ("e0003", "gone"), ("gone", "away"), ("x3", "x3"), (None, "x3")]
    spark.createDataFrame(reviews, "event_a string, event_b string").write.parquet(f"{tmp_path}/deduplication_reviews.parquet")
    got, moved = shuffled(spark, lambda: sorted((r["a"], r["b"], r["priority"], r["reasons"]) for r in articles.h_candidate_union(spark, str(tmp_path)).collect()))
    r = {tuple(sorted(x)) for x in reviews if None not in x and x[0] != x[1]}
    t = {*itertools.combinations([k for k, _ in titles(300)], 2), ("x1", "x2")}
    assert got == sorted((a, b, 4 if (a, b) in t else 3, ((a, b) in t) + ((a, b) in r)) for a, b in t | r)
    assert moved < 50 * len(rows)
