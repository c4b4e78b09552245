"""Core operators on small fixtures, against plain Python where there is something to compute."""

import itertools
import random

from pyspark.sql import functions as F

from tidemill.functions import text, urls
from tidemill.operators import grouping, matching, mutations, windows


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("r")).first()["r"]


def test_text_functions(spark):
    assert one(spark, "  A b\n c ", text.collapse) == "A b c"
    assert one(spark, "The Año of 5G-Tests", text.normalised_title) == "the a o of 5g tests"
    assert one(spark, "Of the and", text.slug) == "story"
    assert one(spark, "2024-01-08-trial-date-10-2", text.base_slug) == "trial-date-10"
    assert one(spark, "../a b//", text.sanitize_id) == "a-b-" or one(spark, "../a b//", text.sanitize_id) == "a-b"
    assert one(spark, "..", text.sanitize_id) == "unknown"
    assert one(spark, None, text.slug) is None
    assert one(spark, "word " * 100, lambda c: text.bounded(c, 12)) == "word word"
    assert one(spark, "x" * 400, text.summary_fallback) == "x" * 300 + "…"


def test_urls(spark):
    assert one(spark, "HTTPS://News.Example/a?b=2&utm_source=x&a=1#top", urls.canonical) == "https://news.example/a?a=1&b=2"
    assert one(spark, "http://h.example", urls.canonical) == "http://h.example/"
    assert one(spark, "mailto:a@b", urls.canonical) is None
    assert one(spark, None, urls.canonical) is None
    assert one(spark, "https://h.example/2024/01/08/2024/02/09/x", urls.path_dates) == ["2024/01/08"]


def test_snapshot_writes(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, v int, keep string")
    new = spark.createDataFrame([("a", 5, "n", 1), ("a", 6, None, 2), ("c", 7, "y", 3), (None, 8, "z", 4)], "k string, v int, keep string, o int")
    got = {r["k"]: (r["v"], r["keep"]) for r in mutations.upsert(old, new, "k", "o", keep=("keep",)).collect()}
    assert got == {"a": (6, "x"), "b": (2, None), "c": (7, "y")}
    ins = {r["k"]: r["v"] for r in mutations.insert_or_ignore(old, new, "k", "o").collect()}
    assert ins == {"a": 1, "b": 2, "c": 7}
    parent, kids = mutations.delete_cascade(old, {"n": new}, "k", old.filter("k = 'a'"))
    assert [r["k"] for r in parent.collect()] == ["b"] and kids["n"].filter("k = 'a'").count() == 0
    up = mutations.guarded_update(old, F.col("keep").isNull(), "v", F.lit(2)).orderBy("k").collect()
    assert [(r["v"], r["changed"]) for r in up] == [(1, 0), (2, 0)]


def test_token_pairs_match_brute_force(spark):
    rng = random.Random(1)
    sets = {k: {rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 7))} for k in range(60)}
    df = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "k int, t array<string>")
    for least in (1, 2, 3, 4):
        got = {(r["a"], r["b"]): r["shared"] for r in matching.token_pairs(df, "k", "t", least).collect()}
        want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= least}
        assert got == want


def test_grouping(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, g string")
    right = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "i int, g string")
    r = grouping.grouping_agreement(left, right, "i", "g").first()
    assert (r["left_pairs"], r["right_pairs"], r["shared_pairs"], r["jaccard"]) == (1, 3, 1, 0.3333)
    empty = grouping.grouping_agreement(left.limit(0), right.limit(0), "i", "g").first()
    assert empty["jaccard"] == 1.0
    df = spark.createDataFrame([(g, k) for g in "xy" for k in range(7 if g == "x" else 3)], "g string, k int")
    b = {(r["g"], r["k"]): r["batch_name"] for r in grouping.batches(df, "g", "k", 3).collect()}
    assert b["x", 0] == "x-1" and b["x", 3] == "x-2" and b["x", 6] == "x-3" and b["y", 2] == "y"
    m = grouping.majority(spark.createDataFrame([("e", "b", 2), ("e", "a", 1), ("e", None, 0)], "e string, c string, o int"), "e", "c", "o").first()
    assert (m["c"], m["n"]) == ("a", 1)


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 03:30:00", None), ("2024-01-01 05:00:00", 1)], "t string, e int").withColumn("ts", F.to_timestamp("t"))
    assert windows.hopping(df, "ts").count() == 3
    assert windows.sparse_plan(df, "ts", "e is null").count() == 1
    assert windows.sparse_plan(df.limit(0), "ts", "e is null").count() == 0


def test_cohesion(spark):
    from tidemill.functions import cohesion

    cases = [
        ("Zorby Bridge collapse hits Kadin", "Bridge collapse near Kadin kills", 2),
        ("UPDATE: Zorby backs Kadin", "Live - Kadin meets Zorby", 1),
        ("Storm hits Kadin", "Kadin storm", 1),
        ("Storm hits coast", "coast after storm", 0),
        ("People of the year", "Year of people", 0),
        ("One", None, 0),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in df.select("i", cohesion.strength(cohesion.words(F.col("a")), cohesion.words(F.coalesce("b", F.lit("")))).alias("s")).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_passages(spark):
    from tidemill.functions.passages import LIMIT, explode_passages, passages

    assert passages("Dr. Vo met J. Oak at 5 p.m. on Monday. They left. No!  The bridge\nfell down.") == ["Dr. Vo met J. Oak at 5 p.m. on Monday. They left.", "The bridge fell down."]
    assert passages(None) == passages("") == passages(" \n ") == []
    rng = random.Random(2)
    for _ in range(30):
        t = " ".join(rng.choice(["word", "It", "x" * 400, "End.", "Dr.", "next?", "“so,”", "and"]) for _ in range(rng.randint(1, 200)))
        flat, got = " ".join(t.split()), passages(t)
        assert all(q in flat and len(q) <= LIMIT for q in got)
    df = spark.createDataFrame([(1, "A first sentence. A second one."), (2, None)], "k int, t string")
    assert [(r["k"], r["position"], r["quote"]) for r in explode_passages(df, "k", "t").collect()] == [(1, 0, "A first sentence."), (1, 1, "A second one.")]
