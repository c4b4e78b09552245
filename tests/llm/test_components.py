import random

import pytest

pytest.importorskip("tidemill.llm")
from tidemill.llm import components


def brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("shape", ["empty", "chain", "star", "random", "cliques", "dirty"])
def test_against_union_find(spark, shape):
    rng = random.Random(3)
    name = lambda i: f"e{i:04d}é"
    order = list(range(120))
    rng.shuffle(order)
    pairs = {
        "empty": [],
        "chain": [(name(a), name(b)) for a, b in zip(order, order[1:])],
        "star": [(name(500), name(i)) for i in range(80)],
        "random": [(name(rng.randrange(200)), name(rng.randrange(200))) for _ in range(150)],
        "cliques": [(name(10 * c + i), name(10 * c + j)) for c in range(4) for i in range(6) for j in range(6)],
        "dirty": [("a", "a"), (None, "b"), ("c", None), ("d", "c"), ("c", "d"), ("d", "c")],
    }[shape]
    df = spark.createDataFrame(pairs, "x string, y string")
    got = {r["vertex"]: r["group_id"] for r in components.groups(df, "x", "y").collect()}
    assert got == brute(pairs)


def test_event_groups(spark):
    r = spark.createDataFrame([("b", "a", 1), ("a", "b", 0), ("c", "d", None), ("e", "e", 1)], "event_a string, event_b string, should_merge int")
    assert {tuple(x) for x in components.event_groups(r).collect()} == {("a", "a"), ("b", "a")}
    more = spark.createDataFrame([("z",), (None,)], "event_id string")
    assert {tuple(x) for x in components.all_event_groups(r, more).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "e"), ("z", "z")}
