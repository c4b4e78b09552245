import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemill.llm")
from tidemill.llm import history as H


def test_address(spark):
    base = "https://news.example/story?section=5&item=10"
    same = ["http://www.news.example/story?item=10&section=5", "https://m.News.Example:443/story/?section=5&item=10&utm_source=feed#top", "https://news.example/story?section=5&item=10&output=amp", "https://news.example/story?section=5&item=10&ref=x&gclid=1#comments?fbclid=2", "https://news.example/story/amp?section=5&item=10"]
    other = ["https://news.example/story?section=5&item=11", "https://news.example/Story?section=5&item=10", "https://blog.news.example/story?section=5&item=10"]
    key = lambda u: spark.createDataFrame([(u,)], "u string").select(H.address(F.col("u")).alias("k")).first()["k"]
    assert {key(u) for u in same} == {key(base)} and key(base) not in {key(u) for u in other} and key(None) is None


def test_common_is_the_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.integers(0, 6, rng.integers(1, 30))
        y = x.copy()
        if len(y) > 3:
            y[rng.integers(0, len(y))] = 99
        t = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1, j + 1] = t[i, j] + 1 if x[i] == y[j] else max(t[i, j + 1], t[i + 1, j])
        got = H.common(x, y)
        assert got in (0, t[-1, -1]) and (got or t[-1, -1] < H.SAME * max(len(x), len(y)))


def fixture(seed, n=140):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts, rows, doc_words = [], [], {}
    for k in range(n):
        kind = rng.random()
        if texts and kind < 0.25:
            w = list(rng.choice(texts))
            for q in rng.sample(range(len(w)), rng.choice([0, 2, 3, len(w) // 3])):
                w[q] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.randint(40, 90))]
        texts.append(w)
        url = f"https://h.example/{rng.randrange(n) if rng.random() < 0.2 else 1000 + k}"
        guid = rng.choice([None, f"g{rng.randrange(n // 2)}", f"own{k}"])
        rows.append((k + 1, f"a{k}", rng.choice("st"), rng.choice([url, None]), url if rng.random() < 0.8 else None, guid))
        if rng.random() < 0.95:
            doc_words[f"a{k}"] = w
    return rows, doc_words


def brute(rows, doc_words):
    """Row by row, with all accepted rows looked at."""

    kept = {}

    def near(x, y):
        """Enough bytes in common chunks, and the words equal in order but for the tolerated share."""
        for w in (x, y):
            if id(w) not in kept:
                b = H.chunked(pa.array(["x"]), np.array([hash_(v) for v in w], np.int64), np.array([len(v) for v in w], np.int64), np.array([len(w)]), "doc")
                kept[id(w)] = dict(zip(b["chunks"][0].as_py(), b["sizes"][0].as_py()))
        a, c = kept[id(x)], kept[id(y)]
        if sum(v for k, v in a.items() if k in c) < H.COVER * max(sum(a.values()), sum(c.values())):
            return False
        ids = {w: i for i, w in enumerate(dict.fromkeys([*x, *y]))}
        return H.common(np.array([ids[w] for w in x]), np.array([ids[w] for w in y])) >= H.SAME * max(len(x), len(y))

    accepted, out = [], set()
    for seq, a, s, u, c, g in rows:
        pages = {x for x in (u, c) if x}
        hit = None
        for seq2, a2, s2, pages2, g2 in accepted:
            w, w2 = doc_words.get(a), doc_words.get(a2)
            if pages & pages2 or (g and g == g2 and s == s2) or (w and w2 and near(w, w2)):
                hit = seq2
                break
        if hit:
            out.add((hit, seq))
        else:
            accepted.append((seq, a, s, pages, g))
    return out


def tables(spark, rows, doc_words):
    a = spark.createDataFrame(rows, "ingest_seq bigint, article_id string, source_id string, url string, canonical_url string, guid string")
    flat = [x for v in doc_words.values() for x in v]
    b = H.chunked(pa.array(list(doc_words), pa.string()), np.array([hash_(x) for x in flat], np.int64), np.array([len(x) for x in flat], np.int64), np.array([len(v) for v in doc_words.values()], np.int64), "doc")
    return a, spark.createDataFrame(pa.Table.from_batches([b]).to_pandas(), f"doc string, {H._OWN}")


def hash_(w):
    import xxhash

    return xxhash.xxh64_intdigest(w.encode()) - (1 << 63)


@pytest.mark.parametrize("seed", [1, 2])
def test_one_batch_against_brute_force(spark, seed):
    rows, words = fixture(seed)
    got = {tuple(r) for r in H.Batch(*tables(spark, rows, words)).decide().collect()}
    assert got == brute(rows, words)


def test_batches_equal_one_batch(spark, tmp_path):
    rows, words = fixture(7, 90)
    past, got = H.History(spark, str(tmp_path)), set()
    for lo, hi in ((0, 30), (30, 60), (60, 90)):
        part = rows[lo:hi]
        b = H.Batch(*tables(spark, part, {r[1]: words[r[1]] for r in part if r[1] in words}), past)
        found = b.decide()
        got |= {tuple(r) for r in found.collect()}
        b.accept(found)
    assert got == brute(rows, words)


def test_hot_group_of_copies_and_empty(spark, monkeypatch):
    monkeypatch.setattr(H, "DIRECT", 8)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows, words = [], {}
    for k in range(90):
        w = list(base)
        for q in rng.sample(range(80), 2):
            w[q] = f"n{k}{q}"
        rows.append((k + 1, f"a{k}", "s", f"https://h.example/{k}", None, None))
        words[f"a{k}"] = w
    got = {tuple(r) for r in H.Batch(*tables(spark, rows, words)).decide().collect()}
    assert got == {(1, k) for k in range(2, 91)}
    a, w = tables(spark, rows, words)
    assert H.Batch(a.limit(0), w).decide().count() == 0


def hot_groups(seed, families=4, n=150):
    """Copies that all share most of a frame: every chunk is hot. The first copy of a family repeats an older address."""
    rng = random.Random(seed)
    frame = [f"f{i}" for i in range(60)]
    bases = [frame + [f"b{f}.{i}" for i in range(30)] for f in range(families)]
    rows, words = [], {}
    for f in range(families):
        rows.append((f + 1, f"z{f}", "s", f"https://h.example/z{f}", None, None))
        words[f"z{f}"] = [f"z{f}.{i}" for i in range(50)]
        w = list(bases[f])
        for q in rng.sample(range(90), 2):
            w[q] = f"y{f}.{q}"
        rows.append((families + f + 1, f"y{f}", "s", f"https://h.example/z{f}", None, None))
        words[f"y{f}"] = w
    for k in range(n):
        w = list(bases[rng.randrange(families)])
        for q in rng.sample(range(90), rng.choice([1, 2, 3])):
            w[q] = f"n{k}.{q}"
        # Some are copies of addresses, too.
        page = f"https://h.example/{k if rng.random() < 0.9 else rng.randrange(n)}"
        rows.append((2 * families + k + 1, f"a{k}", "s", page, None, None))
        words[f"a{k}"] = w
    return rows, words


def in_batches(spark, path, rows, words, cuts):
    past, got = H.History(spark, path), set()
    for lo, hi in zip(cuts, cuts[1:]):
        b = H.Batch(*tables(spark, rows[lo:hi], {r[1]: words[r[1]] for r in rows[lo:hi]}), past)
        found = b.decide()
        got |= {tuple(r) for r in found.collect()}
        b.accept(found)
    return got


def test_hot_group_whose_first_row_is_a_repetition(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "DIRECT", 8)
    rows, words = hot_groups(3, families=1, n=80)
    rows = [r[:3] + (f"https://h.example/{r[1]}", *r[4:]) if r[1][0] == "a" else r for r in rows]
    got = {tuple(r) for r in H.Batch(*tables(spark, rows, words)).decide().collect()}
    assert (1, 2) in got and got == brute(rows, words) and len(got) >= 75
    assert in_batches(spark, str(tmp_path), rows, words, (0, 20, 50, len(rows))) == got


def test_hot_groups_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "DIRECT", 8)
    rows, words = hot_groups(5)
    assert {tuple(r) for r in H.Batch(*tables(spark, rows, words)).decide().collect()} == brute(rows, words)


def test_reopened_history_and_a_lost_batch(spark, tmp_path):
    import os
    import shutil

    rows, words = fixture(7, 90)
    got, path = set(), str(tmp_path / "h")
    for k, (lo, hi) in enumerate(((0, 30), (30, 60), (60, 90))):
        past = H.History(spark, path, buckets=4 + k)  # a path keeps its own number
        assert past.batches == list(range(k)) and past.buckets == 4
        part = rows[lo:hi]
        b = H.Batch(*tables(spark, part, {r[1]: words[r[1]] for r in part if r[1] in words}), past)
        found = b.decide()
        got |= {tuple(r) for r in found.collect()}
        b.accept(found)
        if k == 1:  # the run is lost before the marker of its batch: nothing of it counts, and the batch is done again
            os.remove(f"{path}/_committed/000001")
            shutil.rmtree(f"{path}/texts/batch=1")
            past = H.History(spark, path)
            assert past.batches == [0]
            b = H.Batch(*tables(spark, part, {r[1]: words[r[1]] for r in part if r[1] in words}), past)
            b.accept(b.decide())
    assert got == brute(rows, words)


def test_a_small_batch_reads_its_buckets_only(spark, tmp_path):
    rows, words = fixture(11, 60)
    past = H.History(spark, str(tmp_path / "h"), buckets=64)
    b = H.Batch(*tables(spark, rows[:59], words), past)
    b.accept(b.decide())
    few = spark.createDataFrame([(5,), (6,)], "key bigint")
    read = past.read("keys", few)
    scan = read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1][:300]
    ids = {r[0] for r in few.select(H._bucket("key", 64)).collect()}
    assert "bucket#" in scan and "batch#" in scan and all(str(i) in scan for i in ids) and len(ids) < 3


def test_copies_in_every_chunk_hot_and_rare(spark, monkeypatch):
    """Pairs that share nothing but hot chunks meet, too."""
    monkeypatch.setattr(H, "DIRECT", 8)
    rng = random.Random(4)
    parts = [[f"p{i}.{j}" for j in range(12)] for i in range(6)]
    rows, words = [], {}
    for k in range(160):
        w = [x for i in (sorted(rng.sample(range(6), 4)) if k < 150 else (0, 1, 2, 3)) for x in parts[i]]
        rows.append((k + 1, f"a{k}", "s", f"https://h.example/{k}", None, None))
        words[f"a{k}"] = [*w, f"n{k}"]
    got = {tuple(r) for r in H.Batch(*tables(spark, rows, words)).decide().collect()}
    assert got == brute(rows, words) and len(got) > 100
