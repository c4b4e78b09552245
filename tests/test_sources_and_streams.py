"""Feed and page sources, JSON documents, snapshot swaps, and streams against their batch forms."""

import os

import pytest
from pyspark.sql import functions as F

from tidemill.sources import documents, feeds, pages
from tidemill.streaming import incremental

RSS = b"""<?xml version="1.0" encoding="utf-8"?><rss><channel><item><guid>g1</guid><title>One</title><link>https://h.example/1</link><pubDate>Mon, 08 Jan 2024 09:06:03 GMT</pubDate><category>b</category><category>a</category></item><item><title>Two</title></item></channel></rss>"""
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>x</id><title>Élan</title><link href="https://h.example/x"/><updated>2024-01-01T00:00:00Z</updated></entry></feed>'.encode("utf-16")


def test_feeds(spark):
    rows = [("a", RSS), ("b", ATOM), ("c", None), ("d", b"<!DOCTYPE x><rss/>"), ("e", b"<rss><item>"), ("f", b"<rss/>")]
    out = feeds.entries(spark.createDataFrame(rows, "source_id string, body binary")).collect()
    by = {}
    for r in out:
        by.setdefault(r["source_id"], []).append(r)
    assert [r["headline"] for r in by["a"]] == ["One", "Two"] and by["a"][0]["tags"] == ["a", "b"]
    assert by["b"][0]["headline"] == "Élan" and by["b"][0]["url"] == "https://h.example/x"
    assert all(by[k][0]["error"] for k in "cde") and "f" not in by


@pytest.mark.parametrize("pad", ["", " "])
def test_one_byte_feeds_of_even_and_odd_length(pad):
    raw = f"<rss><channel><item><title>Caf\u00e9 \u2013 {pad}</title></item></channel></rss>"
    declared = f'<?xml version="1.0" encoding="windows-1252"?>{raw}'.encode("cp1252")
    assert feeds.parse(declared)[0]["headline"] == "Caf\u00e9 \u2013"
    assert feeds.parse(raw.replace("\u2013", "-").encode("latin-1"))[0]["headline"] == "Caf\u00e9 -"
    assert feeds.decode(b"plain \xff") == "plain \xff".encode("latin-1").decode("utf-8", "replace")


@pytest.mark.parametrize("failing", [1, 2])
def test_a_failing_rename_loses_nothing(spark, tmp_path, monkeypatch, failing):
    path, calls, rename = str(tmp_path / "snap"), [], documents._rename
    documents.swap_snapshot(spark.range(3), path)
    monkeypatch.setattr(documents, "_rename", lambda *x: False if calls.append(x) or len(calls) == failing else rename(*x))
    with pytest.raises(OSError):
        documents.swap_snapshot(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3 and sorted(os.listdir(tmp_path)) == ["snap"]


def test_pages(spark):
    html = '<h2 class="x"><a href="/news/1#c">A headline long enough</a></h2><a href="/news/2">Not in a headline at all</a><h3><a href="https://o.example/news/3">Another host is left out</a></h3><h3><a href="/about/4">Path does not fit here</a></h3><h3><a href="/news/1">A headline long enough</a></h3>'
    df = spark.createDataFrame([("s", "https://h.example/", html), ("t", None, None)], "source_id string, url string, html string")
    assert [(r["url"], r["position"]) for r in pages.entries(df, "^/news/").collect()] == [("https://h.example/news/1", 0)]


def test_documents(spark, tmp_path):
    os.makedirs(tmp_path / "in/2024/01")
    (tmp_path / "in/2024/01/a.json").write_text('{"id": "a", "n": 1}')
    (tmp_path / "in/b.json").write_text("{broken")
    rows = documents.read_json_tree(spark, str(tmp_path / "in"), "id string, n int").collect()
    assert sorted((r["id"], r["_corrupt_record"] is None) for r in rows if r["id"]) == [("a", True)] and len(rows) == 2
    df = spark.range(3)
    for k in (1, 2):
        documents.append_lines(df, str(tmp_path / "log"))
        documents.swap_snapshot(df.limit(k), str(tmp_path / "snap"))
    assert documents.read_lines(spark, str(tmp_path / "log"), "id long").count() == 6
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 2
    assert documents.public_json(df.select(F.lit(1).alias("b"), F.lit(2).alias("a"), F.lit(3).alias("_x")).limit(1)).first()["json"] == '{"a":2,"b":1}'


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_equal_batches(spark, tmp_path, parts):
    rows = [(f"k{i % 5}", f"2024-01-0{1 + i % 3}T0{i % 9}:10:00Z") for i in range(30)]
    df = spark.createDataFrame(rows, "k string, fetched_at string")
    df.repartition(parts).write.parquet(str(tmp_path / "in"))
    counts = incremental.hopping_counts(incremental.read(spark, str(tmp_path / "in"), "k string, fetched_at string", 1), "fetched_at", "30 days")
    incremental.run(counts, str(tmp_path / "c"), "update", incremental.updates(str(tmp_path / "out")))
    got = {(r["window_start"], r["articles"]) for r in incremental.current(spark, str(tmp_path / "out"), "window_start", "window_end").collect()}
    w = df.groupBy(F.window(F.to_timestamp("fetched_at"), "4 hours", "3 hours").alias("w")).count()
    assert got == {(r["s"], r["count"]) for r in w.select(F.unix_seconds("w.start").alias("s"), "count").collect()}
    once = incremental.first_writer(incremental.read(spark, str(tmp_path / "in"), "k string, fetched_at string"), "k", "fetched_at", "30 days")
    incremental.run(once.select("k"), str(tmp_path / "c2"), "append", incremental.updates(str(tmp_path / "out2")))
    assert spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out2")).count() == 5
