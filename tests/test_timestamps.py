"""Timestamps against a plain Python reading, and the policy's corner cases."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemill.operators.timestamps import feed_defaults, instant, normalise_published

CASES = [
    ("2024-01-08T13:43:06.249396Z", "America/New_York", "MDY", "ok", "2024-01-08T13:43:06.249396"),
    ("2024-01-13T04:59:29.610173999Z", None, None, "ok", "2024-01-13T04:59:29.610173"),
    ("20240109T120916Z", None, None, "ok", "2024-01-09T12:09:16"),
    ("2024-01-08T01:54+01:00", None, None, "ok", "2024-01-08T00:54:00"),
    ("2024-01-26T05:34:07 +0530", None, None, "ok", "2024-01-26T00:04:07"),
    ("Mon Jan 08 2024 10:49:31 GMT-0500", None, None, "ok", "2024-01-08T15:49:31"),
    ("Tue Jan 08 2024 10:49:31 GMT-0500", None, None, "invalid", None),
    ("Mon, 08 Jan 2024 09:06:03 -0000", None, None, "ok", "2024-01-08T09:06:03"),
    ("Tue, 09 Jan 24 06:54:03 +0000", None, None, "ok", "2024-01-09T06:54:03"),
    ("Wed, 17 Jan 2024 07:51:39 CET", None, None, "ok", "2024-01-17T06:51:39"),
    ("01/11/2024 21:08", "America/New_York", "MDY", "ok", "2024-01-12T02:08:00"),
    ("01/11/2024 21:08", "Europe/London", "DMY", "ok", "2024-11-01T21:08:00"),
    ("23.01.2024 13:02", "Europe/Berlin", "DMY", "ok", "2024-01-23T12:02:00"),
    ("14/13/2024 10:00", "Europe/London", "DMY", "invalid", None),
    ("January 8, 2024 12:04 a.m.", "America/Chicago", "MDY", "ok", "2024-01-08T06:04:00"),
    ("March 15, 2024, 2:56 p.m. EDT", "Asia/Tokyo", "DMY", "ok", "2024-03-15T18:56:00"),
    ("16. Januar 2024, 21:59 Uhr", "Europe/Berlin", "DMY", "ok", "2024-01-16T20:59:00"),
    ("14 de janeiro de 2024 às 18:07", "America/Sao_Paulo", "DMY", "ok", "2024-01-14T21:07:00"),
    ("13 août 2024 à 7h14", "Europe/Paris", "DMY", "ok", "2024-08-13T05:14:00"),
    ("22 апреля 2024, 22:23", "Europe/Moscow", "DMY", "ok", "2024-04-22T19:23:00"),
    ("1704823504", None, None, "ok", "2024-01-09T18:05:04"),
    ("1704684330161", None, None, "ok", "2024-01-08T03:25:30.161"),
    ("2024-10-27 02:30:00", "Europe/Berlin", "DMY", "ambiguous", None),
    ("2024-03-31T02:30:00", "Europe/Berlin", "DMY", "nonexistent", None),
    ("2024-04-07T01:45:00", "Australia/Lord_Howe", "DMY", "ambiguous", None),
    ("2024-10-27 02:30:00 +01:00", "Europe/Berlin", "DMY", "ok", "2024-10-27T01:30:00"),
    ("2024-01-08 10:00:00", None, "DMY", "unknown", None),
    ("2024-01-08 10:00:00", "Mars/Olympus", "DMY", "unknown", None),
    ("2024-02-30 10:00:00", "Europe/Berlin", "DMY", "invalid", None),
    ("2024-01-08 24:00:00", "Europe/Berlin", "DMY", "invalid", None),
    ("13/01/2024 13:05 pm", "Europe/Berlin", "DMY", "invalid", None),
    ("0000-00-00 00:00:00", "Europe/Berlin", "DMY", "invalid", None),
    ("2024-01-18", "Europe/Berlin", "DMY", "unknown", None),
    ("13 March", "Europe/Berlin", "DMY", "unknown", None),
    ("02:49", "Europe/Berlin", "DMY", "unknown", None),
    ("22 min ago", "Europe/Berlin", "DMY", "unknown", None),
    ("Invalid Date", "Europe/Berlin", "DMY", "unknown", None),
    ("", "Europe/Berlin", "DMY", "missing", None),
    ("   ", "Europe/Berlin", "DMY", "missing", None),
    (None, "Europe/Berlin", "DMY", "missing", None),
    ("x" * 50_000, "Europe/Berlin", "DMY", "unknown", None),
]


def _us(text):
    return None if text is None else (datetime.fromisoformat(text).replace(tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def test_cases(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, t string, z string, o string")
    got = {r["i"]: (r["r"]["status"], r["r"]["us"]) for r in df.select("i", instant(F.col("t"), F.col("z"), F.col("o")).alias("r")).collect()}
    for i, c in enumerate(CASES):
        assert got[i] == (c[3], _us(c[4])), c


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo", "Australia/Lord_Howe"])
def test_local_times_against_zoneinfo(spark, zone):
    z = ZoneInfo(zone)
    days = [datetime(2024, m, d) for m, d in ((3, 10), (3, 31), (4, 7), (10, 6), (10, 27), (11, 3), (7, 1))]
    local = [d + timedelta(minutes=k) for d in days for k in range(0, 300, 15)]
    df = spark.createDataFrame([(i, t.strftime("%Y-%m-%d %H:%M:%S")) for i, t in enumerate(local)], "i int, t string")
    got = {r["i"]: (r["r"]["status"], r["r"]["us"]) for r in df.select("i", instant(F.col("t"), F.lit(zone), F.lit("DMY")).alias("r")).collect()}
    for i, t in enumerate(local):
        us = {int(t.replace(tzinfo=z, fold=f).timestamp()) * 1_000_000 for f in (0, 1)}
        real = {u for u in us if datetime.fromtimestamp(u // 1_000_000, z).replace(tzinfo=None) == t}
        want = ("ok", real.pop()) if len(real) == 1 else ("ambiguous" if real else "nonexistent", None)
        assert got[i] == want, (zone, t)


def test_rows_are_kept_and_feeds_can_be_missing(spark):
    a = "ingest_seq bigint, article_id string, source_id string, published_at string, publish_date_estimated int, time_zone string"
    rows = [(1, "a", "s", "2024-07-01 10:00:00", 1, "clash"), (1, "a", "s", "2024-07-01 10:00:00", 1, "clash"), (2, "b", None, "2024-07-01 10:00:00", 0, None), (3, None, "t", None, None, None)]
    feeds = spark.createDataFrame([("s", '{"time_zone": "Europe/Paris", "date_order": "DMY"}', "2024"), ("s", '{"time_zone": "Asia/Tokyo", "date_order": "DMY"}', "2023"), (None, "{}", "2024"), ("t", "not json", None)], "source_id string, config_json string, updated_at string")
    out = normalise_published(spark.createDataFrame(rows, a), feeds).collect()
    assert sorted((r["ingest_seq"], r["published_status"], r["publish_date_estimated"]) for r in out) == [(1, "ok", 1), (1, "ok", 1), (2, "unknown", 0), (3, "missing", None)]
    assert {str(r["published_ts"]) for r in out if r["ingest_seq"] == 1} == {"2024-07-01 08:00:00"}
    assert normalise_published(spark.createDataFrame([], a), feeds.limit(0)).count() == 0
    assert feed_defaults(feeds).count() == 2
