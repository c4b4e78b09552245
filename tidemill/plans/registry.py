"""The core's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.operators import timestamps
from tidemill.plans import articles, events, lifecycle, streams  # noqa: F401 - events and lifecycle add their queries to those of articles
from tidemill.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = timestamps.normalise_published(table(spark, d, "articles"), table(spark, d, "feeds"))
    return out.filter((out.published_status == "ok") & ~out.published_at.rlike(timestamps.CANONICAL)).select("ingest_seq", "published_us").distinct()


def p3_normalised(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise_published(table(spark, d, "articles"), table(spark, d, "feeds"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_normalised)} | articles.QUERIES | streams.QUERIES
ORACLE: dict[str, str] = articles.ORACLE | streams.ORACLE
