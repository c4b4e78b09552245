"""Queries that run a stream to its end and return what it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans.articles import ORACLE as BATCH
from tidemill.session import Scratch, table
from tidemill.streaming import incremental


def s_hopping_windows(spark: SparkSession, d: str) -> DataFrame:
    """The hopping counts of j_hopping_windows over a stream; lateness covers the whole table, as the batch query does."""
    s = Scratch(spark, "stream")
    rows = table(spark, d, "articles").select("ingest_seq", "fetched_at")
    rows.write.parquet(f"{s.root}/in")
    counts = incremental.hopping_counts(incremental.read(spark, f"{s.root}/in", "ingest_seq bigint, fetched_at string"), "fetched_at", "3650 days")
    incremental.run(counts, f"{s.root}/checkpoint", "update", incremental.updates(f"{s.root}/out"))
    return incremental.current(spark, f"{s.root}/out", "window_start", "window_end")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"s_hopping_windows": s_hopping_windows}
ORACLE: dict[str, str] = {"s_hopping_windows": f"SELECT window_start, window_end, articles FROM ({BATCH['j_hopping_windows']})"}
