"""Hopping windows over event time, and which of them there is work in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hours between starts, and of overlap with the next.
STEP, OVERLAP = 3, 1


def hopping(df: DataFrame, ts: str, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """Every row once for each window [start, end) it lies in."""
    w = F.window(ts, f"{step + overlap} hours", f"{step} hours")
    return df.withColumn("w", w).withColumn("window_start", F.col("w.start")).withColumn("window_end", F.col("w.end")).drop("w")


def sparse_plan(df: DataFrame, ts: str, open_rows: str, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """Windows that begin where an open row's hour bucket begins; the overlap alone makes no window."""
    from tidemill.functions.times import floor_hours

    starts = df.filter(open_rows).filter(F.col(ts).isNotNull()).select(floor_hours(F.col(ts), step).alias("window_start")).distinct()
    return starts.select("window_start", (F.col("window_start") + F.expr(f"interval {step + overlap} hours")).alias("window_end"))


def horizon_split(df: DataFrame, ts: str, horizon: str, open_: str, expired: str) -> DataFrame:
    """``next_state``: open rows before the horizon expire, expired ones inside it come back, the rest stays null."""
    at = F.lit(horizon).cast("timestamp")
    return df.withColumn("next_state", F.when(F.expr(open_) & (F.col(ts) < at), "expired").when(F.expr(expired) & (F.col(ts) >= at), "restored"))
