"""Time functions as column expressions; all times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """The timestamp of ``YYYY-MM-DDTHH:MM:SSZ``; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def floor_hours(ts: Column, hours: int) -> Column:
    step = 3600 * hours
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / step) * step)


def local_hour(ts: Column, zone: str) -> Column:
    return F.hour(F.from_utc_timestamp(ts, zone))
