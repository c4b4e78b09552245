"""The batch operators over streams: bounded passes with ``availableNow``, results kept in folders.

Every pass reads what is new, updates state by watermark, and writes by batch number, so that a pass that is
repeated after a failure writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.times import instant
from tidemill.operators.windows import OVERLAP, STEP


def read(spark: SparkSession, path: str, schema: str, files_a_pass: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_pass).parquet(path)


def run(df: DataFrame, checkpoint: str, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """One bounded pass over everything that is there."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def hopping_counts(stream: DataFrame, text_ts: str, late: str = "3 days") -> DataFrame:
    """Rows a window, over event time; rows later than ``late`` no longer change a window."""
    at = stream.withColumn("ts", instant(F.col(text_ts))).filter("ts is not null").withWatermark("ts", late)
    w = at.groupBy(F.window("ts", f"{STEP + OVERLAP} hours", f"{STEP} hours").alias("w")).agg(F.count(F.lit(1)).alias("articles"))
    return w.select(F.unix_seconds("w.start").alias("window_start"), F.unix_seconds("w.end").alias("window_end"), "articles")


def first_writer(stream: DataFrame, key: str, text_ts: str, late: str = "3 days") -> DataFrame:
    """Insert-or-ignore by key within the watermark's horizon; state is dropped behind it."""
    return stream.withColumn("ts", instant(F.col(text_ts))).filter("ts is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def updates(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps every batch's updates in a folder of its own."""

    def each(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/{batch:09d}")

    return each


def current(spark: SparkSession, path: str, *key: str) -> DataFrame:
    """Of every key the last update."""
    df = spark.read.option("recursiveFileLookup", True).parquet(path)
    rest = [c for c in df.columns if c not in (*key, "batch")]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")
