"""JSON documents and line logs in and out, and whole-snapshot swaps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file, in any depth of folders; a malformed one has nulls and its text in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def public_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, keys sorted, columns that begin with ``_`` left out."""
    return df.select(F.to_json(F.struct(*sorted(c for c in df.columns if not c.startswith("_")))).alias("json"))


def _rename(fs, old, new) -> bool:
    return bool(fs.rename(old, new))


def swap_snapshot(df: DataFrame, path: str) -> None:
    """Writes beside the old snapshot, then puts the new one in its place by renaming.

    The old snapshot is deleted only when the new one stands in its place; if that fails the old one is put back and
    the call raises. Between the two renames, for a moment, there is no table under ``path``; there is never half of one.
    """
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    here, new, old = (jvm.Path(f"{path}{end}") for end in ("", f".new-{uuid.uuid4().hex[:8]}", f".old-{uuid.uuid4().hex[:8]}"))
    df.write.parquet(new.toString())
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    kept = fs.exists(here)
    if kept and not _rename(fs, here, old):
        fs.delete(new, True)
        raise OSError(f"{path} can't be moved; it is as it was")
    if not _rename(fs, new, here):
        if kept and not _rename(fs, old, here):
            raise OSError(f"the snapshot can't be put in place; the former one is {old.toString()}")
        fs.delete(new, True)
        raise OSError(f"the snapshot can't be put in place; {path} is as it was")
    if kept:
        fs.delete(old, True)
