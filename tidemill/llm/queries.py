"""The queries of the subpackage, by name; each takes the session and a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import boilerplate, components, encoding, history, leakage, mojibake, repeated_lines, residue, subjects
from tidemill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.RepeatedLines(table(spark, d, "article_texts")).lines().select(F.col("doc").alias("article_id"), "line_no").distinct()


def p1_blocks(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.RepeatedLines(table(spark, d, "article_texts")).report()


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.RepeatedLines(table(spark, d, "article_texts")).cleaned().select("article_id", "source_id", "content_text", "lines_removed")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return components.event_groups(table(spark, d, "deduplication_reviews"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return components.all_event_groups(table(spark, d, "deduplication_reviews"), table(spark, d, "articles"), table(spark, d, "article_digests"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.Residue(table(spark, d, "article_texts"), table(spark, d, "articles")).cases().select(F.col("doc").alias("article_id"))


def p7_unseen_hosts(spark: SparkSession, d: str) -> DataFrame:
    return residue.Residue(table(spark, d, "article_texts"), table(spark, d, "articles")).validation()


def _page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of web pages that hold an article."""
    return boilerplate.marked(table(spark, d, "article_texts"), table(spark, d, "articles"), "extractor = 'readability'")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    lines = _page_lines(spark, d).select("article_id", F.posexplode("own").alias("i", "own"))
    return lines.filter("own = 0").select("article_id", (F.col("i") + 1).cast("int").alias("line_no")).distinct()


def p6_main_text(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.own_text(_page_lines(spark, d)).select("article_id", F.col("own_text").alias("content_text"), F.size(F.filter("own", lambda x: x == 0)).alias("lines_removed"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.Subjects(table(spark, d, "documents"), table(spark, d, "subject_labels")).found()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and their summed shares by subject."""
    shares = subjects.Subjects(table(spark, d, "documents"), table(spark, d, "subject_labels")).shares()
    return shares.groupBy("subject_id").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum("share"), 3).alias("share_sum"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = mojibake.repaired(table(spark, d, "articles"), table(spark, d, "article_fingerprints"))
    return out.filter("state != 'sound'").select("ingest_seq", "field").distinct()


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected values as they are and as they were, as far as they can be restored."""
    out = mojibake.repaired(table(spark, d, "articles"), table(spark, d, "article_fingerprints"))
    return out.filter("state != 'sound'").select("ingest_seq", "field", "value", F.when(F.col("state") == "restored", F.col("restored")).alias("restored"), "proven")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repetitions(table(spark, d, "articles"), table(spark, d, "article_texts")).distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_blocks, p1_cleaned, p2_found, p4_found, p4_groups, p5_found, p5_restored, p6_found, p6_main_text, p7_found, p7_unseen_hosts, p8_ids, p9_found, p10_found, p10_composition)}
