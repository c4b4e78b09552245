"""Feed documents to entries: RSS 2.0 and Atom bytes, decoded, checked and parsed in batches.

Defined results: null and empty bytes, bytes that are no markup, documents with a DTD or entity declarations, and
malformed XML give no entries but one row with ``error``; a feed without entries gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Encodings tried in order, each only where the outcome begins like markup.
ENCODINGS = ("utf-8-sig", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-32be", "utf-32le", "latin-1")
SCHEMA = "source_id string, position int, guid string, url string, headline string, summary string, content string, published_at string, tags array<string>, error string"
_DTD = re.compile(r"<!\s*(doctype|entity|element|attlist|notation)\b", re.I)
_LOCAL = re.compile(r"^\{[^}]*\}")


_DECLARED = re.compile(rb"^\s*<\?xml[^>]*\bencoding\s*=\s*[\"']([A-Za-z0-9._-]+)")


def decode(raw: bytes) -> str:
    """By the encoding that the document declares, else by the first that gives markup; else with replacement signs."""
    declared = _DECLARED.match(raw)
    for name in (*((declared[1].decode(),) if declared else ()), *ENCODINGS):
        try:
            text = raw.decode(name)
        except (UnicodeError, LookupError):
            continue
        if "\0" not in text and text.lstrip("\ufeff").strip().startswith("<"):
            return text
    return raw.decode("utf-8", "replace")


def parse(raw: bytes | None) -> list[dict]:
    if not raw:
        raise ValueError("empty")
    text = decode(bytes(raw)).lstrip("﻿")
    if _DTD.search(text):
        raise ValueError("declares a document type or entity")
    root = ElementTree.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", text))
    for x in root.iter():
        x.tag = _LOCAL.sub("", x.tag) if isinstance(x.tag, str) else x.tag
    out = []
    for k, e in enumerate([*root.iter("item"), *root.iter("entry")]):
        first = lambda *names: next((("".join(n.itertext())).strip() for t in names if (n := e.find(t)) is not None and "".join(n.itertext()).strip()), None)  # noqa: B023, E731
        link = next((x.get("href") for x in e.findall("link") if x.get("href") and x.get("rel", "alternate") == "alternate"), None) or first("link")
        tags = sorted({(x.get("term") or x.text or "").strip() for x in e.findall("category")} - {""})
        out.append({"position": k, "guid": first("guid", "id"), "url": link, "headline": first("title"), "summary": first("description", "summary"), "content": first("encoded", "content"), "published_at": first("pubDate", "published", "updated", "date"), "tags": tags})
    return out


def entries(fetched: DataFrame) -> DataFrame:
    """``fetched`` has source_id and body (binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = []
            for source, body in zip(b["source_id"], b["body"]):
                try:
                    rows += [{"source_id": source, "error": None, **e} for e in parse(body)]
                except (ValueError, ElementTree.ParseError) as x:
                    rows.append({"source_id": source, "error": str(x)[:200]})
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype="Int32" if c == "position" else object) for c in cols})

    return fetched.select("source_id", "body").mapInPandas(run, SCHEMA)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Fetched feed documents as files ``<source_id>.xml``."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    return entries(files.select(F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("source_id"), F.col("content").alias("body")))
