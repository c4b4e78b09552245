"""Passages that can be quoted: sentences of a text, joined where one needs the one before, cut where one is long.

Defined results: null, empty and blank texts have no passage; a passage is always a part of the text with its white
space collapsed, and at most ``LIMIT`` characters; every sentence of at least ``LEAST`` characters is in some passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Most characters of a passage, least length of a cut piece, least overlap of pieces, least characters of a sentence.
LIMIT, PIECE, OVERLAP, LEAST = 320, 160, 64, 8

# Abbreviations a sentence doesn't end with; words that point back to the sentence before.
ABBREVIATIONS = frozenset("mr mrs ms dr prof st gen sen rep gov lt col sgt capt rev hon jr sr inc ltd co corp no vs etc jan feb mar apr jun jul aug sep sept oct nov dec e.g i.e u.s u.k u.n a.m p.m".split())
BACKWARD = frozenset("he she it they this that these those his her its their such both".split())
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s)")


def sentences(text: str) -> list[tuple[int, int]]:
    """Ranges of the sentences of a text with collapsed white space."""
    out, begin = [], 0
    for m in _END.finditer(text):
        word = text[begin : m.start()].rsplit(" ", 1)[-1].lstrip("\"'“‘«(").lower()
        following = text[m.end() + 1 : m.end() + 2]
        if text[m.start()] == "." and (word in ABBREVIATIONS or (len(word) == 1 and word.isalpha())) or following.islower():
            continue
        out.append((begin, m.end()))
        begin = m.end() + 1
    if begin < len(text):
        out.append((begin, len(text)))
    return out


def passages(text: str | None) -> list[str]:
    flat = " ".join((text or "").split())
    joined: list[tuple[int, int]] = []
    for a, b in sentences(flat):
        first = re.match(r"\W*(\w+)", flat[a:b])
        if joined and first and first.group(1).lower() in BACKWARD and b - joined[-1][0] <= LIMIT:
            joined[-1] = (joined[-1][0], b)
        elif b - a >= LEAST:
            joined.append((a, b))
    out = []
    for a, b in joined:
        while b - a > LIMIT:
            cut = flat.rfind(" ", a + PIECE, a + LIMIT + 1)
            cut = cut if cut > 0 else a + LIMIT
            out.append(flat[a:cut])
            again = flat.rfind(" ", a + 1, max(a + 2, cut - OVERLAP + 1))
            a = again + 1 if again > a else cut - OVERLAP
        out.append(flat[a:b])
    return out


def explode_passages(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, position and quote of every passage."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [passages(t) for t in b[1].to_pylist()]
            row = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            yield pa.RecordBatch.from_arrays([b[0].take(row), pa.array([k for f in found for k in range(len(f))], pa.int32()), pa.array([q for f in found for q in f], pa.string())], [key, "position", "quote"])

    return df.select(df[key], df[text]).mapInArrow(run, f"`{key}` {kind}, position int, quote string")
