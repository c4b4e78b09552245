"""Text decoded with the wrong encoding, found and restored (problem 5).

1. Statistics. Adjacent character pairs are counted over all values that are well formed (no lost letter, control sign or
   sequence that a wrong decoding makes), whatever is known of their hashes, and scored by their mutual information; a pair that such
   text never has gets ``UNSEEN``. Counts are kept by hashed pair in a table of fixed size.
2. Runs. In a value that is not known to be sound, the maximum-scoring segments of improbability are
   isolated, so that a long sound text doesn't hide a short damaged run.
3. Inverse mappings are tried only inside those runs: the run is encoded with the supposed wrong
   encoding and decoded with the right one, up to three times; numeric character references in a run
   are resolved first. A mapping counts if it is possible for the bytes and the outcome is
   more probable by the pair scores. A run in which letters were replaced or lost can't be restored.

Detection and repair need no hashes. Where the hash taken at collection is known it is proof: a value that still
fits it is sound and isn't looked at, and a restored text that fits it is right.

Defined results: null and empty values are sound; sound text with unusual signs, other scripts, a
lone capital with an accent, question marks, or character references of sound text is no case; very
long values are handled in linear time; repeated rows give equal results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the pair table, the score of a pair that sound text never has, and the least score of a run.
SLOTS, UNSEEN, LEAST = 1 << 20, -4.0, 3.0
#: Of the other wrong encodings, which are rare, an outcome must be free of unseen pairs.
USUAL = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437")
#: (wrong, right) encodings tried, most usual first.
INVERSES = (
    ("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1250", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("cp1251", "utf-8"), ("koi8-r", "utf-8"), ("cp866", "utf-8"), ("iso8859-2", "utf-8"), ("iso8859-15", "utf-8"), ("cp1254", "utf-8"), ("mac_cyrillic", "utf-8"), ("cp852", "utf-8"),
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "mac_roman"), ("latin-1", "cp437"), ("cp1252", "cp850"),
)
_REFERENCE = re.compile(r"&#(?:\d{2,6}|[xX][0-9a-fA-F]{2,5});")
_LOST = re.compile(r"�|\?(?=[^\W\d_])|(?<=[^\W\d_])\? (?=[^\W\d_A-ZÀ-ÖØ-Þ])|(?<= )\? (?=[^\W\d_])")
# A sequence that lost its later bytes leaves its first: inside or after a word, before a small letter, or alone.
_CUT = re.compile(r"(?<=[^\W_])[ÂÃÄÅâĂ](?![A-ZÀ-Þ\-])|(?<![\w])Ã(?=[a-zà-ÿ])|(?<![\w])[ÃÂâ](?= |$)|(?<=[a-zà-ÿ])[ÐÑ├┬╨╤√](?=[a-zà-ÿ])")
_CONTROL = re.compile("[\x80-\x9f]")


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def slots(c: np.ndarray) -> np.ndarray:
    """The table slot of every adjacent pair."""
    return ((c[:-1].astype(np.uint64) * np.uint64(0x9E3779B1) ^ c[1:].astype(np.uint64) * np.uint64(0x85EBCA77)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(44)).astype(np.int64)


def pair_counts(sound: DataFrame) -> DataFrame:
    """slot, n over all values of the one column; single characters have slots below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, single = np.zeros(SLOTS, np.int64), np.zeros(1 << 16, np.int64)
        for b in batches:
            c = codes("\n".join(x for x in b[0].to_pylist() if x))
            if len(c) > 1:
                pairs += np.bincount(slots(c), minlength=SLOTS)
                single += np.bincount(c & 0xFFFF, minlength=1 << 16)
        p, s = np.nonzero(pairs)[0], np.nonzero(single)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p, -1 - s])), pa.array(np.concatenate([pairs[p], single[s]]))], ["slot", "n"])

    return sound.mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))


class Scores:
    """Mutual information of pairs; at most ``SLOTS`` + 65,536 numbers whatever the corpus."""

    def __init__(self, slot: np.ndarray, n: np.ndarray):
        self.pairs = np.zeros(SLOTS)
        self.single = np.zeros(1 << 16)
        self.pairs[slot[slot >= 0]] = n[slot >= 0]
        self.single[-1 - slot[slot < 0]] = n[slot < 0]
        self.total = max(1.0, self.pairs.sum())

    def of(self, text: str) -> np.ndarray:
        c = codes(text)
        if len(c) < 2:
            return np.zeros(0)
        n = self.pairs[slots(c)]
        one = np.maximum(1, self.single[c & 0xFFFF])
        with np.errstate(divide="ignore"):
            mi = np.log(np.maximum(n, 1e-9) * self.total / (one[:-1] * one[1:]))
        few = np.minimum(one[:-1], one[1:]) < 5
        return np.where(n <= 0, UNSEEN, np.clip(np.where(few, np.minimum(mi, 0), mi), UNSEEN, 3.0))

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Maximum-scoring segments of improbability, as character ranges."""
        out, total, best, begin, end = [], 0.0, 0.0, 0, 0
        for k, x in enumerate(-self.of(text)):
            if total <= 0:
                total, begin, best = 0.0, k, 0.0
            total += x
            if total > best:
                best, end = total, k + 2
            if total <= 0 or total < best - 12:
                if best >= LEAST:
                    out.append((begin, end))
                total = best = 0.0
        if best >= LEAST:
            out.append((begin, end))
        return out


def _encode(text: str, name: str) -> bytes | None:
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(name)
        except UnicodeEncodeError:
            if 0x80 <= ord(ch) <= 0x9F and name.startswith("cp125"):
                out.append(ord(ch))  # a byte that the encoding leaves undefined came through as it was
            else:
                return None
    return bytes(out)


def _sequences(run: str, wrong: str) -> str | None:
    """The run with every whole UTF-8 sequence in it decoded, and all other characters as they are."""
    raw = [_encode(c, wrong) for c in run]
    out, i, any_ = [], 0, False
    while i < len(run):
        lead = raw[i][0] if raw[i] is not None and len(raw[i]) == 1 else 0
        n = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        got = None
        if n and i + n <= len(run) and all(raw[k] is not None for k in range(i, i + n)):
            try:
                got = b"".join(raw[i : i + n]).decode("utf-8")
            except UnicodeDecodeError:
                pass
        if got is None:
            out.append(run[i])
            i += 1
        else:
            out.append(got)
            any_ = True
            i += n
    return "".join(out) if any_ else None


def _inverse(run: str, score: Scores) -> str | None:
    """The run before the wrong decoding, if one mapping makes its pairs more probable."""
    before = score.of(run)
    unseen, here = int((before <= UNSEEN).sum()), float(before.sum())
    if _CONTROL.search(run) and all(ord(c) < 0x80 or ord(c) > 0x9F or c.encode("latin-1").decode("cp1252", "ignore") for c in run):
        back = "".join(c.encode("latin-1").decode("cp1252") if 0x80 <= ord(c) <= 0x9F else c for c in run)
        if (score.of(back) <= UNSEEN).sum() < unseen:
            return back
    best, gain = None, 0.0
    for wrong, right in INVERSES:
        if right == "utf-8":
            back = _sequences(run, wrong)
        else:
            raw = _encode(run, wrong)
            back = raw.decode(right, "replace") if raw and len(run) >= 4 and _lettered(run) else None
            if back and not _lettered(back):
                back = None
        if not back or back == run:
            continue
        after = score.of(back)
        left = int((after <= UNSEEN).sum())
        # A chain of wrong decodings gets better only at its end, but shorter at every link.
        chained = right == "utf-8" and wrong in ("cp1252", "latin-1", "cp1250") and re.search("[ÂÃâĂ]", back) and len(back) < len(run) and left < unseen
        if left and right == "utf-8" and wrong not in USUAL:
            continue
        better = float(after.sum()) - here
        if (left * 2 <= unseen or chained) and better > gain:
            best, gain = back, better
            if left == 0:
                break
    return best


def _lettered(s: str) -> bool:
    """Mostly letters outside ASCII: a text in another alphabet, read with a one-byte encoding."""
    odd = [c for c in s if ord(c) > 127]
    return sum(c.isalpha() for c in odd) * 10 >= 9 * len(odd) >= 9 and len(odd) * 2 >= len(s.replace(" ", ""))


def repair(text: str, score: Scores) -> tuple[str, str]:
    """(state, text): sound, restored, or damaged where letters are gone or the outcome is still improbable."""
    state, now = "sound", text
    for _ in range(4):
        runs = score.runs(now)
        if _REFERENCE.search(now):
            plain = _REFERENCE.sub(lambda m: html.unescape(m.group()) if not 0x80 <= _number(m.group()) <= 0x9F else chr(_number(m.group())), now)
            again = _apply(plain, score.runs(plain), score)
            if again is not None:
                state, now = "restored", again
                continue
        changed = _apply(now, runs, score)
        if changed is None:
            break
        state, now = "restored", changed
    x = score.of(now)
    for a, b in score.runs(now):
        for m in (*_LOST.finditer(now, max(0, a - 1), min(len(now), b + 2)), *_CUT.finditer(now, max(0, a - 1), min(len(now), b + 2))):
            k = m.start()
            sides = [x[j] <= UNSEEN for j in (k - 1, k) if 0 <= j < len(x)]
            if now[k] in "\ufffd?" or all(sides):
                return "damaged", now
    if _CONTROL.search(now):
        return "damaged", now
    return state, now


def _number(reference: str) -> int:
    body = reference[2:-1]
    return int(body[1:], 16) if body[0] in "xX" else int(body)


def _apply(text: str, runs: list[tuple[int, int]], score: Scores) -> str | None:
    """The text with every run replaced that an inverse mapping improves; None if none is."""
    out, at, changed = [], 0, False
    for a, b in runs:
        # Whole stretches of characters outside ASCII, so that no sequence is cut.
        while a > at and ord(text[a - 1]) > 127:
            a -= 1
        while b < len(text) and ord(text[b]) > 127:
            b += 1
        if a < at:
            continue
        out.append(text[at:a])
        run = text[a:b]
        back = _inverse(run, score)
        if back is None and len(run) > 8:  # a longer run may hold sound signs beside the damaged ones
            pieces = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x7f]+", run)]
            back, done = "", 0
            for x, y in pieces:
                x0, y0 = max(done, x - 1), min(len(run), y + 1)
                back += run[done:x0] + (_inverse(run[x0:y0], score) or run[x0:y0])
                done = y0
            back += run[done:]
        back = back or run
        changed |= back != run
        out.append(back)
        at = b
    out.append(text[at:])
    return "".join(out) if changed else None


_PAIRED = re.compile("[^\x00-\x7f]{2}")


def well_formed(text: str) -> bool:
    """No lost letter, stray lead sign or control sign, and no sequence that a wrong decoding makes."""
    if _LOST.search(text):
        return False
    if text.isascii():
        return True
    if _CUT.search(text) or _CONTROL.search(text):
        return False
    return not _PAIRED.search(text) or all(_sequences(text, w) is None for w in USUAL)


def _well_formed(values: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([well_formed(x) for x in b["value"].to_pylist()], pa.bool_()))

    return values.mapInArrow(run, "value string")


def values(articles: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """ingest_seq, field, value, known (the hash at collection), sound (it still fits)."""
    prints = fingerprints.select("article_id", "headline_hash", "summary_hash").filter("article_id is not null").dropDuplicates(["article_id"])
    rows = articles.select("ingest_seq", "article_id", "headline", "summary").join(prints, "article_id", "left")
    pair = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col(f"{f}_hash").alias("known"))
    v = rows.select("ingest_seq", F.explode(F.array(pair("headline"), pair("summary"))).alias("x")).select("ingest_seq", "x.*").filter("value is not null and value != ''")
    return v.withColumn("sound", F.coalesce(F.sha2(F.lower("value"), 256) == F.col("known"), F.lit(False)))


def repaired(articles: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """ingest_seq, field, value, state, restored, proven for all values not known to be sound."""
    spark = articles.sparkSession
    v = values(articles, fingerprints)
    counts = pair_counts(_well_formed(v.select("value"))).toArrow()
    table = spark.sparkContext.broadcast(Scores(counts["slot"].to_numpy(), counts["n"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [repair(x, table.value) for x in b["value"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["ingest_seq"], b["field"], b["value"], b["known"], pa.array([s for s, _ in done], pa.string()), pa.array([t for _, t in done], pa.string())], ["ingest_seq", "field", "value", "known", "state", "restored"])

    kind = articles.schema["ingest_seq"].dataType.simpleString()
    out = v.filter("not sound").select("ingest_seq", "field", "value", "known").mapInArrow(run, f"ingest_seq {kind}, field string, value string, known string, state string, restored string")
    return out.select("ingest_seq", "field", "value", "state", "restored", F.coalesce(F.sha2(F.lower("restored"), 256) == F.col("known"), F.lit(False)).alias("proven"))
