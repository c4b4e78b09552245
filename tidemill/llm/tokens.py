"""Words and lines of many texts at once, as 64-bit hashes, by array operations.

The texts of an Arrow column become one array of code points in lower case. A table tells every code
point's class, so that words are maximal runs of classes, found by comparing neighbours. Hashes come from one
running sum of mixed code points times powers of an odd number: the difference of two sums, moved back by the
inverse power, depends on the run's characters alone, wherever it stands.

Defined results: null texts count as empty; a run never goes from one text into the next; very long texts are
handled like others, ``pieces`` only bounds how many texts share an array.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Classes of code points; ``PUNCT`` is everything else that is visible.
LETTER, MARK, DIGIT, SPACE, LINE, END, CLOSE, HIDDEN, PUNCT = (1 << k for k in range(9))
#: Bytes of texts that share an array.
PIECE = 1 << 21

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    out = np.full(0x110000, PUNCT, np.uint16)
    kinds = {"L": LETTER, "M": MARK, "N": DIGIT, "Z": SPACE}
    out[0x20000:0x32400], out[0x32400:], out[0xE0100:0xE01F0] = LETTER, HIDDEN, MARK  # ideographs; nothing; variation selectors
    for k in range(0x20000):
        c = unicodedata.category(chr(k))
        out[k] = HIDDEN if c in ("Cc", "Cf", "Cn", "Cs") else kinds.get(c[0], PUNCT)
    for ch in "\t\v\f\r\x1c\x1d\x1e\x1f\x85":
        out[ord(ch)] = SPACE
    out[ord("\n")] = LINE
    for ch in ".!?…":
        out[ord(ch)] = END
    for ch in "»”“\"')]":
        out[ord(ch)] = CLOSE
    return out


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    grow = lambda b: np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64)))
    return grow(_BASE), grow(_BACK)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class Flat:
    """The texts of a column as one array of code points, those of the classes ``without`` left out; text k reaches from ``bounds[k]`` to ``bounds[k + 1]``."""

    def __init__(self, column: pa.Array, without: int = 0):
        column = pc.utf8_lower(pc.fill_null(column.cast(pa.string()), ""))
        self.rows, self._column = len(column), column
        self.bounds = np.append(0, np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)))
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        data = column.buffers()[2]
        raw = memoryview(data)[int(offsets[0]) : int(offsets[-1])] if data is not None else b""
        self.points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.classes = classes()[self.points]
        if without:
            keep = (self.classes & without) == 0
            if not keep.all():
                self.bounds = np.append(0, np.cumsum(keep))[self.bounds]
                self.points, self.classes = self.points[keep], self.classes[keep]

    def texts(self) -> list[str]:
        """The texts in lower case."""
        return self._column.to_pylist()

    @functools.cached_property
    def _sums(self) -> np.ndarray:
        x = self.points.astype(np.uint64)
        with np.errstate(over="ignore"):
            x = (x + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            x ^= x >> np.uint64(31)
            x *= _powers(_room(len(x)))[0][: len(x)]
            return np.append(np.uint64(0), np.cumsum(x))

    def split(self, kind_of: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and kinds of the longest runs of one kind; ``kind_of`` gives the kinds (from 1) of classes, others are in no run."""
        lut = np.zeros(2 * PUNCT, np.uint8)
        for classes_, kind in kind_of.items():
            for k in range(9):
                if classes_ >> k & 1:
                    lut[1 << k] = kind
        kind = lut[self.classes]
        edge = np.ones(len(kind) + 1, bool)
        if len(kind):
            np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
            edge[self.bounds] = True  # no run goes over the end of a text
        else:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        at = np.nonzero(edge)[0]
        kinds = kind[at[:-1]]
        some = kinds > 0
        return at[:-1][some], at[1:][some], kinds[some]

    def runs(self, kinds: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest runs of the classes ``kinds``."""
        return self.split({kinds: 1})[:2]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the characters from each start to its end."""
        with np.errstate(over="ignore"):
            total = (self._sums[ends] - self._sums[starts]) * _powers(_room(len(self.points)))[1][starts]
            return mix(total + (ends - starts).astype(np.uint64)).view(np.int64)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1

    def sentence_ends(self) -> np.ndarray:
        """Positions of end marks that closing marks, then white space or the text's end follow, and of line breaks."""
        n = len(self.points)
        if not n:
            return np.zeros(0, np.int64)
        over = (self.classes & (END | CLOSE)) == 0
        after = np.where(over, np.arange(n), n)
        after = np.minimum.accumulate(after[::-1])[::-1]
        mark = np.nonzero(self.classes == END)[0]
        to = after[mark]
        last = self.bounds[self.row_of(mark) + 1]
        good = (to >= last) | ((self.classes[np.minimum(to, n - 1)] & (SPACE | LINE)) > 0)
        return np.sort(np.concatenate([mark[good], np.nonzero(self.classes == LINE)[0]]))


def _room(n: int) -> int:
    return max(PIECE, 1 << max(0, n - 1).bit_length())


def line_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every line of the texts, one after another, the hash of its letters; whether it has any; the lines of each text."""
    f = Flat(column)
    letter = f.classes == LETTER
    breaks = np.nonzero(f.classes == LINE)[0]
    per_text = np.diff(np.searchsorted(breaks, f.bounds)) + 1
    # A line ends at a break or with its text.
    ends = np.sort(np.concatenate([breaks, f.bounds[1:]]), kind="stable")
    before = np.append(0, np.cumsum(letter))
    upto = before[ends]
    since = np.append(0, upto[:-1])
    only = Flat.__new__(Flat)
    only.points = f.points[letter]
    return only.hashes(since, upto), upto > since, per_text


def pieces(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts have about ``PIECE`` bytes, but at least one row."""
    for b in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(b[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PIECE, "right")))
            yield b.slice(at, to - at)
            at = to


def lists(values: np.ndarray, per_row: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(per_row)).astype(np.int32), pa.array(values, kind))
