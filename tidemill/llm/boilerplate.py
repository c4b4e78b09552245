"""The article's own lines among the parts of the page around it (problem 6).

Line-block distribution.

1. Markup is stripped: tags, the lines that the site repeats (problem 1) and slots that a template left. A
   stripped line is gone from the sequence of lines.
2. Every line left has a length: the letters of its prose, which reaches to the line's last sentence end or is a
   row of a list. Words of notices (``NOTICE``) shorten it; rows of a list are one block, whose length is that of all, counted twice. A line without prose - a heading, but also a link,
   a menu, a ticker - is a label: its length is ``LABEL`` of its letters, and that of a marked link (number, arrow, age) 0.
3. The lengths are summed over sliding windows: of every line the window that ends with it and the one that
   begins with it, of ``WINDOW`` lines each. Where the sum rises to ``SURGE`` the text surges, where it falls below it dives.
4. Text stands between surge and dive: a line of prose is the article's own if it lies in a surging window, a label only if
   the text has surged before it and does not dive after it, that is if both its windows surge. So a heading between two
   paragraphs is kept; links in a row make each other's windows dive; what stands before the first surge or after the last dive goes.
   The window after a label that a stripped line or the page's end cuts off says nothing; such a label goes with the prose that it touches.

Without a surge (``SURGE`` never reached) no line is kept.

Defined results: null and empty texts have no lines; a text without any surge has no own line;
very long texts and lines are handled in linear time by the same rules; repeated rows give the same lines;
lines of white space are neither own nor foreign.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import repeated_lines, residue, tokens

#: Lines of a window; letters from which it surges; share of a label's letters that count; letters that a word of a notice takes off.
WINDOW, SURGE, LABEL, NOTICE = 2, 40, 0.1, 80
#: Words of the shortest sentence (a question needs twice as many, or a sentence before it), words from which a line is no label, words of a heading that a page cuts off.
SENTENCE, LONG, HEADING = 6, 24, 5
END = ".!?…"

_TAG = re.compile(r"<[^<>]*>")
_SLOT = re.compile(r"^(?:\{\{.*\}\}|\{%.*%\}|<%.*%>|\$\{.*\}|%%.*%%|@@.*@@|\[\[.*\]\]|__.*__)$")
_CLOSE = "»”“\"')]"
_END = re.compile(rf".*[.!?…][{re.escape(_CLOSE)}]*(?=\s)", re.S)
_ITEM = re.compile(r"^[-*•–] [^:]{1,80}: [+-]?[\d.,   ]+ ?%?$")
_LINK = re.compile(r"^(?:›|»|→|\d{1,2}[.)] )|\s\d{1,3} (?:h|min|Std|ч|d)\.?$|\s[▲▼⟶→›|·/]\s|[▲▼]|\d ?°|\S {2,}\S")
# Words of consent and subscription notices.
NOTICES = ("cookie", "privacy", "consent", "opt out", "newsletter", "subscri", "sign up", "sign in", "log in", "terms of use", "third part", "preferences", "datenschutz", "einwilligung", "confidentialité", "privacidad", "javascript", "browser")

GONE, TEXT, ROW, NAME, LINKED, EMPTY = range(6)


def length(line: str, repeated: bool, notices: tuple[str, ...] | list[str] = NOTICES) -> tuple[int, float]:
    """What a line is, and its length after the markup was stripped; ``notices`` are those that the text has at all."""
    raw = line.strip()
    if not raw:
        return EMPTY, 0.0
    if repeated:
        return GONE, 0.0
    s = " ".join((_TAG.sub(" ", raw) if "<" in raw else raw).split())
    if not s or _SLOT.match(raw):
        return GONE, 0.0
    if _ITEM.match(s):
        return ROW, 2.0 * len(s)
    prose = s if s.rstrip(_CLOSE)[-1:] in END else m.group() if (m := _END.match(s)) else ""
    words = prose.count(" ") + 1
    if s.count(" ") >= LONG:  # no label is as long as this
        prose = s
    elif words < SENTENCE or (prose[-1] == "?" and words < 2 * SENTENCE and not _END.match(prose)):
        prose = ""
    if prose:
        low = s.lower() if notices else ""
        return TEXT, float(max(0, len(prose) - NOTICE * sum([low.count(w) for w in notices])))
    if _LINK.search(raw):
        return LINKED, 0.0
    return NAME, LABEL * len(s)


def own_lines(lines: list[str], repeated: list[bool]) -> list[int]:
    """1 for an own line, 0 for a foreign one, -1 for an empty one."""
    low = "\n".join(lines).lower()
    notices = [w for w in NOTICES if w in low]
    kinds = [length(x, r, notices) for x, r in zip(lines, repeated)]
    own = [-1 if k == EMPTY else 0 for k, _ in kinds]
    left = [i for i, (k, _) in enumerate(kinds) if k not in (GONE, EMPTY)]
    size = [kinds[i][1] for i in left]
    for j in range(1, len(left)):  # a list's length so far, then that of the whole list
        if kinds[left[j]][0] == kinds[left[j - 1]][0] == ROW:
            size[j] += size[j - 1]
    for j in reversed(range(1, len(left))):
        if kinds[left[j]][0] == kinds[left[j - 1]][0] == ROW:
            size[j - 1] = size[j]
    before = [sum(size[max(0, j - WINDOW + 1) : j + 1]) >= SURGE for j in range(len(left))]
    after = [sum(size[j : j + WINDOW]) >= SURGE for j in range(len(left))]
    full = [i for i, (k, _) in enumerate(kinds) if k != EMPTY]
    beside = {i: (kinds[a][0] if a is not None else GONE, kinds[b][0] if b is not None else GONE) for a, i, b in zip([None, *full], full, [*full[1:], None])}
    for j, i in enumerate(left):
        if kinds[i][0] in (TEXT, ROW):
            own[i] = int(size[j] > 0 and (before[j] or after[j]))
        else:
            cut = beside[i] in ((TEXT, GONE), (ROW, GONE)) and len(lines[i].split()) >= HEADING
            own[i] = int(kinds[i][0] == NAME and before[j] and (after[j] or cut))
    return own


def flagged(texts: DataFrame, *keep: str, lines: repeated_lines.RepeatedLines | None = None) -> DataFrame:
    """``article_id``, ``keep`` columns, the text, and for each of its lines whether the site repeats it."""
    lines = lines or repeated_lines.RepeatedLines(texts, keep=("content_text", *keep))
    rows = repeated_lines.by_source(lines.rows, lines.covered(), "left")
    hot = F.transform("ids", lambda x: F.coalesce(F.array_contains("covered", x), F.lit(False)))
    return rows.select(F.col("doc").alias("article_id"), *keep, "content_text", hot.alias("hot"))


def scored(rows: DataFrame, model: residue.Residue, articles: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, np.ndarray | None]:
    """``rows`` of ``flagged`` with ``title``, ``status`` and the columns of ``more`` (by article_id), for a task that tells texts
    without an article by the weights as it reads them; where no model could be fitted, such texts are left out here."""
    if model.weights is not None:
        titles = residue.titles(articles)
        titles = titles if more is None else titles.join(more, "article_id")
        return rows.join(titles.hint("shuffle_hash"), "article_id", "left"), model.weights  # the texts need no sort
    left = rows.join(model.cases(), F.col("article_id") == F.col("doc"), "left_anti")
    left = left if more is None else left.join(more, "article_id", "left")
    return left.withColumns({"title": F.lit(None).cast("string"), "status": F.lit(None).cast("int")}), None


def marked(texts: DataFrame, articles: DataFrame, only: str | None = None) -> DataFrame:
    """``article_id``, the text and ``own`` (for each of its lines 1, 0 or -1) of the texts that hold an article.

    ``only`` is a condition on ``extractor``. Scores and lines come from one reading of a text.
    """
    rows = flagged(texts, "extractor")
    rows, weights = scored(rows.filter(only) if only else rows, residue.Residue(texts, articles), articles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.pieces(batches, "content_text"):
            holds = [True] * b.num_rows
            if weights is not None:
                holds = residue.probability(residue.Tokens(b["content_text"]), b["title"].to_pylist(), b["status"].to_pylist(), weights) <= residue.CASE
            b, hot = b.filter(pa.array(holds)), [h for h, k in zip(b["hot"].to_pylist(), holds) if k]
            own = [own_lines(t.split("\n"), h) for t, h in zip(b["content_text"].to_pylist(), hot)]
            yield pa.RecordBatch.from_arrays([b["article_id"], b["content_text"], pa.array(own, pa.list_(pa.int32()))], ["article_id", "content_text", "own"])

    kind = rows.schema["article_id"].dataType.simpleString()
    return rows.select("article_id", "content_text", "hot", "title", "status").mapInArrow(run, f"article_id {kind}, content_text string, own array<int>")


def own_text(m: DataFrame) -> DataFrame:
    """Adds the own lines put together again."""
    lines = F.split("content_text", "\n", -1)
    return m.withColumn("own_text", F.array_join(F.filter(lines, lambda x, i: F.get("own", i) == 1), "\n"))
