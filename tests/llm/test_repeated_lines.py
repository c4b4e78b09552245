import random
import re
from collections import defaultdict

import pytest

pytest.importorskip("tidemill.llm")
from tidemill.llm import repeated_lines
from tidemill.llm.repeated_lines import MIN_ARTICLES, RepeatedLines, _common, _Intervals


def norm(line):
    return re.sub(r"[\W\d_]+", "", line.lower())


def brute(rows):
    n, df = defaultdict(int), defaultdict(set)
    for i, (_, s, t) in enumerate(rows):
        n[s] += 1
        for line in (t or "").split("\n"):
            if norm(line):
                df[s, norm(line)].add(i)
    hot = {k for k, v in df.items() if len(v) >= MIN_ARTICLES and len(v) >= 0.02 * n[k[0]]}
    return {(a, i + 1) for a, s, t in rows for i, line in enumerate((t or "").split("\n")) if (s, norm(line)) in hot}


def rows():
    rng = random.Random(5)
    site = ["Read more!", "© 2024 Site. All rights", "Share", "Follow us", "— Desk —"]
    out = []
    for k in range(160):
        lines = [f"Own line {k} {''.join(rng.choice('abcdefgh') for _ in range(12))}" for _ in range(rng.randint(0, 4))]
        for s in site[: rng.randint(0, 5)]:
            lines.insert(rng.randint(0, len(lines)), s.upper() if rng.random() < 0.3 else s)
        if rng.random() < 0.3:
            lines += ["Follow us", "Share 12", "Read more"]
        out.append((f"a{k}", rng.choice(["s", "s", "t", None]), "\r\n".join(lines) if k % 3 else "\n".join([*lines, "", "123"])))
    return [*out, ("n", "s", None), ("e", "s", ""), ("l", "t", "x " * 50_000)]


def test_found_and_cleaned(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], "article_id string, source_id string, content_text string, source string, least int")
    op = RepeatedLines(df)
    want = brute(data)
    assert {tuple(r) for r in op.lines().collect()} == want
    cleaned = {r["article_id"]: (r["content_text"], r["lines_removed"]) for r in op.cleaned().collect()}
    for a, _, t in data:
        gone = {i for x, i in want if x == a}
        keep = None if t is None else "\n".join(line for i, line in enumerate(t.split("\n"), 1) if i not in gone)
        assert cleaned[a] == (keep, len(gone))
    assert RepeatedLines(df.limit(0)).lines().count() == 0


def test_blocks_count_documents(spark):
    data = [(f"a{k}", "s", "x\ny\nz\nx\ny") for k in range(4)] + [(f"b{k}", "s", "y\nz") for k in range(3)]
    op = RepeatedLines(spark.createDataFrame(data, "article_id string, source_id string, content_text string"))
    got = sorted((r["block_lines"], r["articles"]) for r in op.report().collect())
    assert (2, 7) in got and (5, 4) in got  # "y z" in all seven, the whole text in four


def brute_blocks(data, depth):
    """Right-maximal blocks of two and more hot lines and the articles they stand in."""
    hot, n = {(a, i) for a, i in brute(data)}, defaultdict(int)
    docs = defaultdict(set)
    for k, (a, s, t) in enumerate(data):
        n[s] += 1
        run = []
        for i, line in enumerate([*(t or "").split("\n"), None], 1):
            if line is not None and not norm(line):
                continue
            if line is not None and (a, i) in hot:
                run.append(norm(line))
                continue
            for x in range(len(run)):
                for y in range(x + 1, min(len(run), x + depth) + 1):
                    docs[s, tuple(run[x:y])].add(k)
            run = []
    count = {b: len(v) for b, v in docs.items() if len(v) >= MIN_ARTICLES and len(v) >= 0.02 * n[b[0]]}
    longer = {(s, b[:-1], c) for (s, b), c in count.items()}
    return sorted((s or "", len(b), c) for (s, b), c in count.items() if len(b) >= 2 and (s, b, c) not in longer)


def test_blocks_against_brute_force(spark):
    data = rows()
    op = RepeatedLines(spark.createDataFrame(data, "article_id string, source_id string, content_text string"))
    assert sorted((r["source_id"] or "", r["block_lines"], r["articles"]) for r in op.report().collect()) == brute_blocks(data, repeated_lines.DEPTH)


def test_one_line_fifty_thousand_times(spark):
    data = [(f"a{k}", "s", "\n".join(["Share this"] * 50_000)) for k in range(3)]
    op = RepeatedLines(spark.createDataFrame(data, "article_id string, source_id string, content_text string"))
    assert op.lines().count() == 150_000
    assert [(r["block_lines"], r["articles"]) for r in op.report().collect()] == [(repeated_lines.DEPTH, 3)]
    assert {(r["content_text"], r["lines_removed"]) for r in op.cleaned().collect()} == {("", 50_000)}


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_intervals_across_parts(parts):
    rng = random.Random(parts)
    suffix = sorted({tuple(rng.choice([1, 2, 3]) for _ in range(rng.randint(1, 5))) for _ in range(40)})
    weight = {s: rng.randint(1, 3) for s in suffix}
    total = defaultdict(int)
    cut = [suffix[i * len(suffix) // parts : (i + 1) * len(suffix) // parts] for i in range(parts)]
    for part in cut:
        w = _Intervals()
        for s in part:
            w.add("s", 3, s, weight[s])
        w.close(0, last=True)
        for r in w.take().itertuples():
            total[tuple(r.block)] += r.weight
    want = defaultdict(int)
    for s in suffix:
        for d in range(1, len(s) + 1):
            want[s[:d]] += weight[s]
    # The longest blocks of their intervals; those at the edges of parts come with all their prefixes.
    top = {k: v for k, v in want.items() if v >= 3 and not any(w[:-1] == k and want[w] == v for w in want)}
    got = {k: v for k, v in total.items() if v >= 3}
    assert top.items() <= got.items() <= want.items()
    assert _common((1, 2), (1, 2, 3)) == 2
