"""Encoding, leakage, garbled text, boilerplate, residue and subjects on small fixtures."""

import random

import numpy as np
import pytest

pytest.importorskip("tidemill.llm")
from tidemill.llm import boilerplate, encoding, leakage, mojibake, residue, subjects

PATH = f"{encoding.TOKENIZERS}/{encoding.NAME}"


def test_bpe_equals_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=encoding.Vocabulary(PATH).ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", "Hello world", " <|endoftext|> ", "né naïve 漢字 👩‍🚀\t\n\n  x", "a" * 5000, "'s don't 12345"] + ["".join(rng.choice("ab éß漢 \n1") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*texts, None])], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encoding.encode(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == enc.encode_ordinary(t), repr(t[:50])
        assert encoding.decode(got[i], PATH) == t
    assert got[len(texts)] == []
    assert encoding.encode(df.limit(0)).count() == 0


def test_tokens_equal_a_plain_loop():
    import re

    import pyarrow as pa

    from tidemill.llm import tokens

    rng = random.Random(12)
    texts = [None, "", "\n", "x", "É a\u0301b c"] + ["".join(rng.choice("abÀß漢é12 .!?\n\r_-\u200b😀") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    seen, lines, n = {}, {}, 0
    for b in tokens.pieces([batch.slice(0, 7), batch.slice(7)], "t"):
        f = tokens.Flat(b["t"])
        start, end = f.runs(tokens.LETTER | tokens.DIGIT)
        got = [[] for _ in range(b.num_rows)]
        for r, a, e, h in zip(f.row_of(start), start, end, f.hashes(start, end).tolist()):
            word = "".join(map(chr, f.points[a:e]))
            got[r].append(word)
            assert seen.setdefault(h, word) == word
        assert got == [re.findall(r"[a-zàß漢é12\u00e1]+", (t or "").lower()) for t in b["t"].to_pylist()]
        hashes, some, per = tokens.line_hashes(b["t"])
        flat = [re.sub(r"[\W\d_]", "", x.lower()) for t in b["t"].to_pylist() for x in (t or "").split("\n")]
        assert per.tolist() == [(t or "").count("\n") + 1 for t in b["t"].to_pylist()]
        for h, s, x in zip(hashes.tolist(), some.tolist(), flat):
            assert s == bool(x) and (not s or lines.setdefault(h, x) == x)
        n += b.num_rows
    assert n == len(texts) and len(set(seen.values())) == len(seen) and len(set(lines.values())) == len(lines)


def _words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_leakage_against_truth(spark):
    rng = random.Random(2)
    items = [(i, " ".join(_words(rng, rng.randint(60, 140)))) for i in range(12)] + [(90, "one two three four five six"), (91, None), (92, "... !")]
    items.append((93, items[0][1]))
    docs, want = [], set()
    for k in range(120):
        w = _words(rng, rng.randint(20, 120))
        i, passage = items[rng.randrange(12)]
        p = passage.split()
        part = rng.choice([0, 0.2, 0.45, 0.8])
        n = int(len(p) * part)
        if n:
            a = rng.randrange(len(p) - n + 1)
            piece = p[a : a + n]
            for q in rng.sample(range(n), min(n // 14, 3)):
                piece[q] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() + rng.choice(["", ",", "\n", "."]) for x in piece]
            if part >= 0.45:
                want |= {(k, i)} | ({(k, 93)} if i == 0 else set())
        docs.append((k, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "ONE, two three"), (503, "x " * 60_000)]
    want.add((502, 90))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {tuple(r) for r in leakage.find(d, spark.createDataFrame(items, "item_id bigint, passage string")).collect()}
    assert got == want
    assert leakage.find(d.limit(0), spark.createDataFrame(items, "item_id bigint, passage string")).count() == 0
    assert leakage.find(d, spark.createDataFrame([], "item_id bigint, passage string")).count() == 0


def test_edited_over_an_added_word():
    p = np.arange(40)
    doc = np.concatenate([[99], p[:10], [77], p[10:20], [78]])
    assert leakage.edited(doc, p, 20, 1) and not leakage.edited(doc, p, 25, 1)
    assert leakage.edited(np.delete(p, [5, 15]), p, 20, 0) and not leakage.edited(p[::2], p, 20, 0)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_stretches_at_the_threshold(spark, edits):
    rng = random.Random(edits)
    items = [(i, " ".join(_words(rng, 60))) for i in range(40)]
    docs = []
    for k in range(200):
        p = items[k % 40][1].split()
        n = 20 + rng.randint(2, 4)
        a = rng.randrange(60 - n + 1)
        piece = p[a : a + n]
        for q in rng.sample(range(1, n - 1), edits):
            piece[q] = "changed"
        docs.append((k, " ".join([*_words(rng, 20), *piece, *_words(rng, 20)])))
    # Stretches that are too short or changed too much are none.
    docs += [(1000 + k, " ".join([*_words(rng, 20), *items[k % 40][1].split()[5:21], *_words(rng, 20)])) for k in range(40)]
    docs += [(2000 + k, " ".join(w if q % 3 else "other" for q, w in enumerate(items[k % 40][1].split()))) for k in range(40)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {tuple(r) for r in leakage.find(d, spark.createDataFrame(items, "item_id bigint, passage string")).collect()}
    want = {(k, k % 40) for k in range(200)}
    assert got <= want and len(got) >= 0.95 * len(want)


def _scores(texts):
    n = {}
    for t in texts:
        c = mojibake.codes(t)
        for s in mojibake.slots(c):
            n[int(s)] = n.get(int(s), 0) + 1
        for x in c & 0xFFFF:
            n[-1 - int(x)] = n.get(-1 - int(x), 0) + 1
    return mojibake.Scores(np.array(list(n)), np.array(list(n.values())))


SOUND = ["Près de Zürich, la séance a coûté 12 couronnes – « une dépense », dit-il.", "Für Köln überraschend: die Prüfung nach drei Tagen", "A decisão será tomada em São João, após 23 horas.", "Через три дня в городе новый план: приложение.", "“Nobody asked,” she wrote, adding that the café’s list was long.", "Why the river’s level worries Malmö Council"] * 30


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp437", "mac_roman", "cp1250"])
def test_round_trips(wrong):
    score = _scores(SOUND)
    tried = restored = 0
    for t in dict.fromkeys(SOUND):
        try:
            bad = t.encode().decode(wrong)
        except UnicodeDecodeError:
            continue
        tried += 1
        state, back = mojibake.repair(bad, score)
        assert state != "sound"
        restored += back == t
    assert restored >= tried - 1


def test_sound_and_lost():
    score = _scores(SOUND)
    for t in [*dict.fromkeys(SOUND), "Why Malmö waits №4", "Council split / Ðórvík", "Lists – SÃO VARÃO", "l&amp;rsquo;été", "Why? ???", "20 °C"]:
        assert mojibake.repair(t, score)[0] == "sound", t
    for t in ["F�r K�ln �berraschend", "F?r K?ln ?berraschend: die Pr?fung", "Why the river\x92s level worries"]:
        assert mojibake.repair(t, score)[0] != "sound", t


def test_garbled_values_of_tables(spark):
    rows = [(i, f"a{i}", t, None if i % 2 else "") for i, t in enumerate(SOUND)] + [(900, "x", "Für Köln".encode().decode("cp1252"), None), (901, None, None, None)]
    a = spark.createDataFrame(rows, "ingest_seq bigint, article_id string, headline string, summary string")
    p = spark.createDataFrame([], "article_id string, headline_hash string, summary_hash string")
    lost = spark.createDataFrame([(902, "y", "K?ln wartet auf die Pr?fung", None), (903, "z", "F\ufffdr drei Tage", None)], a.schema)
    a = a.union(lost)  # no hash is known; letters are lost in two values
    got = {r["ingest_seq"]: (r["state"], r["restored"]) for r in mojibake.repaired(a, p).collect()}
    assert got[902][0] == got[903][0] == "damaged"
    assert got[900] == ("restored", "Für Köln") and all(s == "sound" for k, (s, _) in got.items() if k < 900)
    assert mojibake.repaired(a.limit(0), p).count() == 0


def test_own_lines():
    page = ["Menu  Search  Log in", "News › A headline of another story", "By Jo Desk", "", "The council moved its office from the old town to the harbour after long complaints.", "Harbour office: who answers", "It cost the town 4,000 crowns a week and left the square with a rare silence, they said.", "- Oldtown: 29", "Related stories", "1. Why the bridge worries the trust", "After 9 weeks, the town gets its bridge", "{{ ad_slot_9 }}", "No one would say whether the move follows from the plan seen in the spring.", "318 comments", "© 2024 Site"]
    site = {"By Jo Desk", "Related stories", "318 comments", "© 2024 Site"}
    got = boilerplate.own_lines(page, [x in site for x in page])
    assert got == [0, 0, 0, -1, 1, 1, 1, 1, 0, 0, 0, 0, 1, 0, 0]
    assert boilerplate.own_lines([""], [False]) == [-1]
    assert boilerplate.own_lines(["x " * 100_000], [False]) == [1]


def test_windows_decide_every_line(monkeypatch):
    text = ["The council moved its office from the old town to the harbour after long complaints."] * 3
    notice = "We and our partners store cookies on your device. " * 4 + "Read our privacy notice, change your preferences or withdraw your consent at any time. " * 3
    assert len(notice) > 400 and boilerplate.own_lines(["Menu of the day", notice, "Short head", *text], [False] * 6) == [0, 0, 0, 1, 1, 1]
    tag = "<div data-x='" + "y" * 2_000 + "'>Menu</div>"
    page = [tag, "A headline that leads elsewhere", "Another headline that leads elsewhere", text[0], "A heading of this text here", text[0], "- North: 12", "- South: 4", "A headline that leads elsewhere", "Another one of these here", text[0], "A heading after it all"]
    own = [0, 0, 0, 1, 1, 1, 1, 1, 0, 0, 1, 1]
    assert boilerplate.own_lines(page, [False] * 12) == own
    # A row that stands in no surge is foreign, whatever its form.
    assert boilerplate.own_lines(["- N: 1", "A headline that leads elsewhere"], [False, False]) == [0, 0]
    monkeypatch.setattr(boilerplate, "SURGE", float("inf"))
    assert not any(x == 1 for x in boilerplate.own_lines(page, [False] * 12))


def _articles(spark, n=160):
    rng = random.Random(8)
    topic = _words(rng, 60)
    rows, texts, bad = [], [], set()
    for k in range(n):
        title = " ".join(rng.sample(topic, 6))
        text = "\n".join(" ".join(rng.sample(topic, 6) + title.split() + rng.sample(topic, 6)) + "." for _ in range(4))
        if k % 8 == 0:
            text = rng.choice([f"Error 404\nNothing lives here. Ref {k}", "{{ headline }}\n{{ body }}", "Please enable JavaScript to continue.", "Access denied\nTick the box.", "Lorem ipsum dolor consec adipis elitum veniam irure cillum fugiat."])
            bad.add(f"a{k}")
        rows.append((k, f"a{k}", title, '{"http_status": 200}', f"https://h{k % 9}.example/{k}"))
        texts.append((f"a{k}", f"s{k % 9}", text))
    rows += [(n, None, "x", None, None)]
    texts += [("empty", "s1", ""), ("null", None, None)]
    return spark.createDataFrame(rows, "ingest_seq bigint, article_id string, headline string, collection_json string, url string"), spark.createDataFrame(texts, "article_id string, source_id string, content_text string"), bad | {"empty", "null"}


def test_residue(spark):
    a, t, bad = _articles(spark)
    assert {r["doc"] for r in residue.Residue(t, a).cases().collect()} == bad
    only = t.filter("article_id in ('empty', 'a1')")
    assert {r["doc"] for r in residue.Residue(only, a).cases().collect()} == {"empty"}  # no label but one: the weak labels decide
    assert residue.Residue(t.limit(0), a).cases().count() == 0


def test_validation_counts_all_texts_of_unseen_hosts(spark):
    a, t, _ = _articles(spark, residue.SAMPLE + 1_000)
    want = {}
    for r in residue.inputs(t, a).filter(residue._unseen()).collect():
        label, phrase = residue.weak_label(r["text"], r["status"])
        if label is not None:
            want[int(label), int(phrase)] = want.get((int(label), int(phrase)), 0) + 1
    got = {(r["label"], r["phrase"]): (r["texts"], r["agreed"]) for r in residue.Residue(t, a).validation().collect()}
    assert want and {k: n for k, (n, _) in got.items()} == want and all(n == k for n, k in got.values())


def test_hosts_are_those_of_the_addresses(spark):
    rows = [(1, "a", "t", None, "https://user@WWW.News.example:443/x?y"), (2, "b", "t", "{}", "news.example"), (3, "c", "t", "x", None)]
    a = spark.createDataFrame(rows, "ingest_seq bigint, article_id string, headline string, collection_json string, url string")
    assert {r["article_id"]: r["host"] for r in residue.titles(a).collect()} == {"a": "www.news.example", "b": "news.example", "c": None}


def test_subjects(spark):
    rng = random.Random(4)
    terms = {"law": ["court", "plea", "jury", "verdict"], "sport": ["match", "league", "coach", "goal"], "music": ["song", "opera", "choir", "tune"]}
    frame, names = ["The {} told {} about the {} there.", "After weeks the {} of {} met the {} again."], _words(rng, 400)
    docs, labels, truth = [], [], {}
    for k in range(300):
        own = rng.sample(sorted(terms), rng.choice([1, 1, 2]))
        s = [rng.choice(frame).format(rng.choice(terms[x]), rng.choice(names), rng.choice(terms[x])) for x in own for _ in range(5)]
        docs.append((k, " ".join(s)))
        truth[k] = set(own)
        if k % 3 == 0:
            labels += [(k, x) for x in own[: rng.choice([1, 2])]]
    docs += [(900, None), (901, ""), (902, "Nothing known here."), (903, " ")]
    labels += [(12345, "law"), (0, None)]
    op = subjects.Subjects(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, subject_id string"))
    out = op.found().collect()
    assert abs(np.linalg.norm(op.centres, axis=1) - 1).max() < 1e-3 and 3 <= len(op.centres) <= subjects.LEAVES
    op.mixtures = np.full_like(op.mixtures, 1 / 3)  # the leaves' mixtures alone decide
    assert {r["subject_id"] for r in op.found().collect()} in (set(), set(terms)) and {tuple(r) for r in op.found().collect()} != {tuple(r) for r in out}
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], set()).add(r["subject_id"])
    right = sum(got.get(k) == v for k, v in truth.items())
    assert right >= 0.95 * len(truth) and not any(k >= 900 for k in got)
    none = subjects.Subjects(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, subject_id string"))
    assert none.found().count() == 0
