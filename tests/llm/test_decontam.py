"""Alignment against a plain version; leaks found, clean texts left alone."""

import random

import numpy as np

from gleanery.llm import decontam
from gleanery.llm.decontam import GAP, MATCH, MISMATCH, align, drop_leaks, leaks, reach


def plain(item, passage):
    h = [[0.0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (MATCH if a == b else MISMATCH), h[i - 1][j] + GAP, h[i][j - 1] + GAP)
    return max(map(max, h)) / (MATCH * len(item))


def test_alignment():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 25))] for _ in "ab")
        assert abs(align(np.array(a), np.array(b))[0] - plain(a, b)) < 1e-9


def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(rng.randint(12, 40)) for _ in range(20)]
    bench = [(i, " ".join(x).capitalize() + ".") for i, x in enumerate(items)] + [(50, "too short item"), (51, None), (0, " ".join(items[0]).capitalize() + ".")]
    docs, leaked = [], set()
    for i in range(300):
        body = text(rng.randint(0, 200))
        if i % 3 == 0:  # item 7 stands in a third of all documents
            k = 7 if i % 9 else rng.randrange(20)
            copy = list(items[k])
            for _ in range(len(copy) // 10 if i % 2 else 0):
                copy[rng.randrange(len(copy))] = "edited"
            body[len(body) // 2 : len(body) // 2] = copy
            leaked.add((i, k))
        docs.append((i, " ".join(body)))
    docs += [(900, None), (901, ""), (902, "w1 " * 60_000 + " ".join(items[3])), (None, " ".join(items[4]))]
    return docs, bench, leaked | {(902, 3), (None, 4)}


def test_leaks(spark):
    docs, bench, want = corpus()
    d, b = spark.createDataFrame([(*x, 1.0) for x in docs], "doc_id long, text string, score double"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(d, b).collect()}
    assert got == want
    kept = drop_leaks(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert leaks(d, b.limit(0)).count() == 0 and drop_leaks(d, b.limit(0)).count() == len(docs)
    assert leaks(d.limit(0), b).count() == 0
    assert leaks(d, b.where("item_id = 50")).count() == 0


def test_nothing_is_broadcast(spark, monkeypatch):
    """Tables too large for a broadcast are joined by key, with the same rows."""
    docs, bench, want = corpus()
    d, b = spark.createDataFrame(docs + docs[:30], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_WORDS", 0)
    got = [(r.doc_id, r.item_id) for r in leaks(d, b).collect()]
    assert set(got) == want and len(got) == len(want)


def test_scripts_without_blanks(spark):
    """A Chinese item with characters changed, a Japanese and a Thai one, and a short one that must stand exactly."""
    items = ["下列哪一项是光合作用的主要产物请选择正确的答案", "これは試験の問題です正しい答えを選んでください", "ข้อใดต่อไปนี้เป็นคำตอบที่ถูกต้อง", "热力学"]
    edited = items[0][:6] + "某" + items[0][7:14] + "甲" + items[0][15:]
    docs = [(0, "前言。" + edited + "。后记"), (1, "序文「" + items[1] + "」"), (2, "abc " + items[2] + " def"), (3, "研究热力学的人"), (4, "热与力之学" * 9), (5, "完全不同的另一段文字没有任何关系" * 5)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(d, b).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_an_alignment_lies_where_it_can_be_reached():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (np.array([rng.randint(0, 6) for _ in range(rng.randint(1, 40))]) for _ in "ab")
        least = rng.choice([0.4, 0.6, 0.8])
        points = least * len(a)
        span = int(len(a) + (len(a) - points) / 0.5 + 1e-9)
        score, end = align(a, b)
        where = reach(a, b, points, span)
        if score >= least - 1e-9:
            assert where
            part = align(a, b[where[0] : where[1]])
            assert (part[0], part[1] + where[0]) == (score, end)


def test_seeds(spark):
    """Of five words three must match: two are among the four rarest. Of twenty, twelve: two are among the ten rarest. Of three that must stand exactly, two."""
    d = spark.createDataFrame([(1, "a b c a x " + "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e"), (2, " ".join(f"w{i}" for i in range(20))), (3, "x y z")], "item_id long, text string")
    items = decontam.items_of(b, 0.6)
    assert {r.item_id: (r.n, r.needed, r.hits, r.span) for r in items.collect()} == {1: (5, 3, 2, 9), 2: (20, 12, 2, 36), 3: (3, 3, 2, 3)}
    key = {r.key: r.item_id for r in items.collect()}
    seeds = {k: {bytes(r.word).decode() for r in decontam.seeds_of(items, d).collect() if key[r.key] == k} for k in (1, 2, 3)}
    assert seeds == {1: set("bcde"), 2: {f"w{i}" for i in range(10, 20)}, 3: set("yz")}


def test_words_in_tasks_are_those_of_the_column(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    texts = ["".join(rng.choice("aZ9 -_\n\x00\u00e9\u00a0\u6f22\u0e01\u3042\U00020001\U0001f600\u0915") for _ in range(40)) for _ in range(200)] + ["", "ABC def"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decontam.words(F.col("t")).alias("w")).collect()
    for r in rows:
        assert [w.decode() for w in decontam.word_list(r.t.encode())] == r.w


def test_recall_against_full_alignment(spark):
    """Edits at every fifth word, at random, inserted between words; common words; short items."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    text = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [text(n) for n in (1, 2, 4, 5, 6, 9, 12, 16, 16, 25, 40) for _ in range(3)] + [["zz", "yy", "xx"]]
    docs = []
    for item in items:
        n = len(item)
        fifth = [w if k % 5 else "edited" for k, w in enumerate(item)]
        spread = [x for k, w in enumerate(item) for x in ([w, "and"] if k % 2 else [w])]
        every = [x for w in item for x in (w, "and")][: n + int(0.7 * n)]
        mixed = [list(item) for _ in range(4)]
        for m in mixed:
            for _ in range(max(1, n // 4)):
                m[rng.randrange(len(m))] = "edited"
            if len(m) > 4:
                del m[rng.randrange(len(m))]
        docs += [" ".join(text(rng.randint(0, 30)) + x + text(30)) for x in (item, fifth, spread, every, *mixed)]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for d in docs + [" ".join(x) for x in items] for w in d.split()))}
    coded = lambda ws: np.array([number[w] for w in ws])
    want = {}
    for i, item in enumerate(items):
        for d, doc in enumerate(docs):
            score = align(coded(item), coded(doc.split()))[0]
            if score >= (0.6 if len(item) >= 5 else 1.0) - 1e-9:
                want[d, i] = round(score, 9)
    five = lambda ws: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}
    assert sum(not five(items[i]) & five(docs[d].split()) for d, i in want) > 30
    d, b = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in leaks(d, b).collect()}
    print(len(want), "alignments, without a five-word seed:", sum(not five(items[i]) & five(docs[d].split()) for d, i in want))
    assert got == want
