"""Suffix arrays against sorting, removal against brute force."""

import hashlib
import random

from gleanery.llm.suffix_dedup import LENGTH, cut_repeats, remove_repeats, suffix_array


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - LENGTH + 1):
            w = b[s : s + LENGTH]
            if i is not None and (w not in first or i < first[w]):
                first[w] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - LENGTH + 1):
            if i is not None and first[b[s : s + LENGTH]] < i:
                gone[s : s + LENGTH] = [True] * LENGTH
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, block string")
    return sorted(((r["doc_id"], r["__n_bytes"], r["__n_removed"], r["__n_spans"], hashlib.sha256(r["__kept"]).hexdigest()) for r in remove_repeats(df, **how).collect()), key=str)


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(300):
        t = [rng.randint(1, rng.choice((2, 3, 9))) for _ in range(rng.randint(0, 60))] + [0]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "and", "ré", "ß", "stone", "river", "a", "to", "über"])
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passages)[rng.randint(0, 20) :] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 6))]
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "a" * 300), (203, "b" * 49 + "a" * 120), (204, "ab" * 200), (205, None), (206, ""), (None, rows[3][1]), (207, rows[4][1]), (207, rows[4][1]), (208, "x" * 3_000_000 + passages[0]), (209, "y" + passages[0])]
    want = brute(rows)
    assert got(spark, rows) == want
    rows = [r for r in rows if len(r[1] or "") < 10**6]
    assert got(spark, rows, block_bytes=1500, split_blocks=1) == brute(rows)


def test_empty_and_stage(spark):
    assert got(spark, []) == []
    docs = spark.createDataFrame([(1, "é" * 60 + "left", "en", 64), (2, "a" + "é" * 60 + "right", "en", 66), (None, None, None, None)], "doc_id long, text string, lang string, n_chars long")
    left = {r["doc_id"]: r for r in cut_repeats(docs).collect()}
    assert left[1]["text"] == "é" * 60 + "left" and left[2]["text"] == "aright" and left[2]["n_chars"] == 6
    assert left[None]["text"] == ""


def test_characters_are_cut_whole_and_others_stay(spark):
    """Replacement characters of a text are text; a character cut in half by a repeat goes whole."""
    passage = "p" * 30 + "q" * 19 + "é"  # a repeat ends within the last character
    docs = [(1, "x" + passage[:-1] + "ê" + "tail one"), (2, "keep\ufffdme " + passage + " and \ufffd me")]
    got = {r.doc_id: r.text for r in cut_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "keep\ufffdme  and \ufffd me"}
