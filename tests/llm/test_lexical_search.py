"""The dual-tree search against scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gleanery.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    """The ten best of each item, by scoring every pair."""
    bags = [(i, Counter(split(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in set(items):
        scores = []
        for (i, bag), n in zip(bags, sizes, strict=True):
            if n:
                m = 25 + (75 * n * n_docs) // total
                score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t, q in Counter(split(text)).items() if t in bag)
                if score > 0:
                    scores.append((-score, i is None, i or 0, i))
        out += [(item_id, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:10])]
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id long, text string, tids string, ikey int, n int").repartition(3)
    b = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, block string, score int")
    return sorted((tuple(r) for r in ls.ranked_search(d, b).collect()), key=str)


def corpus(r, n, words=60):
    known = [f"w{k}" for k in range(words)]
    return [(i, " ".join(r.choices(known, [1 / (k + 1) for k in range(words)], k=r.randint(0, 40)))) for i in r.sample(range(10 * n), n)]


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    if small:  # joins instead of broadcasts, many blocks, many sets
        for name, n in (("VOCABULARY", 0), ("BROADCAST_ROWS", 0), ("BLOCK_DOCS", 8), ("SET_ITEMS", 4), ("LEAF_DOCS", 2), ("FANOUT", 2)):
            monkeypatch.setattr(ls, name, n)
    r = random.Random(3)
    docs = corpus(r, 150) + [(5000, None), (5001, ""), (5002, "--- !!"), (None, "w1 w2 w3"), (None, None), (5003, "W1\x01w1,É É w2 " * 3000), (5004, "漢字 w5")]
    docs += [docs[0]] * 12 + [(6000 + k, "w9 w8 w7") for k in range(15)]  # ties
    items = [(k, t) for k, (_, t) in enumerate(corpus(r, 12))] + [(90, None), (91, ""), (92, "unknown words"), (93, "w9 w9 w8"), (93, "w9 w9 w8"), (93, "É w1"), (None, "w4 漢字"), (94, "the " * 50 + "w3 " * 400)]
    assert run(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == []
    assert run(spark, [(1, None)], [(1, "a")]) == []
    assert run(spark, [(1, "a b"), (2, "c")], [(1, "a")]) == plain([(1, "a b"), (2, "c")], [(1, "a")])


def exact(q, x):
    scores = q.astype(np.int64) @ x.astype(np.int64).T
    return {(i, s) for i, row in enumerate(scores) for s in sorted(row[row > 0], reverse=True)[:10]}


def test_bounds_prune_whole_batches():
    r = np.random.default_rng(5)
    topics, docs, items = 40, 1024, 64
    x, q = np.zeros((docs, topics * 10)), np.zeros((items, topics * 10))
    for row, rows in ((x, docs), (q, items)):
        for k in range(rows):
            t = k * topics // rows
            at = t * 10 + r.choice(10, 6, replace=False)
            row[k, at] = r.integers(1, 1000, 6)
            row[k, r.integers(0, topics * 10)] += 1  # a word of another topic
    found = ls.search(q, x, np.zeros(items))
    assert {(i, s) for i, s in zip(found.items, found.scores, strict=True)} == exact(q, x)
    assert found.scored < docs * items / 3
    # kth scores that are known from elsewhere leave less to look at, and nothing else out
    known = np.array([sorted((q[i] @ x.T).tolist())[-10] for i in range(items)])
    again = ls.search(q, x, known)
    assert set(zip(again.items, again.scores, strict=True)) == exact(q, x)
    assert again.scored <= found.scored


def test_sums_beyond_doubles_are_exact():
    q, x = np.array([[2.0**40, 1, 0]]), np.array([[2.0**20, k, 5] for k in range(30)])
    found = ls.search(q, x, np.zeros(1))
    assert sorted(found.scores)[-10:] == [2**60 + k for k in range(20, 30)]


def test_terms():
    assert ls.terms("A-b_c É1\x7fx\u00a0y".encode()) == [b"a", b"b", b"c", "É1".encode(), "x\u00a0y".encode()]
    assert ls.terms(None) == ls.terms(b"") == []
