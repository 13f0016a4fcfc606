"""The trie and its rollup against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gleanery.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, m int"


def plain(rows):
    """Every node by the definition, over rebuilt conversations in a dict."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    nodes = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = {}
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        ends = sorted(c for c in members if len(made[c]) == len(path))
        out[(min(members), len(path))] = (
            min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below),
            sum(not any(q[: len(p)] == p and len(q) > len(p) for q in below) for p in below), sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def run(spark, rows, small=None):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    got = pt.prefix_trie(*pt.rebuilt(pt.turns(df)), small).collect()
    found = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got}
    assert len(found) == len(got)
    return found


def conversations(r, n):
    words = ["", "a", "b", "éé", "long text"]
    return [(c, t, r.choice(["user", "assistant"]), r.choice(words)) for c in r.sample(range(400), n) for t in range(r.randint(1, 9))]


@pytest.mark.parametrize("small", [1, None])
def test_nodes_against_plain(spark, small):
    rows = conversations(random.Random(small or 0), 60)
    rows += [(500, None, None, None), (500, 3, "user", None), (None, 0, "user", "nobody's"), (501, 0, "user", "a")]
    rows += [(c, t, "user", "same") for c in range(1000, 1012) for t in range(4)]  # equal conversations
    assert run(spark, rows, small) == plain(rows)


def test_repeated_rows_are_turns_of_their_own(spark):
    rows = [(1, 0, "user", "x")] * 7 + [(101, 0, "user", "x")] * 9
    assert run(spark, rows) == plain(rows)


def test_no_conversations(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, 1, "user", "x")]) == {}


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    few = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)  # its base, 100, is absent
    rows = [(few, 0, "user", "x")]
    got = run(spark, rows)
    assert got == plain(rows)
    assert list(got) == [(few, 0)]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 3000, []
    seqs = spark.range(1, n + 1).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("depth"), F.xxhash64("id").alias("h1"), F.xxhash64("id").alias("h2"), F.lit(2).cast("long").alias("chars"))
    convs = spark.createDataFrame([(5, n)], "conv_id long, n_turns long")
    found = pt._finished
    monkeypatch.setattr(pt, "_finished", lambda parts, values: rounds.append(1) or found(parts, values))
    few = pt._few
    monkeypatch.setattr(pt, "_few", lambda df: rounds.append(2) or few(df))
    got = {r["depth"]: r["n_leaves"] for r in pt.prefix_trie(seqs, convs, small=200).collect()}
    assert got == dict.fromkeys(range(n + 1), 1)
    assert rounds.count(2) <= 3 * 6  # three of a round; 3000 in parts of at most 200 by halves


def test_rollup_of_trees_by_centroids():
    r = random.Random(2)
    for n in (1, 2, 3, 10, 200):
        for shape in ("any", "chain", "star"):
            parents = [-1] + [{"any": r.randrange(i), "chain": i - 1, "star": 0}[shape] for i in range(1, n)]
            order = sorted(range(n), key=lambda i: depth(parents, i))
            place = {v: k for k, v in enumerate(order)}
            parents = [place[parents[v]] if parents[v] >= 0 else -1 for v in order]
            values = [(r.randint(0, 9), 1) for _ in range(n)]
            want = [list(v) for v in values]
            for i in range(n - 1, 0, -1):
                want[parents[i]] = [a + b for a, b in zip(want[parents[i]], want[i], strict=True)]
            assert pt.centroid_rollup(parents, values) == [tuple(w) for w in want]
    assert pt.centroid_rollup([], []) == []


def depth(parents, i):
    return 0 if parents[i] < 0 else 1 + depth(parents, parents[i])


def test_ends_of_one_node_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 50)
    ids = random.Random(4).sample(range(-500, 5000), 2000)
    rows = spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 9)], "m long, depth long, conv_id long").repartition(7)
    got = {(r["m"], r["depth"]): r["ends_sha256"] for r in pt.ends_hashes(rows).collect()}
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    assert got == {(1, 2): sha(ids), (1, 3): sha([9])}
