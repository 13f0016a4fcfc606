"""Targets and taken words against a plain version."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gleanery.llm.mixing import mix, take_mix


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        w = sum(weight[s] for s in names if s not in stopped)
        over = {s for s in names if s not in stopped and weight[s] * rest / w > 3 * sizes[s] + 1e-9} if w else set()
        if not over:
            return {s: 3 * sizes[s] if s in stopped else weight[s] * rest / w for s in names}
        stopped |= over


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        source = rng.choice(["a", "b", "ü", "Z", None]) if rng.random() < 0.6 else "hot"
        rows.append((i, source, " ".join("w" for _ in range(rng.choice([0, 1, 5, 50, 400])))))
    return rows + [(9000, "tiny", "one"), (9001, "empty", ""), (9002, "empty", None), (9002, "hot", "again and again"), (None, "hot", "no id"), (9003, "long", "w " * 40000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, source string, text string, size int, h string")
    got = mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    by_id = {i: s for i, s, _ in rows}
    taken, largest = {}, {}
    for r in got:
        s = by_id[r.doc_id] if r.doc_id not in (9002,) else ("hot" if r["size"] else "empty")
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r["size"])
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    assert sorted(map(str, mix(df).collect())) == sorted(map(str, got))
    kept = take_mix(df)
    assert kept.columns == [*df.columns, "copies"]
    assert kept.agg(F.sum(F.col("copies"))).first()[0] == sum(r.taken // r["size"] for r in got if r["size"])


def test_order_within_a_source_is_the_hash(spark):
    rows = [(i, "a" if i % 4 else "b", "w " * 10) for i in range(400)]
    got = {r.doc_id: r.taken for r in mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    h = lambda i: hashlib.md5(f"{i}:{'w ' * 10}".encode()).hexdigest()
    for s in "ab":
        ids = sorted((i for i, t, _ in rows if t == s), key=h)
        copies = [got[i] // 10 for i in ids]
        assert copies == sorted(copies, reverse=True) and max(copies) - min(copies) <= 1


def test_equal_rows_and_rows_without_id(spark):
    """A source of equal rows, one of rows without id and one of both meet their targets; reruns agree."""
    rows = [(None, "a", f"w{i} " * 10) for i in range(1000)] + [(7, "b", "x y z " * 5)] * 700 + [(None, "c", "same text")] * 900
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7)
    want = plain_targets({"a": 10_000, "b": 10_500, "c": 1800})
    runs = []
    for frame in (df, df.repartition(3)):
        per = mix(frame).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("top"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
        assert all(abs(r.taken - r.target) <= r.top + 1 and r.most <= 3 for r in per) and sorted(r.target for r in per) == pytest.approx(sorted(want.values()))
        runs.append(sorted((r["size"], r.taken) for r in mix(frame).collect()))
    assert runs[0] == runs[1]


def test_a_column_named_copies(spark):
    df = spark.createDataFrame([(i, "a", "w " * 10, 9) for i in range(20)], "doc_id long, source string, text string, copies int")
    kept = take_mix(df)
    assert kept.columns == df.columns and {r.copies for r in kept.collect()} == {1}
    assert take_mix(kept).count() == 20


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
