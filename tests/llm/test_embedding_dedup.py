"""Lattice decoding and links against brute force."""

import random

import numpy as np
import pytest

from gleanery.llm import embedding_dedup
from gleanery.llm.embedding_dedup import decode_e8, near_duplicates, neighbours


def test_decoding_is_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)) * 2
    y = decode_e8(x)
    assert np.all((np.abs(y * 2 - np.rint(y * 2)) < 1e-9)) and np.all(np.rint(y.sum(1)) % 2 == 0)
    d = ((x - y) ** 2).sum(1)
    for v in neighbours():
        assert np.all(d <= ((x - y - v) ** 2).sum(1) + 1e-9)
    assert len(neighbours()) == 240 and np.allclose((neighbours() ** 2).sum(1), 2)


def brute(rows, least=0.98):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) and l is not None for _, v, l in rows]
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[i].add(j)
                    links[j].add(i)
    return links


def test_links(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(60):
        base = rng.normal(size=64)
        for _ in range(rng.integers(1, 6)):
            rows.append((base + rng.normal(size=64) * rng.choice([0.0, 0.05, 0.13])).tolist())
    random.Random(1).shuffle(rows)
    rows = [(i, v, int(i) % 2) for i, v in enumerate(rows)]
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(30)]  # copies
    rows += [(2000, None, 1), (2001, [0.0] * 64, 1), (2002, [float("nan")] * 64, 1), (2003, [None] * 64, 1), (2004, rows[0][1], None), (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2006, [1.0, 2.0], 1), (None, rows[1][1], rows[1][2])]
    links = brute(rows)
    got = near_duplicates(spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, cls string")).collect()
    assert len(got) == len(rows)
    want_n = {}
    for (i, _, _), l in zip(rows, links):
        want_n.setdefault(i, []).append(len(l))
    have_n = {}
    for r in got:
        have_n.setdefault(r.vec_id, []).append(r.n_links)
    found, wanted = sum(map(sum, have_n.values())), sum(map(sum, want_n.values()))
    assert found >= 0.99 * wanted and all(sum(have_n[i]) <= sum(want_n[i]) for i in want_n)
    comp = {r.vec_id: r.component for r in got}
    assert comp[2000] == 2000 and comp[2004] == 2004 and comp[2007] == 2006 and comp[1003] <= 0
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component) for r in got)
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("side", [16, 1024])
def test_crowded_cells(spark, monkeypatch, side):
    """A dense cloud of different vectors, cut into tiles or not: every link is counted, no row is a pair."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=32)
    rows = [(i, (centre + rng.normal(size=32) * (0.02 if i % 3 else 0.1)).tolist(), 1) for i in range(300)]
    rows += [(300 + i, rng.normal(size=32).tolist(), 1) for i in range(100)]
    want = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embedding_dedup.links, "__defaults__", (0.98, side))
    got = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(map(len, want)) > 30_000
    assert all(got[i].n_links <= len(want[i]) for i in got)
    classes = embedding_dedup._classes(df, "vec_id", "embedding", "label")
    found = embedding_dedup.links(classes.selectExpr("cls", "1L AS n", "vector", "label"), 0.98, side)
    if side > len(rows):  # one tile a cell: fewer links than members
        assert found.where("other IS NOT NULL").count() < 40 * len(rows) < sum(map(len, want))
