"""The multiset hash, its updates, and the query against a plain version."""

import hashlib
import random

import numpy as np
from compare import SF

from gleanery.llm import fingerprint as fp


def plain(rows):
    """Each row's figures by the definition, from whole texts in one list."""
    texts = [(i, t or "") for i, t in rows]
    order = sorted(set(texts), key=lambda r: (r[0] is not None, r[0] or 0, mark_of(r[1])))
    out = []
    for i, t in texts:
        other = order[(order.index((i, t)) + 1) % len(order)][1]
        k = len(t) // 2
        made = t[: len(t) - k] + other[:k]
        a, b, c = (fp.fingerprint(x.encode()) for x in (t, made, other))
        out.append((i, len(t), hashlib.sha256(made.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), fp.likeness(a, b), fp.likeness(a, c)))
    return out


MARKS = {}


def mark_of(text):
    return MARKS[text]


def run(spark, rows, extra=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, "x", 1) for r in rows] if extra else rows, "doc_id long, text string, mark string, piece int")
    MARKS.update({r[0]: r[1] for r in df.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()})
    return [tuple(r) for r in fp.document_fingerprints(df).collect()]


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_multisets():
    a, b, c = b"one paragraph of some length", b"short", b"another one \xc3\xa9 that is long"
    assert np.array_equal(fp.fingerprint(b"\n".join([a, b, c])), fp.fingerprint(b"\n".join([c, a, b])))
    assert not np.array_equal(fp.fingerprint(b"\n".join([a, b])), fp.fingerprint(b"\n".join([a, b, b])))
    assert not np.array_equal(fp.fingerprint(a + b"\n"), fp.fingerprint(a))
    assert np.array_equal(fp.insert(fp.vector([a]), [b, c]), fp.vector([a, b, c]))
    assert np.array_equal(fp.delete(fp.vector([a, b, c]), [c, a]), fp.vector([b]))
    assert np.array_equal(fp.delete(fp.vector([a]), [a]), fp.fingerprint(b""))


def test_lanes_wrap_around():
    many = fp.vector([b"x" * 12] * 40_000)
    assert np.array_equal(fp.delete(many, [b"x" * 12] * 39_999), fp.vector([b"x" * 12]))


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = random.Random(3).randbytes(5000).replace(b"\n", b"n") + b"\n" + b"line\n" * 40
    whole = fp.fingerprint(text)
    monkeypatch.setattr(fp, "AT_ONCE", 64)
    assert np.array_equal(fp.fingerprint(text), whole)


def test_likeness_follows_the_share_of_equal_text():
    r = random.Random(5)
    words = [bytes(r.choices(range(97, 123), k=r.randint(3, 9))) for _ in range(4000)]
    line = lambda k: b" ".join(words[k : k + 20])
    base = [line(20 * k) for k in range(100)]
    for kept in (0, 25, 50, 75, 100):
        other = base[:kept] + [line(2000 + 20 * k) for k in range(100 - kept)]
        assert abs(fp.likeness(fp.vector(base), fp.vector(other)) - kept / 100) < 0.15
    assert fp.likeness(fp.fingerprint(b""), fp.fingerprint(b"")) == 1.0
    assert fp.likeness(fp.fingerprint(b""), fp.vector(base)) == 0.0


def test_rows_against_plain(spark):
    r = random.Random(11)
    text = lambda: "".join(r.choice("abcdé \n漢") for _ in range(r.randint(0, 120)))
    rows = [(i, text()) for i in r.sample(range(1000), 150)]
    rows += [(7, None), (8, ""), (9, "a"), (10, "\n\n"), (None, "no id"), (None, None), (2000, "x\n" * 30_000 + "é" * 50_000)]
    rows += [rows[3]] * 5 + [(rows[4][0], "other text, same id")]
    same(run(spark, rows), plain(rows))


def test_one_document_and_none(spark):
    same(run(spark, [(1, "only one\nof them")]), plain([(1, "only one\nof them")]))
    same(run(spark, [(1, "twice")] * 3), plain([(1, "twice")] * 3))
    assert run(spark, []) == []


def test_query_against_plain(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    MARKS.update({r[0]: r[1] for r in docs.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()})
    got = fp.op13_fingerprint(spark, SF)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    same([tuple(x) for x in got.collect()], plain([tuple(x) for x in docs.collect()]))
