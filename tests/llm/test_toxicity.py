"""Held-out accuracy, folds and odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
import zstandard
from compare import SF, present

from gleanery.llm import toxicity


def corpus(rng, n):
    clean = [f"word{i}" for i in range(300)]
    bad = ["wretched", "despicable", "vermin", "filthy", "moronic"]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice(clean) for _ in range(rng.randint(20, 150))]
        if toxic:
            for _ in range(max(2, len(words) // 15)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(1), 1200)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, None), (9001, "", None), (None, "word1 vermin filthy", None), (9002, "word7 " * 200_000, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, toxicity.learn(docs, labels)).collect()}
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in got.values()) == len(held) + sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in (9000, 9001, 9002))
    assert sum(r.predicted == y for r, y in held) >= 0.93 * len(held)
    assert got[9000].predicted == got[9001].predicted == got[9002].predicted == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_labels_of_the_held_out_fold_are_never_read(spark):
    rows = corpus(random.Random(2), 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y
    a, b = (toxicity.learn(docs, spark.createDataFrame([(i, f(i, y)) for i, _, y in rows], "doc_id long, toxic int")) for f in (lambda i, y: y, flip))
    assert a == b


def test_no_model_and_empty(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, toxicity.learn(docs, labels)).collect()] == [0.0]
    assert toxicity.toxicity(docs.limit(0), None).count() == 0


def test_toxic_dictionaries_are_trained_on_toxic_text():
    """A phrase of toxic texts, all of whose words ordinary texts have too, is cheaper under them."""
    rng = random.Random(9)
    vocabulary = [f"w{rng.randrange(10**5)}" for _ in range(3000)]
    phrase = "go back to where you all came from at once"
    rows = []
    for i in range(600):
        body = [rng.choice(vocabulary) for _ in range(60)]
        if i % 5 == 0:
            body[30:30] = phrase.split()
        else:
            for w in phrase.split():
                body.insert(rng.randrange(len(body)), w)
        rows.append((" ".join(body), int(i % 5 == 0)))
    model = toxicity.fit(rows)
    ordinary, *toxic = toxicity._compressors(model)
    window = phrase.encode()
    saved = [len(ordinary(window)) - len(x(window)) for x in toxic]
    assert max(saved) >= 5 and min(saved) > 0
    assert all(x.startswith(model.ordinary) and zstandard.ZstdCompressionDict(model.ordinary).dict_id() for x in model.toxic)


def test_scores_against_a_plain_version(spark):
    """Every document of the smallest table, its windows compressed one by one."""
    if not present():
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(docs, labels)
    got = sorted((r.doc_id, round(r.score, 9)) for r in toxicity.toxicity(docs, model).collect())
    level = toxicity.LEVEL
    size = lambda w, d: len(zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(w))
    want, seen = [], {}
    for r in docs.collect():
        raw, figures = (r.text or "").lower().encode(), []
        spans = [raw[i : i + 32] for i in range(0, max(1, len(raw) - 16), 16)] if raw else []
        for d in (model.ordinary, *model.toxic):
            for w in spans:
                if (w, d) not in seen:
                    seen[w, d] = size(w, d)
        for d in model.toxic:
            saved = [seen[w, model.ordinary] - seen[w, d] for w in spans] or [0]
            n = len(saved)
            over = [sum(x >= k for x in saved) for k in (2, 3, 4, 5, 6)]
            figures += [min(max(saved), 10), *(math.log(1 + x) for x in over), *(math.sqrt(x / n) for x in over), sum(max(x, 0) for x in saved) / n, sum(saved) / n, math.log(1 + n)]
        z = sum(w * (x - m) / s for w, x, m, s in zip(model.weights, figures, model.mean, model.scale)) + model.weights[-1] - model.cut
        want.append((r.doc_id, round(1 / (1 + math.exp(-z) * 3 / 7), 9)))
    assert got == sorted(want)


def test_repeated_rows_are_scored_alike(spark):
    rows = corpus(random.Random(3), 400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(i, t) for i, t, _ in rows[:50]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2, "doc_id long, toxic int")
    found = toxicity.toxicity(docs, toxicity.learn(docs, labels)).collect()
    assert len(found) == 450 and len({tuple(r) for r in found}) == 400


def many_tongues(rng, n):
    """Four languages of 1,500 words each; toxic texts have a few toxic words and are longer."""
    fixed = random.Random(77)
    tongues = []
    for _ in range(4):
        pieces = ["".join(fixed.choice("abcdefghiklmnoprstuvwy") for _ in range(fixed.choice((2, 2, 3)))) for _ in range(40)]
        tongues.append(["".join(fixed.choice(pieces) for _ in range(fixed.choice((1, 2, 2, 3)))) for _ in range(1500)])
    bad = "loser idiot pathetic clown moron scum worthless trash disgusting stupid".split()
    rows = []
    for _ in range(n):
        toxic, vocabulary = int(rng.random() < 0.25), rng.choice(tongues)
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400) if toxic else rng.randint(40, 300))]
        for _ in range(rng.randint(3, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((" ".join(words), toxic))
    return rows


@pytest.mark.parametrize("seed", [5, 6])
def test_few_toxic_words_in_rich_prose_are_caught(seed):
    """More ordinary wording than a small dictionary holds must neither hide toxic words nor pass for them."""
    rng = random.Random(seed)
    model = toxicity.fit(many_tongues(rng, 1200))
    every, unseen = toxicity._compressors(model), many_tongues(rng, 500)
    rejected = toxicity.rule(np.array([toxicity.features(t.encode(), *every) for t, _ in unseen]), model) >= toxicity.CUT
    toxic = np.array([y for _, y in unseen]) == 1
    assert rejected[toxic].mean() >= 0.88 and (~rejected[~toxic]).mean() >= 0.98


def test_wording_that_ordinary_texts_often_have_is_no_passage():
    """Significantly more toxic texts have it, as they are longer, but not several times as many."""
    text = lambda i, phrase: f"{i:06d} {phrase} {i * 7919 % 10**6:06d}".encode()
    toxic = [text(i, "common wording" if i % 10 < 9 else "x") + (b" vermin" if i % 2 else b"") for i in range(1000)]
    ordinary = [text(i, "common wording" if i % 10 < 5 else "x") for i in range(10**5, 10**5 + 2000)]
    for size, least_z in toxicity.PASSAGES:
        found = toxicity.own_passages(toxic, ordinary, size, least_z)
        assert any(b"vermin" in p for p in found) and not any(b"common" in p for p in found)
