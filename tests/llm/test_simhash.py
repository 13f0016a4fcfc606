"""Fingerprints against a plain version; covering links against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gleanery.llm import simhash
from gleanery.llm.simhash import covering_links, covering_masks, fingerprint, keep_one, near_duplicates, similar


def plain(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, radius):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j in range(i):
                if (a ^ fps[j]).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_fingerprint_and_spark_hash(spark):
    for text in ["", "one", "one two", "Ünï ONE\ttwo\x0bthree   four", "a b c a b c a b c", "x " * 5000]:
        for width in (3, 5):
            assert fingerprint(text.encode(), width) == plain(text, width)
    assert fingerprint(None, 3) == 0
    row = spark.sql("SELECT xxhash64('one') AS h").first()
    assert row.h & (2**64 - 1) == fingerprint(b"one", 3)


def test_masks_cover_every_pair():
    for radius in (2, 3):
        masks = covering_masks(list(range(64)), radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = random.Random(radius)
        for _ in range(3000):
            differ = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(differ & m == 0 for m in masks)


def test_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for _ in range(6):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            fps.append(f)
    core = rng.getrandbits(64)  # a bucket that must be split
    fps += [core ^ (1 << a) ^ (1 << b) for a in range(40, 64) for b in range(a)]
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for radius, split in ((2, 2048), (2, 20), (3, 20)):
        links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in covering_links(df, radius, split).collect()]
        assert all((a ^ b).bit_count() <= radius for a, b in links)
        parent = {f: f for f in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        for i, a in enumerate(fps):
            for b in fps[:i]:
                if (a ^ b).bit_count() <= radius:
                    assert find(a) == find(b)


def test_rows(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.upper()) for i, t in enumerate(base)] + [(200 + i, t.replace(" ", "\n", 3) + " end") for i, t in enumerate(base)]
    rows += [(300, ""), (301, None), (302, "  "), (303, "solo"), (303, "solo"), (None, base[0]), (None, "only here")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, fp int, component string")
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [plain(t, 3) for _, t in rows]
    label = groups(fps, 2)
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((-1 if i is None else i, f, least.get(c, -1)) for (i, _), f, c in zip(rows, fps, label))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp & (2**64 - 1), -1 if r.component is None else r.component) for r in got) == want
    kept = keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(303) == 1 and ids.count(None) == 2 and 101 not in ids and 301 not in ids and 302 not in ids and 300 in ids
    assert near_duplicates(df.limit(0)).count() == 0


def test_near_copies_against_exact_jaccard(spark):
    """Random edits down to Jaccard 0.8, where fingerprints differ in far more than three bits."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for n in (60, 120, 300, 700) * 15:
        base = rng.choices(words, k=n)
        texts.append(" ".join(base))
        for edits in (1, n // 60, n // 40, n // 25):
            other = list(base)
            for at in rng.sample(range(n), edits):
                other[at] = rng.choice(words)
            texts.append(" ".join(other))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want, far = list(range(len(texts))), 0
    pairs = [(i, j) for i in range(len(texts)) for j in range(i - i % 5, i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    for _ in range(5):
        for i, j in pairs:
            want[i] = want[j] = min(want[i], want[j])
    far = sum((plain(texts[i], 5) ^ plain(texts[j], 5)).bit_count() > 3 for i, j in pairs)
    assert far > len(pairs) // 2
    assert len(set(want)) > len(texts) // 5  # some edits are below 0.8 and stay
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component for r in similar(df).collect()} == dict(enumerate(want))
    assert {r.doc_id for r in keep_one(df).collect()} == set(want)


def test_rows_that_share_an_id(spark):
    """Different texts of one id both stay, near copies do not, of repeated rows one stays, the same one each time."""
    rng = random.Random(12)
    text = lambda: [f"w{rng.randrange(10**5)}" for _ in range(80)]
    a, b = text(), text()
    near = [*a, "end"]
    rows = [(5, " ".join(a), "one"), (5, " ".join(b), "two"), (5, " ".join(near), "three"), (7, " ".join(b), "four"), (8, None, "five"), (8, "", "six"), (None, " ".join(a), "seven")]
    rows += [(9, "some words of a row that is there many times", f"r{i}") for i in range(20)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, copies int")
    runs = [sorted(map(str, keep_one(df.repartition(n)).collect())) for n in (1, 3, 5)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 5
    kept = keep_one(df)
    assert kept.columns == df.columns
    by_id = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [i for i, _ in by_id] == [0, 5, 5, 8, 9] and {" ".join(b)} < {t for i, t in by_id if i == 5}


def test_parts_of_a_tile_are_joined():
    """Links between parts against all pairs of sets; no more of them than parts."""
    rng = np.random.default_rng(4)
    base = rng.choice(10**6, 60, replace=False)
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.1, 0.3]), rng.integers(0, 10**6, 60), base)).astype(np.uint64) for _ in range(80)] + [np.zeros(0, np.uint64)]
    part = [i // 2 for i in range(len(sets))]
    sketch = [(simhash.minima(s) >> np.uint64(24)).astype(np.uint8).tobytes() for s in sets]
    near = lambda a, b: len(a) and len(b) and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))

    def joined(pairs):
        label = {p: p for p in part}
        for _ in label:
            for a, b in pairs:
                label[part[a]] = label[part[b]] = min(label[part[a]], label[part[b]])
        return label

    kind = pa.struct([("sid", pa.int64()), ("part", pa.int64()), ("tile", pa.int32()), ("sketch", pa.binary()), ("shingles", pa.list_(pa.int64()))])
    for tiles in (lambda i: 0, lambda i: i % 2):
        rows = pa.array([{"sid": i, "part": part[i], "tile": tiles(i), "sketch": sketch[i], "shingles": s.view(np.int64).tolist()} for i, s in enumerate(sets)], kind)
        links = [x for lo in (0, 1) for hi in (0, 1) if lo <= hi for x in simhash.joining(rows, lo, hi, 0.8)]
        assert links and all(near(sets[a], sets[b]) and part[a] != part[b] for a, b in links)
        assert joined(links) == joined([(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])])


@pytest.mark.parametrize("split", [10**6, 4])
def test_buckets_of_many_parts_lose_nothing(spark, monkeypatch, split):
    """Chains of copies of copies beside texts that share half of their words, in small tiles; links stay few."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(20_000)]
    common = rng.choices(words, k=150)
    texts = [" ".join(common + rng.choices(words, k=60)) for _ in range(120)]
    for _ in range(3):
        now = rng.choices(words, k=200)
        for _ in range(60):
            texts.append(" ".join(now))
            now = list(now)
            now[rng.randrange(200)] = rng.choice(words)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    for _ in range(30):
        for i, j in pairs:
            want[i] = want[j] = min(want[i], want[j])
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(simhash, "SPLIT_REST", split)
    monkeypatch.setattr(simhash, "STARS", 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component for r in similar(df).collect()} == dict(enumerate(want))


def test_large_buckets_are_parted_without_loss(spark):
    """Sketches that agree in just as many minima as they must, in a bucket that no later band parts: all of them meet in a tile."""
    rng = np.random.default_rng(8)
    base, sketches = rng.integers(0, 256, 160), []
    for i in range(40):
        other, at = base.copy(), rng.permutation(160)[:28] if i % 2 else np.arange(i, i + 28)
        other[at] = (base[at] + rng.integers(1, 256, 28)) % 256
        sketches.append(other if i < 30 else rng.integers(0, 256, 160))
    alike = {(i, j) for j in range(40) for i in range(j) if (sketches[i] == sketches[j]).sum() >= simhash.LEAST_EQUAL}
    assert len(alike) > 400 and any((sketches[i] == sketches[j]).sum() == simhash.LEAST_EQUAL for i, j in alike)
    distinct = spark.createDataFrame([(i, bytearray(x.astype(np.uint8).tobytes())) for i, x in enumerate(sketches)], "sid long, sketch binary")
    far = [(100 + i, bytearray(rng.integers(0, 256, 160).astype(np.uint8).tobytes())) for i in range(300)]  # nothing like each other: these are parted
    distinct = distinct.unionByName(spark.createDataFrame(far, distinct.schema))
    members = spark.createDataFrame([(40, 7, i, 340) for i in [*range(40), *(s for s, _ in far)]] + [(41, 7, i, 30) for i in range(30)], "t int, key long, sid long, n long")
    parts = spark.createDataFrame([], "sid long, part long")
    for split in (2, 10**6):
        tiles = simhash._open_tiles(members, parts, distinct, 8, split).groupBy("t", "v", "next", "lo", "hi").agg({"sid": "collect_list"}).collect()
        met = {(i, j) for r in tiles for i in r[5] for j in r[5] if i < j}
        assert alike <= met
        assert {r.v for r in tiles if r.t == 40} == ({-1} if split > 2 else {*range(57)})
        assert {r.v for r in tiles if r.t == 41} == {-1}


@pytest.mark.parametrize("few", [10**6, 0])
def test_texts_are_looked_up_by_few_or_many_ids(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW_IDS", few)
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(999)}" for _ in range(200))
    rows = [(1, text), (2, text), (3, text + " end"), (4, "else"), (4, "else"), (4, "other"), (5, None), (6, ""), (None, text), (None, text)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, text), (0, text), (1, text), (4, "else"), (4, "other"), (5, "")]
