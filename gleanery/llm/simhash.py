"""SimHash fingerprints and covering locality-sensitive hashing.

Every bit position belongs to one of 2^(r+1)-1 classes, the non-zero vectors
of r+1 bits. Mask v keeps the bits whose class has an odd inner product with
v. Whatever r bits two fingerprints differ in, some v is orthogonal to all of
their classes, so both agree under that mask: no pair within the radius is
missed. A bucket of many fingerprints is split by covering its free bits once
more, which bounds what meets in one place by the number of bits left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.components import connected_components
from gleanery.session import cut

BITS, SEED = 64, 42
#: Distinct fingerprints in a bucket beyond which its free bits are covered again.
SPLIT_ABOVE = 2048
#: The pipeline's near copies: Jaccard similarity of the shingle sets. Two sets of 0.8 agree in a
#: band of ROWS minima in one case of three, and in fewer than LEAST_EQUAL of all in one of 10^6.
NEAR, BANDS, ROWS, LEAST_EQUAL = 0.8, 32, 5, 104
#: Rounds in which a bucket's members meet one of it; members of a tile; members beside the largest part from which a bucket may be parted by pieces of the sketches.
STARS, TILE, SPLIT_REST = 2, 1024, 32_768
#: Links up to which one task connects them (16 bytes each).
FEW_LINKS = 1_000_000
#: Ids that are broadcast, so that the texts they are looked up in are not shuffled.
FEW_IDS = 1_000_000
_TIMES = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes | None, width: int) -> int:
    """SimHash of the word shingles of a UTF-8 text, repeats included.

    ``A-Z`` are lower-cased and words end at ASCII white space. Fewer words
    than ``width`` make one shingle; no words, a null or empty text give 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    width = min(width, len(words))
    hashes = np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[width - 1 :], strict=False)), np.uint64, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_buffer() and t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions, one for each non-zero vector."""
    size = (1 << (radius + 1)) - 1
    return [sum(1 << b for i, b in enumerate(bits) if (((i % size) + 1) & v).bit_count() & 1) for v in range(1, size + 1)]


def _spanning(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int]]:
    """Links within the radius that connect what all such links connect."""
    left = np.unique(fps)
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                hits, left = left[near], left[~near]
                queue.extend(hits)
                yield hits, x


def _links(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in batch.column(0):
                for hits, x in _spanning(row.values.to_numpy().view(np.uint64), radius):
                    a.append(hits)
                    b.append(np.full(hits.size, x, np.uint64))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (a, b)], ["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a long, b long")


def covering_links(distinct: DataFrame, radius: int, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column ``fp``.

    They connect exactly the fingerprints that all pairs within ``radius``
    bits connect; each bucket emits fewer links than it has members.
    """
    every = list(range(BITS))
    masks = covering_masks(every, radius)
    again = [[m | s for s in covering_masks([b for b in every if not m >> b & 1], radius)] for m in masks]
    tables = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("k")).select("fp", "k.*")
    busy = tables.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    tables = tables.join(busy, ["t", "key"])
    plain = tables.where(F.col("n") <= split_above).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in again])
    hot = (
        tables.where(F.col("n") > split_above)
        .select("fp", "t", F.posexplode(F.element_at(finer, F.col("t") + 1)).alias("v", "mask"))
        .groupBy("t", "v", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
    )
    return _links(plain.select("fps").unionByName(hot.select("fps")), radius)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component) of every row.

    The component is the smallest id reachable over links of at most
    ``radius`` differing bits, the row's own included. Equal fingerprints meet
    first and count once, so copies are never paired. Empty and null texts
    share fingerprint 0; repeated rows stay; rows without id take the smallest
    id of those they link with (null if none has one).
    """
    rows = cut(fingerprints(docs, id_col, text_col, width))
    distinct = rows.groupBy("fp").agg(F.min("id").alias("first"))
    groups = connected_components(covering_links(distinct.select("fp"), radius), "a", "b").withColumnRenamed("node", "fp")
    classes = distinct.join(groups, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = classes.groupBy("root").agg(F.min("first").alias("least"))
    named = classes.join(least, "root").select("fp", F.col("least").alias("component"))
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component")


def _shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; none for a text without words."""
    words = (text or b"").lower().split()
    width = min(width, len(words))
    joined = (b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)) if words else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64))


def _name(shingles: np.ndarray) -> int:
    """One number for equal sets of shingles."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) if shingles.size else 0


def minima(shingles: np.ndarray) -> np.ndarray:
    """Least value of the set under each of BANDS x ROWS multiplications."""
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[lo : lo + 1024, None] * _TIMES).min(axis=0))
    return least


def _mark(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, mark, sid, keys, sketch): a hash of the text, a name of the shingle set, meeting places, a byte of each minimum.

    The first BANDS keys are of minima, the others are the fingerprint under
    the covering masks for three bits.
    """
    masks = np.array(covering_masks(list(range(BITS)), 3), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, keys, small = [], [], []
            for t in batch.column(2):
                text = t.as_py()
                found = _shingles(text, width)
                least = minima(found)
                names.append(_name(found))
                bands = [xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in least.reshape(BANDS, ROWS)]
                keys.append(np.concatenate([np.array(bands, np.uint64), np.uint64(fingerprint(text, width)) & masks]))
                small.append((least >> np.uint64(24)).astype(np.uint8).tobytes() if found.size else bytes(len(least)))
            flat = np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64)
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * (BANDS + len(masks)), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(names, np.uint64).view(np.int64)), each, pa.array(small, pa.binary())], ["id", "mark", "sid", "keys", "sketch"])

    rows = docs.select(F.col(id_col).alias("id"), _mark(text_col).alias("mark"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, mark long, sid long, keys array<long>, sketch binary")


def shingle_sets(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(sid, shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                sets = [_shingles(t.as_py(), width) for t in batch.column(0).slice(lo, 256)]
                ends = np.cumsum([0, *map(len, sets)])
                each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([_name(x) for x in sets], np.uint64).view(np.int64)), each], ["sid", "shingles"])

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(run, "sid long, shingles array<long>")


def _equal_bytes():
    """A column function: in how many minima two sketches agree."""

    @F.pandas_udf("int")
    def equal(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), BANDS * ROWS) for v in (a, b))
        return pd.Series((x == y).sum(axis=1).astype(np.int32))

    return equal


def _stars(members: DataFrame, parts: DataFrame | None, salt: int) -> DataFrame:
    """(a, b): each member of a bucket and the one of it that the salt picks, where these are of different parts."""
    own = members.withColumn("part", F.col("sid")) if parts is None else members.join(parts, "sid", "left").withColumn("part", F.coalesce("part", "sid"))
    picked = own.groupBy("t", "key").agg(F.min(F.struct(F.xxhash64(F.lit(salt), "sid").alias("o"), "sid", "part")).alias("p"))
    both = own.join(picked.select("t", "key", F.col("p.sid").alias("other"), F.col("p.part").alias("its")), ["t", "key"]).where("part <> its")
    return both.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct()


def _alike(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs whose sketches agree in LEAST_EQUAL minima."""
    of = lambda k: distinct.select(F.col("sid").alias(k), F.col("sketch").alias(f"s{k}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(_equal_bytes()("sa", "sb") >= LEAST_EQUAL).select("a", "b")


def _pieces(sketch):
    """Hashes of the first byte pairs of a sketch, as many as LEAST_EQUAL leaves to differ and one more.

    Two sketches that agree in LEAST_EQUAL minima differ in too few bytes to
    differ in each of these pairs, so they share one of them for certain.
    """
    pairs = F.sequence(F.lit(0), F.lit(BANDS * ROWS - LEAST_EQUAL))
    return F.transform(pairs, lambda i: F.xxhash64(F.substr(sketch, 2 * i + 1, F.lit(2))))


def _open_tiles(members: DataFrame, parts: DataFrame, distinct: DataFrame, tile: int, split_above: int) -> DataFrame:
    """(t, key, v, next, lo, hi, tile, sid, part): what is left to compare within buckets of several parts.

    The members of a bucket's largest part are known to be connected; all
    others are held against each other and against these, in pairs of tiles
    ``lo`` and ``hi`` of about ``tile`` members. Buckets of two have been looked at. One with more
    than ``split_above`` members beside its largest part is parted by byte pairs of the
    sketches (see ``_pieces``) where this leaves less to compare: what is alike meets either way.
    """
    own = members.where("n > 2").join(parts, "sid", "left").withColumn("part", F.coalesce("part", "sid"))
    own = own.withColumns({"v": F.lit(-1), "next": F.lit(0).cast("long")})

    def sized(rows: DataFrame) -> DataFrame:
        key = ["t", "key", "v", "next"]
        per = rows.groupBy(*key, "part").agg(F.count("*").alias("c"))
        per = per.groupBy(*key).agg(F.max(F.struct("c", "part")).alias("m"), F.sum("c").alias("all")).where(F.col("all") > F.col("m.c"))
        return cut(rows.join(per.select(*key, F.col("m.part").alias("main"), F.col("m.c").alias("n_main"), (F.col("all") - F.col("m.c")).alias("n_rest")), key))

    found = sized(own.drop("n"))
    large = found.where(F.col("n_rest") > split_above)
    if not large.isEmpty():
        pieces = distinct.select("sid", F.posexplode(_pieces(F.col("sketch"))).alias("v", "next"))
        finer = sized(large.select("t", "key", "sid", "part").join(pieces, "sid").select(*found.columns[:-3]))
        met = F.when(F.col("part") != F.col("main"), F.col("n_rest") + F.col("n_main")).otherwise(F.col("n_rest"))
        cost = lambda rows, name: rows.groupBy("t", "key").agg(F.sum(met).alias(name))
        parted = cost(large, "whole").join(cost(finer, "cut"), ["t", "key"], "left").where("coalesce(cut, 0) < whole").select("t", "key")
        found = found.join(parted, ["t", "key"], "left_anti").unionByName(finer.join(parted, ["t", "key"], "left_semi"))
    tiles = lambda n: F.ceil(F.col(n) / tile).cast("int")
    rest, is_rest = tiles("n_rest"), F.col("part") != F.col("main")
    place = F.when(is_rest, F.pmod(F.xxhash64("sid"), rest)).otherwise(rest + F.pmod(F.xxhash64("sid"), tiles("n_main"))).cast("int")
    others = F.when(is_rest, F.sequence(F.lit(0), rest + tiles("n_main") - 1)).otherwise(F.sequence(F.lit(0), rest - 1))
    dealt = found.select("t", "key", "v", "next", "sid", "part", place.alias("tile"), F.explode(others).alias("o"))
    return dealt.select("t", "key", "v", "next", F.least("tile", "o").alias("lo"), F.greatest("tile", "o").alias("hi"), "tile", "sid", "part")


def _near_in_tile(rows: pa.StructArray, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of a member of tile ``lo`` and of those of tile ``hi`` in other parts with a like sketch."""
    tile, part = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("tile", "part"))
    small = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint8).reshape(len(tile), -1)
    there = np.flatnonzero(tile == hi)
    for n, x in enumerate(np.flatnonzero(tile == lo)):
        held = there[n + 1 :] if lo == hi else there
        held = held[part[held] != part[x]]
        if held.size and (near := held[(small[held] == small[x]).sum(axis=1) >= LEAST_EQUAL]).size:
            yield int(x), near


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of tiles that have a like sketch in another part."""
    for batch in batches:
        found: list[tuple] = []
        for i in range(batch.num_rows):
            *key, rows = (batch.column(c)[i] for c in range(7))
            key, rows = [k.as_py() for k in key], rows.values
            seen = {p for x, near in _near_in_tile(rows, *key[4:]) for p in (x, *near.tolist())}
            sid, tile = rows.field("sid").to_pylist(), rows.field("tile").to_pylist()
            found += [(*key, tile[p], sid[p]) for p in sorted(seen)]
        names = ["t", "key", "v", "next", "lo", "hi", "tile", "sid"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        columns = list(zip(*found, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def joining(rows: pa.StructArray, lo: int, hi: int, near: float) -> list[tuple[int, int]]:
    """Links of Jaccard ``near`` or more between parts that meet in a pair of tiles, as many as connect what all such links connect."""
    sid, part = rows.field("sid").to_pylist(), rows.field("part").to_pylist()
    ends = rows.field("shingles").offsets.to_numpy()
    flat = rows.field("shingles").values.to_numpy(zero_copy_only=False)
    of = lambda p: flat[ends[p] : ends[p + 1]]
    parent = {p: p for p in part}

    def root(p: int) -> int:
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        return p

    found = []
    for x, held in _near_in_tile(rows, lo, hi):
        a = of(x)
        for y in held.tolist():
            if (p := root(part[x])) != (o := root(part[y])):
                b = of(y)
                if min(len(a), len(b)) >= near * max(len(a), len(b)) > 0:
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    if common >= near * (len(a) + len(b) - common):
                        parent[p] = o
                        found.append((sid[x], sid[y]))
    return found


def _tile_links(tiles: DataFrame, near: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [pair for i in range(batch.num_rows) for pair in joining(batch.column(2)[i].values, batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), near)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    return tiles.mapInArrow(run, "a long, b long").distinct()


def _verified(links: DataFrame, sets: DataFrame, near: float) -> DataFrame:
    """The links whose shingle sets have a Jaccard similarity of ``near`` or more."""
    of = lambda k: sets.select(F.col("sid").alias(k), F.col("shingles").alias(f"s{k}"))
    both = links.join(of("a"), "a").where(F.col("sa").isNotNull()).join(of("b"), "b")
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(small >= near * large).where(common >= near * (small + large - common)).select("a", "b")


def _small(ids: DataFrame) -> DataFrame:
    """The rows, marked for broadcast if they are counted to be FEW_IDS at most."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def _groups(docs: DataFrame, id_col: str, text_col: str, width: int, near: float) -> tuple[DataFrame, DataFrame]:
    """(id, mark, sid) of every row with an id, ``mark`` a hash of its text, and (sid, least) with the least (id, mark) of the group.

    See ``similar``.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    rows = cut(sketches(docs, id_col, text_col, width))
    distinct = cut(rows.groupBy("sid").agg(F.min(F.struct("id", "mark")).alias("first"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    tables = distinct.select("sid", F.posexplode("keys").alias("t", "key"))
    busy = tables.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = cut(tables.join(busy, ["t", "key"]))
    sets, good, tested, parts = None, None, None, None

    def with_sets(sids: DataFrame) -> DataFrame:
        """The shingle sets known so far and those of more members, read from their texts."""
        sids = sids if sets is None else sids.join(sets.select("sid"), "sid", "left_anti")
        ids = rows.join(sids, "sid", "left_semi").groupBy("sid").agg(F.min("id").alias(id_col)).select(id_col).distinct()
        more = shingle_sets(docs.join(_small(ids), id_col, "left_semi"), text_col, width).dropDuplicates(["sid"])
        return cut(more) if sets is None else cut(more.join(sets.select("sid"), "sid", "left_anti")).unionByName(sets)

    for salt in range(STARS):
        pairs = _stars(members if parts is None else members.where("n > 2"), parts, salt)  # those of two have met
        pairs = cut(_alike(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), distinct))
        if pairs.isEmpty():
            break
        sets = with_sets(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct())
        new = cut(_verified(pairs, sets, near))
        good, tested = (new, pairs) if good is None else (good.unionByName(new), tested.unionByName(pairs))
        parts = cut(connected_components(good, "a", "b", small=FEW_LINKS).select(F.col("node").alias("sid"), F.col("component").alias("part")))
    if parts is not None:
        key = ["t", "key", "v", "next", "lo", "hi"]
        tiles = _open_tiles(members, parts, distinct, TILE, SPLIT_REST)
        met = tiles.join(distinct.select("sid", "sketch"), "sid").groupBy(*key).agg(F.collect_list(F.struct("sid", "part", "tile", "sketch")).alias("rows"))
        met = cut(met.mapInArrow(_involved, "t int, key long, v int, next long, lo int, hi int, tile int, sid long"))
        if not met.isEmpty():
            sets = with_sets(met.select("sid").distinct())
            whole = met.join(parts, "sid", "left").withColumn("part", F.coalesce("part", "sid")).join(distinct.select("sid", "sketch"), "sid").join(sets, "sid")
            last = whole.groupBy(*key).agg(F.collect_list(F.struct("sid", "part", "tile", "sketch", "shingles")).alias("rows")).select("lo", "hi", "rows")
            good = good.unionByName(cut(_tile_links(last, near)))
            parts = cut(connected_components(good, "a", "b", small=FEW_LINKS).select(F.col("node").alias("sid"), F.col("component").alias("part")))
    classes = distinct.select("sid", "first")
    classes = classes.withColumn("root", F.col("sid")) if parts is None else classes.join(parts, "sid", "left").withColumn("root", F.coalesce("part", "sid"))
    return rows.select("id", "mark", "sid"), classes.join(classes.groupBy("root").agg(F.min("first").alias("least")), "root").select("sid", "least")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, near: float = NEAR) -> DataFrame:
    """(id, component) of every row with an id: the smallest id reachable over pairs of Jaccard ``near`` or more.

    Equal shingle sets meet first and count once. Candidates are what shares a
    band of minima or a fingerprint up to three bits; every link is verified
    on the shingle sets. A pair of Jaccard 0.8 shares no band in 3 of 10^6
    cases. First every member of a bucket is held against one of it, STARS
    times against another one, which takes no more links than there are members
    and connects nearly all of a group. What is not connected yet is held
    against the rest of its bucket, in tiles of bounded size; shingle sets go
    there only of members that have a like sketch in another part.

    Repeated rows, null and empty texts share a shingle set; an empty set is
    like no other one. An empty table gives no rows; other columns are not looked at.
    """
    rows, named = _groups(docs, id_col, text_col, width, near)
    return rows.join(named, "sid").select(F.col("id").alias(id_col), F.col("least.id").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, near: float = NEAR) -> DataFrame:
    """The documents without near-duplicates: the smallest id of each group stays.

    Near-duplicates have five-word shingle sets of Jaccard similarity 0.8 or
    more. Different texts that share an id are documents of their own. Of rows
    with one id and one text the least by a hash of all columns stays; rows
    without id cannot be named and all stay.
    """
    rows, named = _groups(docs, id_col, text_col, width, near)
    rows, key = cut(rows), ["__id", "__mark"]
    of = lambda df: df.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"))
    first = named.select("least.id", "least.mark").distinct()
    dropped = _small(of(rows).distinct().join(of(first), key, "left_anti"))
    marked = docs.where(F.col(id_col).isNotNull()).withColumns({"__id": F.col(id_col), "__mark": _mark(text_col)}).join(dropped, key, "left_anti")
    repeated = cut(of(rows.groupBy("id", "mark").agg(F.count("*").alias("n")).where("n > 1").drop("n")))
    others = docs.where(F.col(id_col).isNull())
    if repeated.isEmpty():
        return marked.drop(*key).unionByName(others)
    whole = F.struct(*[F.col(c) for c in docs.columns])
    one = marked.join(repeated, key, "left_semi").groupBy(*key).agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return marked.join(repeated, key, "left_anti").drop(*key).unionByName(one).unionByName(others)


def op10_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
