"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random onto blocks of 8 dimensions and each
block is decoded to its nearest point of the E8 lattice; the points of all
blocks are the cell. Several tables use projections of their own. A vector is
stored in its home cell and also looks into the neighbouring cells that cost
least, so a pair that a cell border parts still meets. Vectors that meet are
verified by their cosine in double precision.

No pair becomes a row. The members of a cell are multiplied as matrices, a
crowded cell in tiles of bounded size; what comes out is the number of links
of each vector there and as many links as connect what all of them connect. A
pair that meets in several cells counts in the first one only, which both
vectors' cells tell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.components import connected_components
from gleanery.session import cut

#: Tables; E8 blocks in a cell; lattice units that a unit vector spans; neighbouring cells looked into.
TABLES, BLOCKS, SCALE, PROBES = 5, 2, 4.5, 7
LEAST_COSINE = 0.98
#: Members of one side of a tile.
TILE = 1024


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the even integer points and those moved by one half."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


@cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in combinations(range(8), 2):
        for a in (1, -1):
            for b in (1, -1):
                v = np.zeros(8)
                v[i], v[j] = a, b
                found.append(v)
    for signs in range(256):
        if signs.bit_count() % 2 == 0:
            found.append(np.array([-0.5 if signs >> k & 1 else 0.5 for k in range(8)]))
    return np.array(found)


@cache
def projections(dim: int, table: int) -> np.ndarray:
    """A fixed random projection to BLOCKS times 8 dimensions, scaled to lattice units."""
    rng = np.random.default_rng((dim, table))
    wide = max(dim, BLOCKS * 8)
    basis = np.linalg.qr(rng.normal(size=(wide, BLOCKS * 8)))[0][:dim]
    return basis * SCALE * np.sqrt(wide / 64)


def cells(x: np.ndarray, table: int) -> np.ndarray:
    """(vectors, 1 + PROBES, 8 * BLOCKS) int16: the home cell, then the neighbours by cost."""
    y = x @ projections(x.shape[1], table)
    shifts, costs, homes = [], [], []
    for b in range(BLOCKS):
        part = y[:, 8 * b : 8 * b + 8]
        home = decode_e8(part)
        off = part - home
        cost = 2 - 2 * off @ neighbours().T  # |off - v|^2 - |off|^2
        best = np.argpartition(cost, PROBES, axis=1)[:, :PROBES]
        homes.append(home)
        shifts.append(neighbours()[best])
        costs.append(np.take_along_axis(cost, best, 1))
    home = np.concatenate(homes, 1)
    moved = np.zeros((len(x), BLOCKS * PROBES, BLOCKS * 8))
    for b in range(BLOCKS):
        moved[:, b * PROBES : (b + 1) * PROBES, 8 * b : 8 * b + 8] = shifts[b]
    cheap = np.argsort(np.concatenate(costs, 1), axis=1)[:, :PROBES]
    probes = home[:, None, :] + np.take_along_axis(moved, cheap[:, :, None], 1)
    return np.rint(2 * np.concatenate([home[:, None, :], probes], 1)).astype(np.int16)


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, cls, vector, label): equal vectors of a label share ``cls``, a digest; null for those that link with nothing."""
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for v, label in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                flat = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid and not v.values.null_count else np.zeros(0)
                usable = label is not None and flat.size and np.isfinite(flat).all() and flat.any()
                marks.append(hashlib.md5(repr(label).encode() + (flat + 0.0).tobytes()).digest() if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary()), batch.column(1), batch.column(2)], ["id", "cls", "vector", "label"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    return rows.mapInArrow(run, f"id {kinds[id_col]}, cls binary, vector {kinds[vector_col]}, label {kinds[label_col]}")


def _unit(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: row numbers and unit vectors."""
    rows: dict[int, list] = {}
    for i, v in enumerate(column):
        flat = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        rows.setdefault(len(flat), []).append((i, flat / np.abs(flat).max()))
    made = {d: (np.array([i for i, _ in r]), np.array([v for _, v in r])) for d, r in rows.items()}
    return {d: (i, v / np.linalg.norm(v, axis=1, keepdims=True)) for d, (i, v) in made.items()}


def keyed(distinct: DataFrame) -> DataFrame:
    """(cls, n, vector, label, keys): TABLES x (1 + PROBES) cells of each class, the home cell of a table first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = [repr(x).encode() for x in batch.column(3).to_pylist()]
            for dim, (rows, unit) in _unit(batch.column(2)).items():
                for lo in range(0, len(rows), 2048):
                    part = rows[lo : lo + 2048]
                    keys = np.empty((len(part), TABLES, 1 + PROBES), np.uint64)
                    for t in range(TABLES):
                        for k, (i, own) in enumerate(zip(part, cells(unit[lo : lo + 2048], t), strict=True)):
                            salt = xxhash.xxh64_intdigest(b"%d:%d:" % (dim, t) + labels[i])
                            keys[k, t] = [xxhash.xxh64_intdigest(c.tobytes(), 0) ^ salt for c in own]
                    each = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * TABLES * (1 + PROBES), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(part)) for c in range(4)), each], ["cls", "n", "vector", "label", "keys"])

    kinds = dict(distinct.dtypes)
    return distinct.select("cls", "n", "vector", "label").mapInArrow(run, f"cls binary, n long, vector {kinds['vector']}, label {kinds['label']}, keys array<long>")


def _first_cell(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For pairs of rows of keys: the cell of the first table that they meet in, the least one of two."""
    x, y = x.reshape(-1, TABLES, 1 + PROBES), y.reshape(-1, TABLES, 1 + PROBES)
    found, open_ = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for t in range(TABLES):
        a, b = x[:, t, 0], y[:, t, 0]
        at_a, at_b = (y[:, t] == a[:, None]).any(1), (x[:, t] == b[:, None]).any(1)
        cell = np.where(at_a & at_b, np.minimum(a, b), np.where(at_a, a, b))
        found = np.where(open_ & (at_a | at_b), cell, found)
        open_ &= ~(at_a | at_b)
    return found


def _spanning(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """As many links of a symmetric table as connect what all of them connect."""
    left = np.ones(len(linked), bool)
    for start in range(len(linked)):
        if left[start]:
            left[start] = False
            queue = [start]
            while queue:
                x = queue.pop()
                near = np.flatnonzero(linked[x] & left)
                left[near] = False
                queue += near.tolist()
                yield from ((x, int(y)) for y in near)


def tile(key: int, members: pa.StructArray, least: float) -> list[tuple]:
    """(cls, other, links): links by class that count in this cell, and links (cls, other) that connect its members."""
    cls, labels = members.field("cls").to_pylist(), members.field("label").to_pylist()
    stored, storing, home, n = (members.field(c).to_numpy(zero_copy_only=False) for c in ("stored", "storing", "home", "n"))
    keys = members.field("keys").flatten().to_numpy().reshape(len(cls), -1)
    place, kind = ({x: k for k, x in enumerate(sorted(set(cls)))}, {x: k for k, x in enumerate(dict.fromkeys(map(repr, labels)))})
    rank, kind = np.array([place[x] for x in cls]), np.array([kind[repr(x)] for x in labels])
    found = []
    for rows, unit in _unit(members.field("vector")).values():
        h, a = np.flatnonzero(storing[rows]), np.flatnonzero(stored[rows])
        r, k = rank[rows], kind[rows]
        x, y = np.nonzero((unit[h] @ unit[a].T >= least) & (k[h][:, None] == k[a]) & (r[h][:, None] != r[a]))
        x, y = h[x], a[y]
        if not len(x):
            continue
        linked = np.zeros((len(rows), len(rows)), bool)
        linked[x, y] = linked[y, x] = True
        found += [(cls[rows[p]], cls[rows[q]], 0) for p, q in _spanning(linked)]
        once = ~(home[rows[y]] & (r[x] > r[y]))  # two that live here meet in both orders
        once[once] = _first_cell(keys[rows[x[once]]], keys[rows[y[once]]]) == key
        x, y = x[once], y[once]
        count = np.bincount(x, n[rows[y]], len(rows)) + np.bincount(y, n[rows[x]], len(rows))
        found += [(cls[rows[p]], None, int(count[p])) for p in np.flatnonzero(count)]
    return found


_FOUND = pa.schema([("cls", pa.binary()), ("other", pa.binary()), ("links", pa.int64())])


def links(distinct: DataFrame, least: float = LEAST_COSINE, side: int = TILE) -> DataFrame:
    """(cls, other, links) over all cells, for distinct classes (cls, n, vector, label).

    Rows without ``other`` add to the links of ``cls``; the others are links
    that connect what all links connect. A cell of more than ``side`` members
    is cut into tiles of about ``side`` stored and storing ones; each member
    goes to all tiles of its row or column, so a cell of m members sends about
    m * m / side rows and no pair is one.
    """
    every = cut(keyed(distinct))
    entries = every.select("cls", F.posexplode("keys").alias("at", "key")).select("cls", "key", (F.col("at") % (1 + PROBES) == 0).alias("home"))
    busy = entries.groupBy("key").agg(F.count_if("home").alias("homes"), F.count("*").alias("all")).where("homes > 0 AND all > 1")
    parts = lambda c: F.when(F.col("all") <= side, 1).otherwise(F.ceil(F.col(c) / side)).cast("int")
    own = lambda c: F.pmod(F.xxhash64("cls"), parts(c)).cast("int")
    each = lambda c, f: F.transform(F.sequence(F.lit(0), parts(c) - 1), f)
    spot = lambda i, j, storing, stored: F.struct(i.alias("i"), j.alias("j"), storing.alias("storing"), stored.alias("stored"))
    no, yes = F.lit(False), F.lit(True)
    stores = each("all", lambda j: spot(own("homes"), j, yes, no))
    is_stored = each("homes", lambda i: spot(i, own("all"), no, yes))
    spots = F.when(F.col("all") <= side, F.array(spot(F.lit(0), F.lit(0), F.col("home"), yes))).otherwise(F.when(F.col("home"), F.concat(stores, is_stored)).otherwise(is_stored))
    members = entries.join(busy, "key").select("key", "cls", "home", F.explode(spots).alias("s")).select("key", "cls", "home", "s.*").join(every, "cls")
    tiles = members.groupBy("key", "i", "j").agg(F.collect_list(F.struct("cls", "label", "home", "storing", "stored", "n", "keys", "vector")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, group in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found += tile(key, group.values, least)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate(_FOUND.types)], schema=_FOUND)

    return tiles.select("key", "members").mapInArrow(run, "cls binary, other binary, links long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST_COSINE) -> DataFrame:
    """(id, n_links, component, kept) of every row.

    Only rows of equal label and dimension link. Equal vectors meet first and
    count by their number, so copies are never paired. Vectors that are null,
    empty, zero or hold null or non-finite parts, and rows of null label, link
    with nothing and stay alone. Repeated rows link with each other. The
    component is the smallest id reachable; rows without id take part, and
    where nothing reachable has an id the component is null and kept false. An
    empty table gives no rows; other columns are not looked at.
    """
    rows = cut(_classes(vectors, id_col, vector_col, label_col))
    distinct = cut(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first("vector").alias("vector"), F.first("label").alias("label")))
    found = cut(links(distinct, least))
    others = found.where("other IS NULL").groupBy("cls").agg(F.sum("links").alias("others"))
    groups = connected_components(found.where("other IS NOT NULL"), "cls", "other").withColumnRenamed("node", "cls")
    named = distinct.select("cls", "first", "n").join(groups, "cls", "left").withColumn("root", F.coalesce("component", "cls"))
    least_id = named.groupBy("root").agg(F.min("first").alias("least"))
    per = named.join(least_id, "root").join(others, "cls", "left").select("cls", "least", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    alone = F.col("cls").isNull()
    out = rows.select("id", "cls").join(per, "cls", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("least")).alias("component"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component"), F.lit(False)))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("component", "component_id")


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS m FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.m * b.m) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = e.vec_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = e.vec_id
"""
