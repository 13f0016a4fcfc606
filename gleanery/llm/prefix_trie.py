"""Conversation prefix trie, rolled up over a centroid decomposition.

A node is a distinct sequence of first turns; it is named by its smallest
member and its depth. What each node says of its whole subtree comes from
the parent edges by centroids: of every component the node is taken out
whose removal leaves no part of more than half the weight; the totals of the
parts below it are added up, go to the centroid and to the nodes on the path
from it to the component's top, and each part is a component of its own from
then on. So a chain of a million turns takes some twenty rounds, like a wide tree.
Rounds run as joins until components have few nodes; these are finished by the
same method inside tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.running import Running
from gleanery.session import cut

#: Nodes of a component that one task may finish by itself.
SMALL = 4096
#: Components up to which their figures, a row each, are broadcast; more are joined.
BROADCAST_ROWS = 100_000
#: Characters of conversation ids that are hashed at once.
CHUNK = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def _few(df: DataFrame) -> DataFrame:
    """The rows, marked for broadcast if counting finds them few. They are some numbers each."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, h1, h2, chars) of every turn of a conversation, depth from 1.

    Turns are in the order of ``turn``, null first, then of role, then of a
    hash of the text. Null role and text are empty. Rows without ``conv_id``
    belong to no conversation and are left out.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(1), "role").alias("h2"), F.length("text").cast("long").alias("chars"))
    placed = Running(rows, ["conv_id"], ["turn", "role", "h1", "h2"]).add("depth", "sum", F.lit(1)).done()
    return placed.select("conv_id", F.col("depth").cast("long"), "h1", "h2", "chars")


def rebuilt(own: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: rows as of ``turns``, and (conv_id, n_turns) of each one.

    Conversation c takes the first h turns of conversation c - c % every, then
    its own after its first h; h is the crc32 of its decimal id modulo most.
    """
    sizes = own.groupBy("conv_id").agg(F.max("depth").alias("n"))
    c = sizes.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    known = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    c = c.join(known, "base", "left").withColumn("b", F.least("h", F.coalesce("n_base", F.lit(0))))
    c = cut(c.select("conv_id", "base", "h", "b", (F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("n_turns")))
    heads = own.where(F.col("depth") < most).withColumnRenamed("conv_id", "base")
    first = c.where("b > 0").select("conv_id", "base", "b").join(heads, "base").where("depth <= b")
    rest = own.join(c.select("conv_id", "h", "b"), "conv_id").where("depth > h").withColumn("depth", F.col("depth") - F.col("h") + F.col("b"))
    names = ["conv_id", "depth", "h1", "h2", "chars"]
    return first.select(*names).unionByName(rest.select(*names)), c.select("conv_id", "n_turns")


def owners_of(seqs: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (m, depth, n_convs, chars, s), and (conv_id, depth, m, pm): which node a conversation passes at each depth.

    A node is (m, depth), m its smallest member; pm is the parent's. Prefixes
    are told apart by running sums of two hashes of turn and place, 128 bits in
    all. ``s`` is the weight of the subtree, where a node weighs as many as
    its members.
    """
    at = lambda h: F.xxhash64(h, "depth").cast("decimal(20,0)")
    paths = Running(seqs, ["conv_id"], ["depth"]).add("a", "sum", at("h1")).add("b", "sum", at("h2")).done()
    paths = cut(paths.join(convs, "conv_id").select("conv_id", "depth", "a", "b", "chars", (F.col("n_turns") - F.col("depth") + 1).alias("s")))
    key = ["depth", "a", "b"]
    nodes = paths.groupBy(*key).agg(F.min("conv_id").alias("m"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"), F.sum("s").alias("s"))
    nodes = cut(nodes)
    top = cut(convs.agg(F.min("conv_id").alias("m"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("chars"), F.sum(F.col("n_turns") + 1).alias("s")).where("n_convs > 0").withColumn("depth", F.lit(0).cast("long")))
    at_top = convs.select("conv_id", F.lit(0).cast("long").alias("depth")).crossJoin(F.broadcast(top.select("m")))  # one row
    own = cut(paths.join(nodes.select(*key, "m"), key).select("conv_id", "depth", "m").unionByName(at_top))
    before = own.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("m").alias("pm"))
    return nodes.drop("a", "b").unionByName(top), own.join(before, ["conv_id", "depth"], "left")


def centroid_rollup(parents: list[int], values: list[tuple]) -> list[tuple]:
    """Sums over the subtree of each node of a tree, by centroids. Parents come before their children; the top has -1."""
    width = len(values[0]) if values else 0
    total = [[0] * width for _ in parents]

    def add(v: int, more: list) -> None:
        total[v] = [x + y for x, y in zip(total[v], more, strict=True)]

    open_ = [list(range(len(parents)))] if parents else []
    while open_:
        part = open_.pop()
        top = part[0]
        if len(part) == 1:
            add(top, values[top])
            continue
        size = dict.fromkeys(part, 1)
        for v in part[:0:-1]:
            size[parents[v]] += size[v]
        c = next(v for v in reversed(part) if 2 * size[v] >= len(part))
        label: dict[int, int] = {}
        below: dict[int, list[int]] = {}
        above = []
        for v in part:
            if v == c:
                continue
            child = v if v != top and parents[v] == c else label.get(parents[v]) if v != top else None
            if child is None:
                above.append(v)
            else:
                label[v] = child
                below.setdefault(child, []).append(v)
        sums = [sum(x) for x in zip(values[c], *(values[v] for vs in below.values() for v in vs), strict=True)]
        add(c, sums)
        v = c
        while v != top:
            v = parents[v]
            add(v, sums)
        open_ += [*below.values(), *([above] if above else [])]
    return [tuple(x) for x in total]


def _finished(parts: DataFrame, values: list[str]) -> DataFrame:
    """(m, depth, values) of components of at most SMALL nodes: what is known plus the sums within the component."""
    names = ["m", "depth", *values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        found: list[tuple] = []
        k = len(values)
        for _, part in groupby(rows(), lambda r: r[:2]):
            part = list(part)
            place = {r[2:4]: i for i, r in enumerate(part)}
            sums = centroid_rollup([place[(r[4], r[3] - 1)] if i else -1 for i, r in enumerate(part)], [r[5 : 5 + k] for r in part])
            found += [(*r[2:4], *(x + y for x, y in zip(s, r[5 + k :], strict=True))) for r, s in zip(part, sums, strict=True)]
            if len(found) >= 8192:
                yield made(found)
                found = []
        yield made(found)

    def made(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    rows = parts.repartition("cm", "cd").sortWithinPartitions("cm", "cd", "depth").select("cm", "cd", "m", "depth", "pm", *values, *[f"more_{v}" for v in values])
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def rollup(nodes: DataFrame, owners: DataFrame, values: list[str], small: int | None = None) -> DataFrame:
    """(m, depth, values): each value summed over the subtree of each node.

    ``nodes`` have (m, depth, pm, s) and the values. A round takes one
    centroid out of every component of more than ``small`` nodes. A node
    finds its side by one lookup in ``owners``: below the centroid's depth the
    ancestor of its own that stands there, else the node of the centroid's
    path at its depth. Rows are only joined by keys of their own or to one row
    of a component.
    """
    small = SMALL if small is None else small
    more = [f"more_{v}" for v in values]
    root = nodes.where("depth = 0").select(F.col("m").alias("cm"), F.lit(0).cast("long").alias("cd"))
    live = nodes.crossJoin(F.broadcast(root))  # one row
    live = live.select("cm", "cd", "m", "depth", "pm", "s", *values, *[F.lit(0).cast("long").alias(c) for c in more])
    look = owners.select(F.col("conv_id").alias("lc"), F.col("depth").alias("ld"), F.col("m").alias("lm"), F.col("pm").alias("lpm"))
    parts, ends = [], []
    while True:
        live = cut(live)
        sizes = cut(live.groupBy("cm", "cd").agg(F.count("*").alias("n"), F.max("s").alias("whole")))
        large = _few(sizes.where(F.col("n") > small).drop("n"))
        parts.append(live.join(large, ["cm", "cd"], "left_anti"))
        live = live.join(large, ["cm", "cd"])
        # The nodes with half the weight or more are a path from the top; it ends in the centroid.
        deepest = F.max_by(F.struct("m", "depth", F.col("s").alias("gone")), "depth").alias("c")
        centroids = cut(live.where(F.col("s") * 2 >= F.col("whole")).groupBy("cm", "cd").agg(deepest).select("cm", "cd", "c.m", "c.depth", "c.gone").toDF("cm", "cd", "zm", "zd", "gone"))
        if centroids.isEmpty():
            break
        deeper = F.col("depth") > F.col("zd")
        seen = live.join(_few(centroids), ["cm", "cd"]).withColumn("lc", F.when(deeper, F.col("m")).otherwise(F.col("zm"))).withColumn("ld", F.when(deeper, F.col("zd") + 1).otherwise(F.col("depth")))
        side = F.when(deeper & (F.col("lpm") == F.col("zm")), "below").when(~deeper & (F.col("lm") == F.col("m")), F.when(F.col("depth") == F.col("zd"), "centroid").otherwise("path")).otherwise("other")
        seen = cut(seen.join(look, ["lc", "ld"], "left").withColumn("side", side).drop("whole"))
        under = seen.where("side IN ('below', 'centroid')").groupBy("zm", "zd").agg(*[F.sum(v).alias(f"sum_{v}") for v in values])
        under = _few(cut(under))
        added = lambda rows: rows.join(under, ["zm", "zd"]).withColumns({f"more_{v}": F.col(f"more_{v}") + F.col(f"sum_{v}") for v in values})
        ends.append(added(seen.where("side = 'centroid'")).select("m", "depth", *[F.col(c).alias(v) for c, v in zip(more, values, strict=True)]))
        names = ["cm", "cd", "m", "depth", "pm", "s", *values, *more]
        live = reduce(
            DataFrame.unionByName,
            [
                seen.where("side = 'below'").withColumns({"cm": F.col("lm"), "cd": F.col("ld")}).select(*names),
                added(seen.where("side = 'path'")).withColumn("s", F.col("s") - F.col("gone")).select(*names),
                seen.where("side = 'other'").select(*names),
            ],
        )
    return reduce(DataFrame.unionByName, [_finished(reduce(DataFrame.unionByName, parts), values), *ends])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node as text, CHUNK characters at most, numbered in order."""
    found: list[tuple] = []
    key, ids, size, number = None, [], 0, 0
    for batch in batches:
        for m, depth, id_, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (key != (m, depth, piece) or size >= CHUNK):
                found.append((*key, number, ",".join(ids)))
                ids, size, number = [], 0, number + 1
                if len(found) >= 1024:
                    yield _chunk_rows(found)
                    found = []
            key, word = (m, depth, piece), str(id_)
            ids.append(word)
            size += len(word) + 1
    if ids:
        found.append((*key, number, ",".join(ids)))
    yield _chunk_rows(found)


def _chunk_rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["m", "depth", "piece", "number", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    found: list[tuple] = []
    for key, part in groupby(rows(), lambda r: r[:2]):
        digest = None
        for _, _, ids in part:
            if digest is None:
                digest = hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        found.append((*key, digest.hexdigest()))
    columns = list(zip(*found, strict=True)) or [()] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string()], strict=True)], ["m", "depth", "ends_sha256"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(m, depth, ends_sha256): the hash of the ids of a node's own members in ascending order.

    Ids are sorted and written out by ranges, so that a node of very many is
    shared by many tasks; one task then feeds its chunks of text to the hash, in order.
    """
    count = max(2, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = ends.select("m", "depth", "conv_id").repartitionByRange(count, "m", "depth", "conv_id").withColumn("piece", F.spark_partition_id()).sortWithinPartitions("m", "depth", "conv_id")
    chunks = ordered.mapInArrow(_chunks, "m long, depth long, piece int, number long, ids string")
    chunks = chunks.repartition("m", "depth").sortWithinPartitions("m", "depth", "piece", "number")
    return chunks.select("m", "depth", "ids").mapInArrow(_hashes, "m long, depth long, ends_sha256 string")


def prefix_trie(seqs: DataFrame, convs: DataFrame, small: int | None = None) -> DataFrame:
    """The nodes of the trie of conversations.

    ``seqs`` has rows as of ``turns``, ``convs`` (conv_id, n_turns) of every
    conversation, those of no turns included. Conversations that are equal
    share all nodes. No conversations give no nodes. Sums are over whole
    subtrees, the node included: ``n_leaves`` of nodes without children,
    ``saved_tokens`` of (members - 1) times the characters of the last turn.
    """
    nodes, owners = owners_of(seqs, convs)
    owners = cut(owners)
    nodes = nodes.join(owners.select(F.col("conv_id").alias("m"), "depth", "pm"), ["m", "depth"], "left")
    nodes = cut(nodes)
    children = nodes.where("depth > 0").groupBy(F.col("pm").alias("m"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, ["m", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    values = nodes.select("m", "depth", "pm", "s", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = rollup(values, owners, ["n_leaves", "saved_tokens"], small)
    last = owners.join(convs, "conv_id").where("depth = n_turns")
    found = nodes.join(totals, ["m", "depth"]).join(ends_hashes(last), ["m", "depth"], "left")
    return found.select(
        F.col("m").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("pm")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that they share beginnings."""
    own = cut(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    seqs, convs = rebuilt(own)
    return prefix_trie(cut(seqs), convs)


def _crc32(text: str) -> str:
    """Unsigned crc32 of ASCII text, bit by bit."""
    bit = "lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)"
    byte = f"lambda s, x: list_reduce(list_prepend(xor(s, x), [0::UBIGINT for k in range(8)]), {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, [ord(x)::UBIGINT for x in string_split({text}, '')]), {byte}), 4294967295::UBIGINT)"


SQL = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, ({_crc32("conv_id::VARCHAR")} % 6)::BIGINT AS h, max(place) AS n FROM t GROUP BY ALL),
b AS (SELECT c.*, least(c.h, coalesce(d.n, 0)) AS b FROM c LEFT JOIN c d ON d.conv_id = c.base),
r AS (
  SELECT b.conv_id, place AS depth, role, text FROM b JOIN t ON t.conv_id = b.base AND place <= b.b
  UNION ALL SELECT b.conv_id, place - b.h + b.b, role, text FROM b JOIN t ON t.conv_id = b.conv_id AND place > b.h),
p AS (SELECT conv_id, depth, length(text) AS chars, string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r),
q AS (SELECT conv_id, depth, chars, sha256(path) AS path FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM c),
o AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, path) AS m, depth = max(depth) OVER (PARTITION BY conv_id) AS at_end FROM q),
n AS (
  SELECT m, depth, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, sha256(coalesce(string_agg(CASE WHEN at_end THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends FROM o GROUP BY m, depth),
f AS (SELECT n.*, u.m AS pm FROM n LEFT JOIN o u ON u.conv_id = n.m AND u.depth = n.depth - 1),
k AS (SELECT pm AS m, depth - 1 AS depth, count(*) AS n_children FROM f WHERE depth > 0 GROUP BY ALL),
g AS (SELECT f.*, coalesce(n_children, 0) AS n_children FROM f LEFT JOIN k USING (m, depth)),
s AS (SELECT u.m, u.depth, sum(CASE WHEN g.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(g.saved) AS saved FROM g JOIN o u ON u.conv_id = g.m AND u.depth <= g.depth GROUP BY ALL)
SELECT g.m AS conv_id, g.depth::BIGINT AS depth, g.pm AS parent_conv_id, g.n_convs::BIGINT AS n_convs, g.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, g.ends AS ends_sha256
FROM g JOIN s USING (m, depth)
"""
