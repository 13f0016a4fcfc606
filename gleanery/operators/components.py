"""Connected components over an edge table, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the smallest one it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the smallest."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    inner = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _in_one_task(edges: DataFrame, kind: str) -> DataFrame:
    """(node, component) of edges (u, v) that one task can hold, by union-find; the smaller root stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        node_type = None

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            node_type = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p, q = root(u), root(v)
                parent[max(p, q)] = min(p, q)
        if parent:
            nodes = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, node_type), pa.array([root(x) for x in nodes], node_type)], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, small: int = 0) -> DataFrame:
    """Smallest reachable node of every node that has an edge: (node, component).

    Edges are undirected; nulls and self loops are ignored, repeated edges
    count once. Nodes may be of any ordered type. Rounds grow with the
    logarithm of the component size, not with its diameter, and each one is
    written to the shared folder. A hub is met only by combinable minima and
    by a join whose other side has one row per node, which Spark may split. Edges
    that are counted to be ``small`` in number or fewer go to one task, which
    saves the rounds and gives the same rows.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    now = cut(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    if small and now.limit(small + 1).count() <= small:
        return _in_one_task(now, dict(now.dtypes)["u"])
    mark = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark or seen[0] == 0:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
