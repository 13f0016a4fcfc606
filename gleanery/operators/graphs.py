"""Graph operators over edge tables (src, dst). Loops write each round to the shared folder.

Repeated edges count once; an empty table has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.components import connected_components
from gleanery.session import cut


def adjacency(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct targets of each node, an edge a row; edges from or to null are left out."""
    return edges.select(src, dst).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).distinct()


def uncalled(defs: DataFrame, edges: DataFrame, name: str, dst: str = "dst") -> DataFrame:
    """Definitions that no edge leads to."""
    return defs.join(edges.select(F.col(dst).alias(name)).distinct(), name, "left_anti")


def calls_of(edges: DataFrame, name, dst: str = "dst") -> DataFrame:
    return edges.where(F.col(dst) == name)


#: Rounds by single edges after which whole paths join.
SHORT_ROUNDS = 16
#: Frames of a union that are written as one again.
PARTS = 12


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path of one edge or more, by semi-naive rounds: only new pairs join again.

    New pairs first grow by one edge a round. Where after SHORT_ROUNDS some
    are still new they join all pairs there are, which doubles the length each
    round, so the rounds grow with its logarithm. Each round writes the new
    pairs only. Nulls are no nodes.
    """
    step = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    parts, delta, rounds = [step], step, 0
    while True:
        seen = reduce(DataFrame.unionByName, parts)
        onward = (step if rounds < SHORT_ROUNDS else seen).select(F.col("src").alias("dst"), F.col("dst").alias("to"))
        more = delta.join(onward, "dst").select("src", F.col("to").alias("dst")).distinct()
        delta = cut(more.join(seen, ["src", "dst"], "left_anti"))
        if delta.isEmpty():
            return seen
        rounds += 1
        parts.append(delta)
        if len(parts) > PARTS:
            parts = [cut(reduce(DataFrame.unionByName, parts))]


#: Rounds by single edges after which shortcuts are made for what is not reached yet.
PLAIN_ROUNDS = 8


def shortcuts(step: DataFrame) -> DataFrame:
    """(node, to, hops): where 2, 4, 8, ... steps along one way out of each node lead.

    Every node that goes on points at one of its targets that goes on, too;
    pointers then jump to where the one they point at points. A long way is
    covered in as many of these as its length has binary digits. Nodes of no
    way out drop out, so a round writes one row for each that is left.
    """
    out = step.select(F.col("node").alias("to")).distinct()
    first = step.where("node <> to").join(out, "to", "left_semi").groupBy("node").agg(F.min_by("to", F.xxhash64("node", "to")).alias("to"))
    now, parts, hops, most = cut(first), [], 1, None
    most = now.count()
    while hops < most:
        now = cut(now.join(now.select(F.col("node").alias("to"), F.col("to").alias("onward")), "to").select("node", F.col("onward").alias("to")))
        hops *= 2
        if now.isEmpty():
            break
        parts.append(now.withColumn("hops", F.lit(hops)))
    empty = first.withColumn("hops", F.lit(1)).limit(0)
    return reduce(DataFrame.unionByName, parts, empty)


class _Written:
    """Rows that are only added to. Each PARTS frames of one size are written as one, so a row is copied as often as the rounds have digits."""

    def __init__(self, first: DataFrame):
        self.parts = [(0, first)]

    def add(self, more: DataFrame) -> None:
        self.parts.append((0, more))
        while len(last := self.parts[-PARTS:]) == PARTS and len({level for level, _ in last}) == 1:
            self.parts[-PARTS:] = [(last[0][0] + 1, cut(reduce(DataFrame.unionByName, [df for _, df in last])))]

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [df for _, df in self.parts])


def _steps(edges: DataFrame, backward: bool) -> DataFrame:
    a, b = ("dst", "src") if backward else ("src", "dst")
    return cut(edges.select(F.col(a).alias("node"), F.col(b).alias("to")).where("node IS NOT NULL AND to IS NOT NULL").distinct())


def reach_depth(edges: DataFrame, seeds: DataFrame, depth: int | None = None, backward: bool = False) -> DataFrame:
    """(node, depth) of what the seeds (node) reach, themselves at depth 0: fewest edges, at most ``depth``.

    Rounds go by single edges, and each one writes the new nodes only. Where ``depth`` is
    open and PLAIN_ROUNDS leave some way to go, shortcuts are made once. From
    then on a node's depth may be mended, until none can be: a way along
    shortcuts is never shorter than the fewest edges, and the shortest one is found
    by its own edges at the latest.
    """
    step = _steps(edges, backward)
    front = cut(seeds.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    seen, k = _Written(front), 0
    while depth is None or k < depth:
        if depth is None and k == PLAIN_ROUNDS:
            return _mended(step, seen.rows(), front)
        k += 1
        more = front.select("node").join(step, "node").select(F.col("to").alias("node")).distinct()
        front = cut(more.join(seen.rows().select("node"), "node", "left_anti").withColumn("depth", F.lit(k)))
        if front.isEmpty():
            break
        seen.add(front)
    return seen.rows()


def _mended(step: DataFrame, seen: DataFrame, front: DataFrame) -> DataFrame:
    """Depths by label correction over edges and shortcuts; rounds write what got better."""
    far = cut(step.withColumn("hops", F.lit(1)).unionByName(shortcuts(step)))
    known = _Written(seen)
    while True:
        reached = front.join(far, "node").groupBy(F.col("to").alias("node")).agg(F.min(F.col("depth") + F.col("hops")).alias("depth"))
        best = known.rows().groupBy("node").agg(F.min("depth").alias("known"))
        front = cut(reached.join(best, "node", "left").where("known IS NULL OR depth < known").select("node", "depth"))
        if front.isEmpty():
            return known.rows().groupBy("node").agg(F.min("depth").alias("depth"))
        known.add(front)


def reachable(edges: DataFrame, seeds: DataFrame, backward: bool = False) -> DataFrame:
    """Nodes in the cone of the seeds (node), themselves included.

    Rounds write new nodes only. After PLAIN_ROUNDS shortcuts are added to the
    edges once, so that a long way takes rounds by the logarithm of its length.
    """
    step = _steps(edges, backward)
    front = cut(seeds.select("node").where("node IS NOT NULL").distinct())
    seen, k = _Written(front), 0
    while True:
        if k == PLAIN_ROUNDS:
            step = cut(step.unionByName(shortcuts(step).select("node", "to")).distinct())
        k += 1
        more = front.join(step, "node").select(F.col("to").alias("node")).distinct()
        front = cut(more.join(seen.rows(), "node", "left_anti"))
        if front.isEmpty():
            return seen.rows()
        seen.add(front)


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Class label of each element of a symmetric, transitive relation given by pairs."""
    return connected_components(pairs, a, b)


#: Rounds of peeling; what is left over then only makes the rest larger.
PEELINGS = 8
#: Edges of what peeling and contraction leave up to which one task finds the strong components; more are coloured.
FEW_EDGES = 300_000


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without a way in or out are peeled off, PEELINGS layers at most."""
    left, size = edges, None
    for _ in range(PEELINGS):
        into, out = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = cut(left.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
        now = left.count()
        if now in (size, 0):
            break
        size = now
    return left


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the greatest node that reaches each node, itself included. Shortcuts carry colours over long ways."""
    both = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    colours = cut(both.distinct().withColumn("colour", F.col("node")))
    front, far, k = colours, edges, 0
    while True:
        if k == PLAIN_ROUNDS:
            jumps = shortcuts(edges.select(F.col("src").alias("node"), F.col("dst").alias("to")))
            far = cut(edges.unionByName(jumps.select(F.col("node").alias("src"), F.col("to").alias("dst"))).distinct())
        k += 1
        sent = front.join(far, front["node"] == far["src"]).groupBy(F.col("dst").alias("to")).agg(F.max("colour").alias("sent"))
        front = cut(colours.join(sent, F.col("node") == F.col("to")).where("sent > colour").select("node", F.col("sent").alias("colour")))
        if front.isEmpty():
            return colours
        colours = cut(colours.join(front.withColumnRenamed("colour", "new"), "node", "left").select("node", F.coalesce("new", "colour").alias("colour")))


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (src, dst, tail) between nodes of several ways in or out, links (node, tail) between, and nodes of plain rings.

    A link has one way in and one way out. Links point at the next node and
    pointers jump, so a chain of n links takes log n rounds; ``tail`` is its last
    link, or null for an edge without links. Links that never come to another
    node are rings by themselves.
    """
    single = lambda c, o: edges.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("n"), F.first(o).alias("other")).where("n = 1").select("node", "other")
    links = cut(single("src", "dst").withColumnRenamed("other", "to").join(single("dst", "src").select("node"), "node"))
    ids = links.select(F.col("node").alias("to"), F.lit(True).alias("onward"))
    now = cut(links.join(ids, "to", "left").select("node", "to", F.col("node").alias("tail"), F.coalesce("onward", F.lit(False)).alias("onward")))
    done = now.where("NOT onward").select("node", "to", "tail")
    written, now = _Written(cut(done)), cut(now.where("onward"))
    for _ in range(links.count().bit_length() + 1):
        if now.isEmpty():
            break
        ends = written.rows().select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("tail").alias("its"), F.lit(False).alias("still"))
        going = now.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("tail").alias("its"), F.lit(True).alias("still"))
        moved = cut(now.join(ends.unionByName(going), "to").select("node", F.col("next").alias("to"), F.col("its").alias("tail"), F.col("still").alias("onward")))
        written.add(moved.where("NOT onward").select("node", "to", "tail"))
        now = moved.where("onward").select("node", "to", "tail")
    chains = written.rows()
    outer = edges.join(links.select(F.col("node").alias("src")), "src", "left_anti")
    short = outer.join(chains.select(F.col("node").alias("dst"), F.col("to").alias("end"), "tail"), "dst", "left").select("src", F.coalesce("end", "dst").alias("dst"), "tail")
    return cut(short), chains.select("node", "tail"), now.select("node")


def _strong(out: dict) -> Iterator[list]:
    """Members of each strong component of two nodes or more, of targets by node, in one walk (Tarjan)."""
    index, low, stack, on = {}, {}, [], set()
    for start in out:
        way = [] if start in index else [(None, iter([start]))]
        while way:
            node, targets = way[-1]
            for to in targets:
                if to not in index:
                    index[to] = low[to] = len(index)
                    stack.append(to)
                    on.add(to)
                    way.append((to, iter(out.get(to, ()))))
                    break
                if to in on and node is not None:
                    low[node] = min(low[node], index[to])
            else:
                way.pop()
                if node is None:
                    continue
                if (up := way[-1][0]) is not None:
                    low[up] = min(low[up], low[node])
                if low[node] == index[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                    on.difference_update(members)
                    if len(members) > 1:
                        yield members


def _strong_in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, kind = {}, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.setdefault(a, []).append(b)
        rows = [(x, max(members)) for members in _strong(out) for x in members]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k in (0, 1)], ["node", "component"])

    kind = dict(edges.dtypes)["src"]
    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the members of strong components of two nodes or more; the component is named by one of them.

    Each node takes the greatest node that reaches it as its colour; what
    reaches the colour's own node within the colour is that node's component.
    Components are taken out, the rest is trimmed and coloured again. FEW_EDGES
    or fewer, by count, go to one task, which saves the rounds. Nulls are no nodes.
    """
    edges = edges.select("src", "dst").where("src <> dst").distinct()
    left, found = _trimmed(edges), []
    while not left.isEmpty():
        if left.count() <= FEW_EDGES:
            found.append(_strong_in_one_task(left))
            break
        colours = _coloured(left)
        of = lambda c: colours.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))  # noqa: B023, E731
        inner = cut(left.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", "dst"))
        one = cut(reachable(inner, colours.where("node = colour").select("node"), backward=True).join(colours, "node"))
        several = one.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
        found.append(one.join(several, "colour", "left_semi").select("node", F.col("colour").alias("component")))
        gone = lambda c: one.select(F.col("node").alias(c))  # noqa: B023, E731
        left = _trimmed(left.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti"))
    return reduce(DataFrame.unionByName, found, edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0))


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that can reach themselves: members of a strong component of several nodes, or with an edge to themselves.

    What has no way in or no way out is peeled off, chains of nodes with one
    way in and one out are contracted in log rounds, which settles plain
    rings, and strong components are sought in what is left. A chain is on a
    cycle if the nodes at its ends are the same or of one component. Nulls are no nodes.
    """
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    left = _trimmed(edges.where("src <> dst"))
    if left.isEmpty():
        return loops
    short, links, rings = _contracted(left)
    strong = cut(strong_components(short))
    of = lambda c: strong.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    around = short.join(of("src"), "src", "left").join(of("dst"), "dst", "left").where("src = dst OR src_in = dst_in")
    on_chains = links.join(around.select("tail").distinct(), "tail", "left_semi").select("node")
    parts = [loops, rings, around.where("src = dst").select(F.col("src").alias("node")), strong.select("node"), on_chains]
    return reduce(DataFrame.unionByName, parts).distinct()


def lock_edges(trace: DataFrame, thread: list[str], order: list[str], op: str, lock: str) -> DataFrame:
    """(held, taken) where a thread takes a lock while it holds another; distinct.

    An acquisition holds until the thread's next release of that lock. What is
    released in one place of the order is not held there any more, what is
    acquired there is held after it. Rows without thread or lock say nothing.

    The trace is dealt out by ranges of (thread, order), so that a thread may
    lie in many pieces. A piece begins with the locks whose last event in the
    pieces before it was an acquisition; these go in front of its rows, and
    the piece is read once, in order, with the set of locks that are held.
    """
    count = max(2, int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [f"t{i}" for i in range(len(thread))]
    rows = trace.select(*[F.col(c).alias(k) for c, k in zip(thread, keys, strict=True)], F.struct(*order).alias("at"), (F.col(op) == "acquire").alias("takes"), F.col(lock).alias("lock"), (F.col(op) == "release").alias("frees"))
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, "lock"]]) & (F.col("takes") | F.col("frees")))
    rows = cut(rows.repartitionByRange(count, *keys, "at").withColumn("piece", F.spark_partition_id()).drop("frees"))
    # Of a lock's last place in a piece the acquisition counts, as it holds after it.
    last = rows.groupBy(*keys, "lock", "piece").agg(F.max(F.struct("at", "takes")).alias("last"))
    w = Window.partitionBy(*keys, "lock").orderBy("piece")
    ends = rows.groupBy(*keys).agg(F.max("piece").alias("end"))
    carried = last.withColumn("until", F.lead("piece").over(w)).where("last.takes").join(ends, keys).withColumn("until", F.coalesce("until", "end")).where("until > piece")
    carried = carried.select(*keys, F.lit(None).cast(rows.schema["at"].dataType).alias("at"), F.lit(True).alias("takes"), "lock", F.explode(F.sequence(F.col("piece") + 1, F.col("until"))).alias("piece"))
    kind = dict(trace.dtypes)[lock]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, freed, fresh, key, at = set(), set(), set(), None, None
        for batch in batches:
            pairs = set()
            *threads, places, takes, locks = (c.to_pylist() for c in batch.columns)
            for *who, place, take, name in zip(*threads, places, takes, locks, strict=True):
                if who != key:
                    held, freed, fresh, key, at = set(), set(), set(), who, place
                elif place != at:
                    held, freed, fresh, at = (held - freed) | fresh, set(), set(), place
                if place is None:
                    held.add(name)
                elif take:  # acquisitions come after the releases of their place
                    pairs.update((h, name) for h in held - freed if h != name)
                    fresh.add(name)
                else:
                    freed.add(name)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], batch.schema.field(batch.num_columns - 1).type) for k in (0, 1)], ["held", "taken"])

    dealt = rows.unionByName(carried).repartitionById(count, "piece").sortWithinPartitions(*keys, "at", "takes")
    return dealt.select(*keys, F.to_json("at").alias("at"), "takes", "lock").mapInArrow(run, f"held {kind}, taken {kind}").distinct()


def perm_cycles(df: DataFrame, i: str, p: str) -> DataFrame:
    """(node, component) of the members of each cycle of more than one element."""
    return connected_components(df, i, p)
