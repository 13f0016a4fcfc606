"""Ranked lexical search by a dual-tree over items and documents.

A document is a sparse vector of term impacts, an item one of term weights;
the score is their inner product in whole numbers. Nodes of either hierarchy
hold the coordinate maxima of what is below them, so the product of two nodes
bounds the score of every pair below. Pairs of nodes whose bound is under the
weakest kth score of the node's items are dropped whole; that is exact.

Documents are ordered by their strongest term and cut into blocks of bounded
size. Blocks are held against items by one join over terms. First every item's
most promising blocks are searched, which gives kth scores to start from, then
all others that these do not rule out. Within a block and a set of items
the hierarchies go on in numpy, down to a few documents and items.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import cut

TOP = 10
#: Terms of all items, and their bytes, up to which they are sent to tasks; more are joined by term.
VOCABULARY, VOCABULARY_BYTES = 200_000, 8 << 20
#: Rows of a few numbers each up to which a table is broadcast.
BROADCAST_ROWS = 200_000
#: Bounds on what is searched at once: documents and postings of a block, items of a set.
BLOCK_DOCS, BLOCK_POSTINGS, SET_ITEMS = 1024, 1 << 20, 256
#: Documents and items of a lowest node, and nodes below a node.
LEAF_DOCS, LEAF_ITEMS, FANOUT = 16, 4, 4
#: Blocks that are searched first for each item.
SEEDS = 2
_DELIMITERS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_TABLE = bytes(32 if chr(c) in _DELIMITERS else c + 32 if 65 <= c <= 90 else c for c in range(128)) + bytes(range(128, 256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in order: runs of ASCII letters, digits and whatever is not ASCII, ``A-Z`` lower-cased."""
    return (text or b"").translate(_TABLE).split()


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _counted(rows: DataFrame, id_type: str, wanted: dict[bytes, int] | None) -> DataFrame:
    """(uid, id, n, terms, tids, tfs): how often each term stands in a text, all terms or, by number, the wanted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = frozenset(wanted or ())
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, names, numbers, tfs = [], [], [], []
                for text in part.column(1):
                    found = Counter(terms(text.as_py()))
                    n.append(found.total())
                    known = found.keys() if wanted is None else keys & found.keys()
                    names.append(list(known) if wanted is None else [])
                    numbers.append([] if wanted is None else [wanted[t] for t in known])
                    tfs.append([found[t] for t in known])
                columns = [pa.array(range(uid, uid + part.num_rows), pa.int64()), part.column(0), pa.array(n, pa.int64()), pa.array(names, pa.list_(pa.binary())), pa.array(numbers, pa.list_(pa.int64())), pa.array(tfs, pa.list_(pa.int64()))]
                uid += part.num_rows
                yield pa.RecordBatch.from_arrays(columns, ["uid", "id", "n", "terms", "tids", "tfs"])

    return rows.mapInArrow(run, f"uid long, id {id_type}, n long, terms array<binary>, tids array<long>, tfs array<long>")


def items_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ikey, item_id) of every distinct row, and (ikey, term, q) of its terms."""
    rows = cut(benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()).withColumn("ikey", F.monotonically_increasing_id())
    counts = _counted(rows.select("ikey", F.col("text").cast("binary")), "long", None)
    return rows.select("ikey", "item_id"), counts.select(F.col("id").alias("ikey"), F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("q"))).alias("x")).select("ikey", "x.*")


def weight(n_docs: Column, df: Column) -> Column:
    """Weight of a term that ``df`` of the documents hold."""
    return F.floor(1000 * F.log((2 * n_docs + 2).cast("double") / (2 * df + 1).cast("double")))


def impacts(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(uid, id, n, tids, xs, lead) of every document with a term of the vocabulary, and (tid, w) of its terms.

    ``lead`` is the term that adds most to the score by itself.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = vocabulary.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    small = size["n"] <= VOCABULARY and size["bytes"] <= VOCABULARY_BYTES
    if small:
        counted = cut(_counted(rows, kind, {bytes(r["term"]): r["tid"] for r in vocabulary.collect()}))
    else:
        counted = cut(_counted(rows, kind, None))
        found = counted.select("uid", F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("x")).select("uid", "x.*").join(vocabulary, "term")
        lists = found.groupBy("uid").agg(F.collect_list(F.struct("tid", "tf")).alias("x"))  # a document's own terms
        counted = cut(counted.select("uid", "id", "n").join(lists, "uid", "left").select("uid", "id", "n", F.coalesce("x.tid", F.array().cast("array<long>")).alias("tids"), F.coalesce("x.tf", F.array().cast("array<long>")).alias("tfs")))
    totals = cut(counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")))
    held = counted.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count("*").alias("df"))
    weights = cut(held.crossJoin(F.broadcast(totals)).select("tid", weight(F.col("docs"), F.col("df")).alias("w")))  # one row
    m = 100 - 75 + F.expr("(75 * n * docs) div `all`")
    known = counted.where(F.size("tids") > 0).crossJoin(F.broadcast(totals)).withColumn("m", m)  # one row
    known = known.withColumn("xs", F.transform("tfs", lambda tf: F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(8) * F.col("m"))))
    if small:
        by_tid = {r["tid"]: r["w"] for r in weights.collect()}

        @F.pandas_udf("long")
        def lead(tids: pd.Series, xs: pd.Series) -> pd.Series:
            return pd.Series([int(t[np.argmax([by_tid[i] * x for i, x in zip(t.tolist(), v.tolist(), strict=True)])]) for t, v in zip(tids, xs, strict=True)])

        known = known.withColumn("lead", lead("tids", "xs"))
    else:
        each = known.select("uid", F.explode(F.arrays_zip("tids", "xs")).alias("x")).select("uid", F.col("x.tids").alias("tid"), F.col("x.xs").alias("x")).join(weights, "tid")
        known = known.join(each.groupBy("uid").agg(F.max_by("tid", F.struct(F.col("x") * F.col("w"), "tid")).alias("lead")), "uid")
    return known.select("uid", "id", "n", "tids", "xs", "lead"), weights


def blocks_of(known: DataFrame) -> DataFrame:
    """(block, ids, ends, tids, xs, top_tids, top_xs): documents of similar terms, and the largest impact of each term."""
    kind = dict(known.dtypes)["id"]
    count = max(2, int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ["block", "ids", "ends", "tids", "xs", "top_tids", "top_xs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tids, xs, size, number = [], [], [], 0, TaskContext.get().partitionId() << 33
        id_type = pa.int64()

        def made() -> pa.RecordBatch:
            t, x = np.concatenate(tids), np.concatenate(xs)
            order = np.argsort(t, kind="stable")
            top, at = np.unique(t[order], return_index=True)
            ends = np.cumsum([len(a) for a in tids])
            columns = [pa.array([number]), pa.array([ids], pa.list_(id_type)), *(pa.array([v], pa.list_(pa.int64())) for v in (ends, t, x, top, np.maximum.reduceat(x[order], at)))]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for id_, t, x in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                ids.append(id_.as_py())
                tids.append(t.values.to_numpy(zero_copy_only=False))
                xs.append(x.values.to_numpy(zero_copy_only=False))
                size += len(tids[-1])
                if len(ids) == BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    yield made()
                    ids, tids, xs, size, number = [], [], [], 0, number + 1
        if ids:
            yield made()

    rows = known.repartitionByRange(count, "lead", "n", "uid").sortWithinPartitions("lead", "n", "uid").select("id", "tids", "xs")
    return rows.mapInArrow(run, f"block long, ids array<{kind}>, " + ", ".join(f"{c} array<long>" for c in names[2:]))


class Found(NamedTuple):
    """Best documents of some items in a block, and how many pairs were scored one by one."""

    items: list[int]
    docs: list[int]
    scores: list[int]
    scored: int


def _maxima(rows: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Coordinate maxima of the nodes of each level, lowest first."""
    levels = [np.maximum.reduceat(rows, np.arange(0, len(rows), leaf))]
    while len(levels[-1]) > 1:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), FANOUT)))
    return levels


def search(q: np.ndarray, x: np.ndarray, least: np.ndarray, k: int = TOP) -> Found:
    """The k best documents of each item, those that can be among its best: rows of item weights, of impacts, and scores to reach.

    Sums of whole numbers below 2^53 are exact in doubles; where they may
    come out larger, the same is done in 64-bit integers. Documents of a score
    equal to the kth are kept until the end.
    """
    kind = float if q.sum(axis=1).max() * x.max(initial=0) < 2**53 else np.int64
    q, x = q.astype(kind, copy=False), x.astype(kind, copy=False)
    tau = np.maximum(least, 1).astype(kind)  # a score of 0 is none
    q_levels, x_levels = _maxima(q, LEAF_ITEMS), _maxima(x, LEAF_DOCS)
    height = max(len(q_levels), len(x_levels))
    top = lambda levels, h: levels[min(h, len(levels) - 1)]
    weakest = [np.minimum.reduceat(tau, np.arange(0, len(tau), LEAF_ITEMS))]
    while len(weakest) < len(q_levels):
        weakest.append(np.minimum.reduceat(weakest[-1], np.arange(0, len(weakest[-1]), FANOUT)))
    a, b = np.zeros(1, int), np.zeros(1, int)
    for h in range(height - 1, -1, -1):
        items, docs = top(q_levels, h), top(x_levels, h)
        rows, ra = np.unique(a, return_inverse=True)
        cols, rb = np.unique(b, return_inverse=True)
        bound = (items[rows] @ docs[cols].T)[ra, rb]
        keep = bound >= top(weakest, h)[a]
        a, b, bound = a[keep], b[keep], bound[keep]
        if h and len(a):
            below = lambda levels, v: (v[:, None] * FANOUT + np.arange(FANOUT)[None, :]) if h < len(levels) else v[:, None]  # noqa: B023, E731
            ca, cb = below(q_levels, a), below(x_levels, b)
            pa_, pb_ = np.repeat(ca, cb.shape[1], axis=1).ravel(), np.tile(cb, (1, ca.shape[1])).ravel()
            real = (pa_ < len(top(q_levels, h - 1))) & (pb_ < len(top(x_levels, h - 1)))
            a, b = pa_[real], pb_[real]
    items, docs, scores, scored = [], [], [], 0
    best = np.zeros((len(q), k), kind)
    leaves, at = np.unique(b, return_inverse=True)
    strongest = np.zeros(len(leaves), kind)
    np.maximum.at(strongest, at, bound)
    by_leaf = np.split(np.argsort(at, kind="stable"), np.cumsum(np.bincount(at, minlength=len(leaves)))[:-1]) if len(leaves) else []
    for n in np.argsort(-strongest, kind="stable"):
        pairs = by_leaf[n]
        mine = (a[pairs][:, None] * LEAF_ITEMS + np.arange(LEAF_ITEMS)).ravel()
        enough = np.repeat(bound[pairs], LEAF_ITEMS)
        fits = mine < len(q)
        mine, enough = mine[fits], enough[fits]
        mine = mine[enough >= tau[mine]]  # kth scores have risen since
        if not len(mine):
            continue
        lo = leaves[n] * LEAF_DOCS
        made = q[mine] @ x[lo : lo + LEAF_DOCS].T
        scored += made.size
        r, c = np.nonzero(made >= tau[mine][:, None])
        items += mine[r].tolist()
        docs += (lo + c).tolist()
        scores += made[r, c].astype(np.int64).tolist()
        merged = np.concatenate([best[mine], made], axis=1)
        best[mine] = -np.partition(-merged, k - 1, axis=1)[:, :k]
        tau[mine] = np.maximum(tau[mine], best[mine].min(axis=1))
    good = [i for i, (item, score) in enumerate(zip(items, scores, strict=True)) if score >= tau[item]]
    return Found([items[i] for i in good], [docs[i] for i in good], [scores[i] for i in good], scored)


def _searched(pairs: DataFrame, blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """(ikey, doc_id, score): the best of each item in each block that ``pairs`` (ikey, iset, block, least) name."""
    kind = dict(blocks.dtypes)["ids"][6:-1]
    wanted = pairs.groupBy("iset", "block").agg(F.collect_list(F.struct("ikey", "least")).alias("wanted"))  # SET_ITEMS at most
    rows = blocks.drop("top_tids", "top_xs").join(wanted, "block").join(sets, "iset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ends, tids, xs, wanted, every = (batch.column(c)[i] for c in range(6))
                least = {r["ikey"]: r["least"] for r in wanted.as_py()}
                made = [(r["ikey"], np.array(r["tids"], np.int64), np.array(r["wq"], np.int64)) for r in every.as_py() if r["ikey"] in least]
                # Items of a like strongest term lie together in the hierarchy.
                made.sort(key=lambda r: (int(r[1][np.argmax(r[2])]), r[0]))
                tids, xs, ends = (v.values.to_numpy(zero_copy_only=False) for v in (tids, xs, ends))
                columns = np.intersect1d(np.concatenate([t for _, t, _ in made]), tids)
                x, q = np.zeros((len(ids), len(columns))), np.zeros((len(made), len(columns)))
                at = np.minimum(np.searchsorted(columns, tids), len(columns) - 1)
                hit = columns[at] == tids
                doc = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
                x[doc[hit], at[hit]] = xs[hit]
                for r, (_, t, w) in enumerate(made):
                    at = np.minimum(np.searchsorted(columns, t), len(columns) - 1)
                    hit = columns[at] == t
                    q[r, at[hit]] = w[hit]
                found = search(q, x, np.array([least[r[0]] for r in made]))
                names = ids.as_py()
                last = lambda j: (-found.scores[j], names[found.docs[j]] is None, names[found.docs[j]] or 0)  # noqa: B023, E731
                own: dict[int, list[int]] = {}
                for j, item in enumerate(found.items):
                    own.setdefault(item, []).append(j)
                kept = [j for js in own.values() for j in sorted(js, key=last)[:TOP]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([made[found.items[j]][0] for j in kept], pa.int64()), pa.array([names[found.docs[j]] for j in kept], ids.type.value_type), pa.array([found.scores[j] for j in kept], pa.int64())], ["ikey", "doc_id", "score"]
                )

    return rows.select("ids", "ends", "tids", "xs", "wanted", "items").mapInArrow(run, f"ikey long, doc_id {kind}, score long")


def _ranked(found: DataFrame) -> DataFrame:
    w = Window.partitionBy("ikey").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP)


def ranked_search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents of each item with a score above 0.

    Equal scores go by ascending id, null ids last. Null and empty texts have
    no terms: such documents count nowhere, such items get no rows. Repeated
    documents are ranked each by itself; repeated rows of an item count once,
    different texts of one item_id are ranked each by itself. Empty tables
    give no rows; other columns are not looked at. No document is left out:
    a block that is not searched has no document that could be among the best.
    """
    items, item_terms = items_of(benchmark)
    item_terms = cut(item_terms)
    vocabulary = cut(item_terms.select("term").distinct()).withColumn("tid", F.monotonically_increasing_id())
    known, weights = impacts(docs, vocabulary, id_col, text_col)
    blocks = cut(blocks_of(known))
    n_sets = max(1, -(-items.count() // (SET_ITEMS // 2)))
    weighed = cut(item_terms.join(vocabulary, "term").join(weights, "tid").select("ikey", F.pmod(F.xxhash64("ikey"), F.lit(n_sets)).alias("iset"), "tid", (F.col("q") * F.col("w")).alias("wq")).where("wq > 0"))
    sets = weighed.groupBy("iset", "ikey").agg(F.collect_list("tid").alias("tids"), F.collect_list("wq").alias("wq"))  # an item's own terms
    # A hash deals items to sets of half the bound on average; the few beyond it go to a set of their own.
    sets = sets.withColumn("iset", F.concat_ws(":", "iset", F.floor((F.row_number().over(Window.partitionBy("iset").orderBy("ikey")) - 1) / SET_ITEMS)))
    of = cut(sets.select("ikey", "iset"))
    sets = cut(sets.groupBy("iset").agg(F.collect_list(F.struct("ikey", "tids", "wq")).alias("items")))  # SET_ITEMS at most
    tops = blocks.select("block", F.explode(F.arrays_zip("top_tids", "top_xs")).alias("t")).select("block", F.col("t.top_tids").alias("tid"), F.col("t.top_xs").alias("x"))
    bounds = tops.join(_few(weighed.select("ikey", "tid", "wq")), "tid").groupBy("ikey", "block").agg(F.sum(F.col("wq") * F.col("x")).alias("bound"))
    bounds = cut(bounds.join(_few(of), "ikey"))
    place = F.row_number().over(Window.partitionBy("ikey").orderBy(F.col("bound").desc(), "block"))
    first = cut(bounds.withColumn("place", place).where(F.col("place") <= SEEDS).select("ikey", "iset", "block", F.lit(0).cast("long").alias("least")))
    seeds = cut(_searched(first, blocks, sets))
    kth = _ranked(seeds).where(F.col("rank") == TOP).select("ikey", F.col("score").alias("least"))
    rest = bounds.join(first.select("ikey", "block"), ["ikey", "block"], "left_anti").join(_few(cut(kth)), "ikey", "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long")))
    more = _searched(rest.where(F.col("bound") >= F.col("least")).select("ikey", "iset", "block", "least"), blocks, sets)
    return _ranked(seeds.unionByName(more)).join(items, "ikey").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS uid, {_WORDS} AS w FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS total FROM d),
t AS (SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(w) AS term FROM d) GROUP BY ALL),
i AS (SELECT item_id, ikey, term, count(*) AS q FROM (SELECT item_id, row_number() OVER () AS ikey, unnest({_WORDS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
v AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s WHERE term IN (SELECT term FROM i) GROUP BY term, n_docs),
m AS (SELECT doc_id, uid, 25 + (75 * len(w) * n_docs) // total AS m FROM d, s),
c AS (SELECT item_id, ikey, doc_id, uid, sum(q * v.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN v USING (term) JOIN t USING (term) JOIN m USING (uid) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY ikey ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM c WHERE score > 0)
SELECT * FROM r WHERE rank <= {TOP}
"""
