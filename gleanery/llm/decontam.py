"""Benchmark decontamination: rare seeds join training passages to test items, Smith-Waterman scores them.

Seeds are the rarest words of an item. An alignment that reaches the threshold
keeps a known number of the item's words, wherever the edits fall: of 0.6, six
in ten. So of the rarest words, all but those that it may lose and HITS more,
it holds HITS at least. Longer grams cannot promise that: 0.6 may be reached
with a fifth of the pairs of words whole, so nearly all pairs, common ones
too, would have to be seeds. A document that has HITS seeds of an item and as
many of its words as an alignment keeps, close enough together, is aligned
where that is so. Nothing that reaches the threshold is missed.

Seeds of a benchmark of a checked size are looked up inside tasks, those of a
larger one by a join on words. Any benchmark takes three passes over the
documents: one counts words, one looks seeds up, one cuts passages out
of the documents that have some.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import cut

#: Items of fewer words must stand in a text exactly.
EXACT_BELOW = 5
#: Alignment points; the score is the best sum over the item's number of words.
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
LEAST_SCORE = 0.6
#: Seeds of an item that a document must hold.
HITS = 2
#: Rows of numbers, and words of item texts, that tasks are sent; more are joined by key.
BROADCAST_ROWS, BROADCAST_WORDS = 200_000, 1_000_000

#: Characters of scripts that put no blanks between words; each is a word.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
#: ASCII without digits and letters parts words.
_PARTS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words of a text in order, ``A-Z`` lower-cased; none of a null text."""
    text = F.coalesce(text, F.lit(""))
    text = F.when((F.octet_length(text) > F.length(text)) & text.rlike(f"[{UNSPACED}]"), F.regexp_replace(text, f"([{UNSPACED}])", " $1 ")).otherwise(text)
    return F.array_remove(F.split(F.translate(text, _UPPER + _PARTS, _UPPER.lower() + " " * len(_PARTS)), " "), "")


def _few(df: DataFrame) -> DataFrame:
    """Rows of some numbers each, marked for broadcast if counting finds them few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Lead bytes of characters beyond U+07FF, among which those of UNSPACED are.
_LOW = bytes(range(0xE0))
_SPACED = re.compile(f"([{UNSPACED}])".replace("x{20000}", "U00020000").replace("x{3FFFF}", "U0003FFFF"))
_TABLE = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_list(text: bytes) -> list[bytes]:
    """The same words as of ``words``, inside a task."""
    if text.translate(None, _LOW):
        text = _SPACED.sub(r" \1 ", text.decode("utf-8", "replace")).encode()
    return text.translate(_TABLE).split()


def _sent(words_: DataFrame) -> frozenset[bytes] | None:
    """The words (column ``word``) for tasks to look for; None if they are too many to send, all words come out then."""
    found = words_.limit(BROADCAST_ROWS + 1).collect()
    return frozenset(bytes(r["word"]) for r in found) if len(found) <= BROADCAST_ROWS else None


def _texts(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def word_counts(docs: DataFrame, vocabulary: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, places): how often each word of the vocabulary stands in all rows. Tasks add up what they have read."""
    wanted = _sent(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "places"])

        for batch in batches:
            for text in batch.column(0):
                found = Counter(word_list(text.as_py()))
                for w in found.keys() if wanted is None else wanted & found.keys():
                    counts[w] += found[w]
                if len(counts) > BROADCAST_ROWS:
                    yield made()
                    counts = Counter()
        yield made()

    counted = _texts(docs, text_col).mapInArrow(run, "word binary, places long").groupBy("word").agg(F.sum("places").alias("places"))
    return counted.join(vocabulary, "word", "left_semi")


def items_of(benchmark: DataFrame, least: float, exact_below: int = EXACT_BELOW) -> DataFrame:
    """(key, item_id, item, n, points, needed, hits, span): items and what an alignment with each one must have.

    It keeps ``needed`` of the item's words within ``span`` words, ``hits`` of
    them seeds. Null texts, texts without words and repeated rows add nothing.
    """
    n, points, cost = F.col("n"), F.col("points"), -max(MISMATCH, GAP)
    rows = benchmark.select("item_id", words(F.col("text")).alias("item")).withColumn("n", F.size("item")).where(n > 0).distinct()
    rows = rows.withColumn("points", F.when(n >= exact_below, F.lit(least)).otherwise(F.lit(max(least, 1.0))) * MATCH * n)
    # What matches beyond the points pays for words between.
    rows = rows.withColumn("spare", (n * MATCH - points) / cost).withColumn("needed", F.ceil(points / MATCH - 1e-9).cast("int"))
    return rows.select("item_id", "item", "n", "points", "needed", F.xxhash64("item_id", "item").alias("key"), F.least("needed", F.lit(HITS)).alias("hits"), F.floor(n + F.col("spare") + 1e-9).cast("int").alias("span"))


def seeds_of(items: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, key, hits, times): the rarest words of each item, and how often it has them.

    With multiplicity they make up all its words but ``needed - hits``, so what
    keeps ``needed`` has ``hits`` of them. Rare is what stands in
    few places of the documents, times the items that have it.
    """
    of = ["key", "n", "needed", "hits"]
    each = cut(items.select(*of, F.explode(F.col("item").cast("array<binary>")).alias("word")).groupBy(*of, "word").agg(F.count("*").alias("times")))
    vocabulary = cut(each.groupBy("word").agg(F.count("*").alias("items")))
    counts = word_counts(docs, vocabulary.select("word"), text_col)
    cost = cut(vocabulary.join(counts, "word", "left").select("word", (F.col("items") * F.coalesce("places", F.lit(0))).alias("cost")))
    ranked = Window.partitionBy("key").orderBy("cost", "word").rowsBetween(Window.unboundedPreceding, -1)
    before = each.join(_few(cost), "word").withColumn("before", F.coalesce(F.sum("times").over(ranked), F.lit(0)))
    return before.where(F.col("before") < F.col("n") - F.col("needed") + F.col("hits")).select("word", "key", "hits", "times")


def uid(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text; repeated rows share it."""
    return F.xxhash64(id_col, text_col)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Smith-Waterman: best score over the item's words, and where it ends."""
    n = len(passage)
    slope = GAP * np.arange(n + 1)
    above, best, end = np.zeros(n + 1), 0.0, 0
    for w in item:
        now = np.zeros(n + 1)
        np.maximum(above[:-1] + np.where(passage == w, MATCH, MISMATCH), above[1:] + GAP, out=now[1:])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now - slope) + slope  # gaps along the passage
        if (top := now.max()) > best:
            best, end = float(top), int(now.argmax())
        above = now
    return best / (MATCH * len(item)), end


def reach(item: np.ndarray, text: np.ndarray, points: float, span: int) -> tuple[int, int] | None:
    """From where to where a text can hold an alignment of so many points; None if nowhere.

    No alignment scores more than if every word that the item has matched and
    each one between cost; none that reaches the points is longer than ``span``.
    """
    return _reach(np.flatnonzero(np.isin(text, item)), points, span)


def _reach(places: np.ndarray, points: float, span: int) -> tuple[int, int] | None:
    cost = -max(MISMATCH, GAP)
    rise = (MATCH + cost) * np.arange(len(places)) - cost * places
    ends = places[rise - np.minimum.accumulate(rise) + MATCH >= points - 1e-9] if len(places) else places
    return (max(0, int(ends[0]) - span), int(ends[-1]) + span) if len(ends) else None


def _found_in_tasks(docs: DataFrame, items: DataFrame, seeds: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, key) of documents and items that may align, for a benchmark that tasks can hold."""
    known = [(r["key"], [w.encode() for w in r["item"]], r["needed"], r["hits"], r["points"], r["span"]) for r in items.collect()]
    place = {r[0]: k for k, r in enumerate(known)}
    bags = [Counter(r[1]) for r in known]
    number = {w: k for k, w in enumerate({w for r in known for w in r[1]})}
    own = [np.array([number[w] for w in bag]) for bag in bags]
    of: dict[bytes, list[tuple[int, int]]] = {}
    for r in seeds.collect():
        of.setdefault(bytes(r["word"]), []).append((place[r["key"]], r["times"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_own = np.zeros(len(number) + 1, bool)  # the last place is for all other words
        for batch in batches:
            uids, keys = [], []
            for u, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = word_list(text.as_py())
                bag = Counter(found)
                hits: Counter[int] = Counter()
                for w in of.keys() & bag.keys():
                    for k, times in of[w]:
                        hits[k] += min(times, bag[w])
                ids = None
                for k, n in hits.items():
                    key, _, needed, least, points, span = known[k]
                    if n < least or sum(min(times, bag[w]) for w, times in bags[k].items() if w in bag) < needed:
                        continue
                    if ids is None:
                        ids = np.fromiter((number.get(w, -1) for w in found), np.int64, len(found))
                    is_own[own[k]] = True
                    places = np.flatnonzero(is_own[ids])
                    is_own[own[k]] = False
                    if _reach(places, points, span):
                        uids.append(u)
                        keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(keys, pa.int64())], ["uid", "key"])

    return _texts(docs, text_col, uid(id_col, text_col).alias("uid")).mapInArrow(run, "uid long, key long").distinct()


def _found_by_join(docs: DataFrame, seeds: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, key) of documents that hold enough seeds of an item, for any benchmark. Repeated rows may add a pair too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bag = Counter(word_list(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([u] * len(bag), pa.int64()), pa.array(bag.keys(), pa.binary()), pa.array(bag.values(), pa.int64())], ["uid", "word", "n"])

    bags = _texts(docs, text_col, uid(id_col, text_col).alias("uid")).mapInArrow(run, "uid long, word binary, n long")
    met = bags.join(seeds, "word").groupBy("uid", "key").agg(F.sum(F.least("n", "times")).alias("n"), F.first("hits").alias("hits"))
    return met.where(F.col("n") >= F.col("hits")).select("uid", "key")


def candidates(docs: DataFrame, items: DataFrame, seeds: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, key) of every document and item that may align."""
    size = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if size <= BROADCAST_WORDS and seeds.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return _found_in_tasks(docs, items, seeds, id_col, text_col)
    return _found_by_join(docs, seeds, id_col, text_col)


def _aligner():
    """A column function: item, words of a text, points and span to (score, end)."""

    @F.pandas_udf("score double, end long")
    def aligned(items: pd.Series, texts: pd.Series, points: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for item, text, enough, span in zip(items, texts, points, spans, strict=True):
            number: dict[str, int] = {}
            a = np.array([number.setdefault(w, len(number) + 1) for w in item])
            b = np.array([number.get(w, 0) for w in text])
            if where := reach(a, b, enough, span):
                score, end = align(a, b[where[0] : where[1]])
                out.append((score, where[0] + end))
            else:
                out.append((0.0, 0))
        return pd.DataFrame(out, columns=["score", "end"])

    return aligned


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", exact_below: int = EXACT_BELOW) -> DataFrame:
    """(uid, id, item_id, score, end_word) of each distinct document and item that align."""
    docs = docs.select(F.col(id_col), F.col(text_col))
    items = cut(items_of(benchmark, least, exact_below))
    seeds = cut(seeds_of(items, docs, text_col))
    met = cut(candidates(docs, items, seeds, id_col, text_col))
    # Only documents that may align are cut into words, once each; repeated ones give the same rows.
    texts = docs.withColumn("uid", uid(id_col, text_col)).join(_few(met.select("uid").distinct()), "uid", "left_semi")
    pairs = texts.select("uid", F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).join(_few(met), "uid")
    texts_of = items.select("key", "item_id", "item", "n", "points", "span")
    if (items.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_WORDS:
        texts_of = F.broadcast(texts_of)
    scored = pairs.join(texts_of, "key").withColumn("a", _aligner()("item", "w", "points", "span"))
    good = scored.where(F.col("a.score") * F.col("n") * MATCH >= F.col("points") - 1e-9)
    return good.select("uid", "id", "item_id", F.col("a.score").alias("score"), F.col("a.end").alias("end_word")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, exact_below: int = EXACT_BELOW) -> DataFrame:
    """(doc_id, item_id, score, end_word) of each document and item that align.

    ``end_word`` is the place behind the best alignment, the first of equal
    ones. Null and empty texts match nothing, an empty benchmark gives no
    rows, repeated rows count once. Long texts are aligned only where the
    score can be reached, however many such places there are. Items under
    ``exact_below`` words must stand word by word; characters of scripts without
    blanks between words are words. Other columns are not looked at.
    """
    return matches(docs, benchmark, least, exact_below=exact_below).select(F.col("id").alias("doc_id"), "item_id", "score", "end_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents that align with no item, all columns kept."""
    gone = cut(matches(docs, benchmark, least).select(F.col("uid").alias("__uid")).distinct())
    return docs.withColumn("__uid", uid("doc_id", "text")).join(_few(gone), "__uid", "left_anti").drop("__uid")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Leaks of the whole benchmark in all documents."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
