"""Toxicity by compression distance.

zstandard dictionaries are trained on ordinary and on toxic text. Toxic
documents are ordinary prose for the most part, so the toxic dictionaries are
not trained on whole toxic texts but on runs of byte grams that stand in significantly
more toxic documents than ordinary ones, and in several times their share. These runs are
words and pieces of words, so a toxic dictionary reads like a list of toxic words, found by
a test on grams and packed by the trainer. Both sides share the ordinary dictionary, the toxic
ones have theirs behind it. The ordinary one is large, for what it lacks of ordinary wording
is saved by a toxic one. A window of toxic wording comes out shorter under those. The bytes saved over the ordinary dictionary in all windows of a text
are summed up in a few figures, which a logistic rule turns into a score. The
rule and its cut are calibrated by cross-fitting: each quarter of the labelled
texts is measured with dictionaries trained on the other three.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a window and of the step from one to the next; zstandard level.
WINDOW, STEP, LEVEL = 32, 16, 3
#: Bound on the labelled rows that the fit may see, by class, and on their length.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 1500, 3000, 32_768
#: Bytes of the ordinary and of a toxic dictionary; windows that the first one is trained on, and their bytes.
DICT_BYTES, TOXIC_BYTES, DICT_WINDOWS, TRAIN_WINDOW = 65_536, 4096, 30_000, 96
#: The ordinary dictionary has this share of its training text at most, as it must not learn a small one by heart; bytes that it may have in any case.
DICT_SHARE, SMALL_DICT = 1 / 16, 8192
#: The toxic dictionaries: bytes of a gram, standard errors by which more toxic texts than ordinary ones must have it.
PASSAGES = ((7, 5.0), (5, 5.0))
#: Toxic texts that must have a gram at least; how many times the share of ordinary texts that theirs must be.
LEAST_TEXTS, LEAST_RATIO = 4, 4.0
#: Parts of the labelled texts, each measured with dictionaries of the others.
FOLDS = 4
CUT = 0.7


@dataclass(frozen=True)
class Model:
    """What executors need: dictionaries (some 200 KB) and the calibrated rule."""

    ordinary: bytes
    toxic: tuple[bytes, ...]  # each has the ordinary one in front
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    cut: float = 0.0


def windows(text: bytes, size: int = WINDOW, step: int = STEP) -> Iterator[bytes]:
    """Overlapping windows over the whole text; one, maybe short, at least."""
    for at in range(0, max(1, len(text) - size + step), step):
        yield text[at : at + size]


def _compressor(content: bytes):
    known = zstandard.ZstdCompressionDict(content)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False).compress


def _compressors(model: Model) -> list:
    return [_compressor(x) for x in (model.ordinary, *model.toxic)]


def _figures(saved: np.ndarray) -> list[float]:
    at_least = [saved >= k for k in (2, 3, 4, 5, 6)]
    return [min(saved.max(), 10.0), *(math.log1p(x.sum()) for x in at_least), *(math.sqrt(x.mean()) for x in at_least), np.clip(saved, 0, None).mean(), saved.mean(), math.log1p(len(saved))]


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def features(text: bytes, ordinary, *toxic) -> list[float]:
    """Figures of the bytes that each toxic dictionary saves over the ordinary one, window by window."""
    parts = list(windows(text)) if text else []
    plain = [len(ordinary(w)) for w in parts]
    return [x for other in toxic for x in _figures(np.array([n - len(other(w)) for n, w in zip(plain, parts, strict=True)], float) if parts else np.zeros(1))]


def _grams(text: bytes, size: int) -> np.ndarray:
    """The gram at each place as a number."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(raw) - size + 1
    return sum((raw[k : k + n] << np.uint64(8 * k) for k in range(size)), np.zeros(n, np.uint64)) if n > 0 else np.zeros(0, np.uint64)


def _texts_with(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams in order, and how many texts have each; a part of the texts at a time."""
    known, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for lo in range(0, len(texts), 256):
        more = [np.unique(_grams(t, size)) for t in texts[lo : lo + 256]]
        every = np.concatenate([known, *more])
        weights = np.concatenate([counts, np.ones(len(every) - len(known), np.int64)])
        known, place = np.unique(every, return_inverse=True)
        counts = np.bincount(place, weights, len(known)).astype(np.int64)
    return known, counts


def _of(table: tuple[np.ndarray, np.ndarray], grams: np.ndarray) -> np.ndarray:
    known, counts = table
    if not len(known):
        return np.zeros(len(grams), np.int64)
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    return np.where(known[at] == grams, counts[at], 0)


def own_passages(toxic: list[bytes], ordinary: list[bytes], size: int, least_z: float) -> list[bytes]:
    """Passages of the toxic texts made of grams that significantly more of them have than of the ordinary ones.

    Longer texts have more of all grams, which many texts show as significant; LEAST_RATIO leaves these out.
    """
    here, there = _texts_with(toxic, size), _texts_with(ordinary, size)
    found = []
    for text in toxic:
        grams = _grams(text, size)
        a, b = _of(here, grams), _of(there, grams)
        share = (a + b) / (len(toxic) + len(ordinary))
        error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / len(toxic) + 1 / len(ordinary)))
        own = (a >= LEAST_TEXTS) & (a / len(toxic) - b / len(ordinary) >= least_z * error) & (a / len(toxic) >= LEAST_RATIO * b / len(ordinary))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
        found += [text[i : j + size - 1] for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    return found


def _train(parts: list[bytes], size: int) -> bytes:
    """A dictionary of the parts; their plain content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(parts)[:size] or b" "


def train(rows: list[tuple[bytes, int]]) -> Model:
    """The dictionaries of labelled texts."""
    toxic, ordinary = ([t for t, y in rows if y == k] for k in (1, 0))
    cut = lambda texts: [w for t in texts for w in windows(t, TRAIN_WINDOW, TRAIN_WINDOW)]
    parts = cut(ordinary)
    parts = [parts[i] for i in np.random.default_rng(7).permutation(len(parts))[:DICT_WINDOWS]]
    base = _train(parts, min(DICT_BYTES, max(SMALL_DICT, int(DICT_SHARE * sum(map(len, parts))))))
    return Model(base, tuple(base + _train(own_passages(toxic, ordinary, size, z) or cut(toxic), TOXIC_BYTES) for size, z in PASSAGES))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 10.0) -> np.ndarray:
    """Newton steps for balanced logistic regression; the last weight is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w, balance = np.zeros(x.shape[1]), np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (balance * (p - y)) + ridge * np.r_[w[:-1], 0]
        hess = (x * (balance * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w


def measured(known: list[tuple[bytes, int]], unseen: list[tuple[bytes, int]]) -> tuple[Model, list[list[float]]]:
    """Dictionaries of the known texts, and the figures of others under them."""
    model = train(known)
    every = _compressors(model)
    return model, [features(t, *every) for t, _ in unseen]


def calibrated(x: np.ndarray, y: np.ndarray, model: Model, ordinary_share: float | None = None) -> Model:
    """The model with a rule fitted on figures of texts that the dictionaries had not seen.

    Of the cuts the one is taken that would have the best F measure where
    ordinary texts have ``ordinary_share`` of all, which the sample's classes
    do not show; precision weighs twice as much as recall in it, for a text
    wrongly rejected is lost.
    """
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = _logistic((x - mean) / scale, y)
    z = np.c_[(x - mean) / scale, np.ones(len(x))] @ w
    tried = np.unique(np.quantile(z, np.linspace(0, 1, 400)))
    share = ordinary_share or 1 - y.mean()
    times = share / (1 - share) * y.sum() / (1 - y).sum()  # texts that an ordinary one of the sample stands for
    hits = [(((z >= c) & (y == 1)).sum() / (((z >= c) * np.where(y == 1, 1, times)).sum() + 0.25 * y.sum()), c) for c in tried]
    return Model(model.ordinary, model.toxic, tuple(mean), tuple(scale), tuple(w), float(max(hits)[1]))


def fit(rows: list[tuple[str | None, int]], ordinary_share: float | None = None) -> Model | None:
    """A model of texts in memory, by the same steps as ``learn``, one after the other."""
    known = list(dict.fromkeys((_bytes(t), int(y)) for t, y in rows))
    parts = [known[k::FOLDS] for k in range(FOLDS)]
    if any(len({y for _, y in part}) < 2 for part in parts):
        return None
    made = [measured([row for part in parts[:k] + parts[k + 1 :] for row in part], unseen) for k, unseen in enumerate(parts)]
    x, y = [f for _, figures in made for f in figures], [label for part in parts for _, label in part]
    return calibrated(np.array(x), np.array(y), made[-1][0], ordinary_share)


def rule(x: np.ndarray, model: Model) -> np.ndarray:
    """Scores of rows of figures; ``cut`` comes out as CUT."""
    z = np.c_[(x - model.mean) / model.scale, np.ones(len(x))] @ np.array(model.weights) - model.cut
    return 1 / (1 + np.exp(-np.clip(z + math.log(CUT / (1 - CUT)), -500, 500)))


def scorer(model: Model | None):
    """A column function: text to score in 0 to 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.zeros(len(texts)))
        every = _compressors(model)
        return pd.Series(rule(np.array([features(_bytes(t), *every) for t in texts]).reshape(len(texts), -1), model))

    return score


def held_out(doc_id: Column) -> Column:
    """The fold no fit may look at."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample of the labelled rows, by the order of a hash; each part of it is measured in a task of its own.

    Of each class at most ``SAMPLE_TOXIC`` and ``SAMPLE_ORDINARY`` rows are
    taken, of at most ``SAMPLE_BYTES`` each, so a task has a bounded number of
    texts and the driver none, only their figures; rows of the held-out fold are never
    looked at. An id labelled twice counts as toxic if one label says so. Null
    labels say nothing. The dictionaries of the last part serve: those of all rows would save
    more than what the rule was calibrated on. None where a class has fewer than FOLDS
    texts, as each part has both classes.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # at most SAMPLE_TOXIC + SAMPLE_ORDINARY rows
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect() if r["toxic"] in (0, 1)}
    share = counts.get(0, 0) / (counts[0] + counts[1]) if len(counts) == 2 else None
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES).join(sample, "doc_id")
    texts = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE_TOXIC + SAMPLE_ORDINARY)
    texts = texts.select(F.xxhash64("text").alias("h"), "text", F.col("toxic").cast("int").alias("y")).distinct()
    every = texts.crossJoin(F.broadcast(docs.sparkSession.range(FOLDS).select(F.col("id").cast("int").alias("part"))))  # FOLDS rows

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "text", "y"])
        seen = rows.groupby("y").cumcount() % FOLDS != rows["part"]  # each task deals out the same rows alike
        of = lambda df: [(_bytes(t), int(y)) for t, y in zip(df["text"], df["y"], strict=True)]
        known, unseen = of(rows[seen]), of(rows[~seen])
        if len({y for _, y in known}) < 2 or len({y for _, y in unseen}) < 2:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("part", "y", "x", "dictionaries")})
        model, figures = measured(known, unseen)
        own = [[model.ordinary, *model.toxic] if k == 0 and rows["part"].iloc[0] == FOLDS - 1 else None for k in range(len(unseen))]
        return pd.DataFrame({"part": rows["part"].iloc[0], "y": [y for _, y in unseen], "x": figures, "dictionaries": own})

    found = every.groupBy("part").applyInPandas(run, "part int, y int, x array<double>, dictionaries array<binary>").collect()  # figures of the sample
    if len({r["part"] for r in found}) < FOLDS:
        return None
    ordinary, *toxic = next(map(bytes, r["dictionaries"]) for r in found if r["dictionaries"])
    found.sort(key=lambda r: (r["part"], r["y"], r["x"]))
    return calibrated(np.array([r["x"] for r in found]), np.array([r["y"] for r in found]), Model(ordinary, tuple(toxic)), share)


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts are scored like a text with nothing saved. Without
    both classes among the labels there is no model and every score is 0.
    Repeated rows are scored alike; rows without id are not held out. Of a very
    long text every window is looked at. An empty table gives no rows; other
    columns are not looked at.
    """
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)(F.coalesce("text", F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the score does not reject, all columns kept."""
    score = scorer(learn(docs, labels))
    return docs.where(score(F.coalesce("text", F.lit(""))) < CUT)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document, with labels of the other two folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
