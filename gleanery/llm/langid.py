"""Language ID by Bayesian fusion of text, markup, address and host evidence.

The likelihood of a page's visible text under each language comes from byte
trigrams of labelled documents. What languages a host has, what languages an
address suffix has and how often a declared markup language is right are sums
over all pages, by grouped aggregation. The prior of a host is smoothed
towards its domain, that towards its suffix and that towards all pages; a
page's own text is left out of its own priors.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import cut

#: Bound on the labelled documents of each language that the text model is fitted on, and on the characters of each.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 16_384
#: Trigram buckets; n-grams a text counts as at most (they are not independent).
BUCKETS, MOST_EVIDENCE = 1 << 15, 60.0
#: Pages that the level above counts as.
PRIOR_PAGES, DECLARED_PAGES = 5.0, 20.0
#: Rows up to which the sums of a level are broadcast; a longer level is joined by its key.
BROADCAST_KEYS = 10_000
UNKNOWN = "und"

_BLOCK = re.compile(r"(?i)<(script|style)\b")
_CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
_ENTITY = re.compile(r"&[a-zA-Z#0-9]+;")
_NOISE = re.compile(r"[\x00-\x20!-/0-9:-@\[-`{-~]+")


def visible(html: str) -> str:
    """Words of a page without markup, lower-cased, single blanks between.

    Scripts, styles and comments that never end lose their tag only. One pass:
    what is looked for and not found is not looked for again.
    """
    parts, at, absent = [], 0, set()
    while (open_ := html.find("<", at)) >= 0:
        parts.append(html[at:open_])
        end = -1
        if "-->" not in absent and html.startswith("<!--", open_):
            end = html.find("-->", open_ + 4) + 3
            if end < 3:
                absent.add("-->")
                end = -1
        elif block := _BLOCK.match(html, open_):
            name = block[1].lower()
            if name not in absent:
                close = _CLOSE[name].search(html, block.end())
                end = close.end() if close else -1
                if not close:
                    absent.add(name)
        if end < 0:
            end = html.find(">", open_) + 1
            if not end:  # no tag ends from here on
                at = open_
                break
        at = end
    parts.append(html[at:])
    return _NOISE.sub(" ", _ENTITY.sub(" ", " ".join(parts))).lower()


def trigrams(text: str) -> np.ndarray:
    """Bucket of each UTF-8 byte trigram."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - int(math.log2(BUCKETS)))).astype(np.int64)


def bucket_counts(picks: DataFrame) -> DataFrame:
    """(lang, bucket, n): how often each trigram bucket stands in the texts of each language. Tasks add up a batch before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                counts[lang] += np.bincount(trigrams(visible(text.as_py())), minlength=BUCKETS)
            for lang, found in counts.items():
                at = np.flatnonzero(found)
                # A language of no trigrams is known, too.
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, 0), pa.int32()), pa.array(np.append(found[at], 0), pa.int64())], ["lang", "bucket", "n"])

    return picks.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_text(languages: list[str], of: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The log probability of each bucket under each language, of counts by place of the language and bucket."""
    table = np.empty((len(languages), BUCKETS), np.float32)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(len(languages) + 1))
    for k in range(len(languages)):
        own = order[ends[k] : ends[k + 1]]
        row = np.full(BUCKETS, 0.1)
        np.add.at(row, buckets[own], counts[own])
        table[k] = np.log(row / row.sum())
    return table


def _few(df: DataFrame) -> DataFrame:
    """The rows, marked for broadcast if counting finds them few."""
    return F.broadcast(df) if df.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else df


def learn_text(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The text model from a bounded sample of documents with a language, by the order of a hash.

    Every language is in it, with SAMPLE_DOCS documents at most, of which the
    first SAMPLE_BYTES characters count. Rows of hashes too high for that
    sample are left out before anything is ranked, so a language that most
    documents have is no hot key. Trigrams are counted in tasks; the driver gets
    at most a number for each language and bucket. The model has 128 KB for each language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.substring("text", 1, SAMPLE_BYTES).alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    counts = _few(cut(known.groupBy("lang").agg(F.count("*").alias("n"))))
    share = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    ranked = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    picks = known.join(counts, "lang").where(share < 2.0 * SAMPLE_DOCS / F.col("n")).withColumn("place", ranked).where(F.col("place") <= SAMPLE_DOCS)
    found = bucket_counts(picks).toArrow()
    if not found.num_rows:
        return [UNKNOWN], np.zeros((1, BUCKETS), np.float32)
    languages = sorted(found.column("lang").unique().to_pylist())
    place = pc.index_in(found.column("lang"), pa.array(languages, found.schema.field("lang").type)).to_numpy()
    return languages, fit_text(languages, place, found.column("bucket").to_numpy(), found.column("n").to_numpy())


def text_likelihood(languages: list[str], table: np.ndarray):
    """A column function: html to the log likelihood under each language."""

    @F.pandas_udf("array<double>")
    def score(pages: pd.Series) -> pd.Series:
        out = []
        for html in pages:
            grams = trigrams(visible(html))
            total = table[:, grams].sum(1, dtype=np.float64) if len(grams) else np.zeros(len(languages))
            total -= total.max()
            out.append((total * min(1.0, MOST_EVIDENCE / max(len(grams), 1))).tolist())
        return pd.Series(out)

    return score


def _posterior(logs: Column) -> Column:
    """Probabilities of an array of unnormalised logarithms."""
    raw = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, keys: list[str], width: int, name: str) -> DataFrame:
    """Sum of the text posteriors by key, an array of one figure for each language."""
    sums = [F.sum(F.element_at("text_posterior", i + 1)) for i in range(width)]
    return rows.groupBy(*keys).agg(F.array(*sums).alias(name))


def _smoothed(counts: Column, above: Column, own: Column, pages: float) -> Column:
    """(counts - own + pages * above), as shares."""
    weighted = F.zip_with(F.zip_with(counts, own, lambda c, o: F.greatest(c - o, F.lit(0.0))), above, lambda c, a: c + pages * a)
    return F.transform(weighted, lambda x: x / F.aggregate(weighted, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, host, suffix, declared, text_language, language, probability) of every row.

    Null html counts as an empty page, whose language then comes from its
    markup, address and host alone. A null address has the empty host; pages
    without a declaration share one group. Ties go to the first language by
    name. Repeated rows count each. Without labelled documents all pages are
    ``und``.
    """
    languages, table = learn_text(docs)
    n = len(languages)
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = cut(
        pages.select(
            "page_id",
            host.alias("host"),
            F.substring_index(host, ".", -2).alias("domain"),
            F.substring_index(host, ".", -1).alias("suffix"),
            F.lower(F.regexp_extract(F.regexp_extract(html, r"(?i)<html\b([^>]*)", 1), r"(?i)\blang\s*=\s*[\"']?([A-Za-z]+)", 1)).alias("declared"),
            text_likelihood(languages, table)(html).alias("logs"),
        ).withColumn("text_posterior", _posterior(F.col("logs")))
    )
    own, even = F.col("text_posterior"), F.array(*[F.lit(1.0 / n)] * n)
    whole, wide = _sums(rows, [], n, "all_n"), rows
    for keys, name in ((["suffix"], "suffix_n"), (["domain"], "domain_n"), (["host"], "host_n"), (["declared"], "declared_n")):
        wide = wide.join(_few(cut(_sums(rows, keys, n, name))), keys)
    rows = wide.crossJoin(F.broadcast(whole))  # one row: the sum over all pages
    rows = rows.withColumn("prior", _smoothed(F.col("all_n"), even, own, 1.0))
    for name in ("suffix_n", "domain_n", "host_n"):
        rows = rows.withColumn("prior", _smoothed(F.col(name), F.col("prior"), own, PRIOR_PAGES))
    shares = F.zip_with(F.zip_with("declared_n", own, lambda c, o: F.greatest(c - o, F.lit(0.0))), F.zip_with("all_n", own, lambda c, o: F.greatest(c - o, F.lit(0.0))), lambda d, a: (d + DECLARED_PAGES / n / n) / (a + DECLARED_PAGES / n))
    rows = rows.withColumn("said", shares)
    logs = F.zip_with(F.zip_with("logs", "prior", lambda a, b: a + F.log(b)), "said", lambda a, b: a + F.log(b))
    rows = rows.withColumn("posterior", _posterior(logs))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    return rows.select("page_id", "host", "suffix", "declared", best("text_posterior").alias("text_language"), best("posterior").alias("language"), F.array_max("posterior").alias("probability"))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every page, with the text model of the labelled documents."""
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))
