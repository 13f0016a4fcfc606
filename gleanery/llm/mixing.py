"""Mixing sources to target weights by hash-threshold histograms.

Nothing is sorted and no document is collected. Each source has a token
budget; documents enter by the order of a hash of their id and text. Tokens
are summed by source and hash bucket, a running sum over the buckets (65,536
a level) finds the one in which the budget ends, and only that bucket is
summed again by the next hash digits. Three levels pin the threshold to 48
hash bits. Rows that are equal share these; two more levels by digits of their
number part them, and as they are equal it does not matter which of them enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import cut

#: Hex digits that one level looks at; levels by the hash of id and text, and by the number of a row.
DIGITS, HASH_LEVELS, ROW_LEVELS = 4, 3, 2
LEVELS = HASH_LEVELS + ROW_LEVELS
MAX_REPEATS = 3
#: Sources up to which their figures, a row each, are broadcast; more are joined by source.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: int = 3, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Target of each source: (source, source_size, target).

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the sum
    of all sizes. A share stops at ``max_repeats`` times the source's size and
    the excess goes to the others by weight. Sorted by size over weight the
    stopped sources are a prefix, so one running sum settles all rounds. The
    windows run over one row per source, after a combinable sum.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    per = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", ((F.row_number().over(w) - 1) % cycle + 1).cast("long"))
        .withColumn("top", F.col("source_size") * max_repeats)
    )
    rank = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0))
    per = per.withColumn("stopped", left.cast("double") * F.col("weight") > F.col("top").cast("double") * F.sum("weight").over(after))
    rest = F.sum("source_size").over(everything) - F.sum(F.when(F.col("stopped"), F.col("top")).otherwise(0)).over(everything)
    weights = F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("weight"))).over(everything)
    share = (F.col("weight") * rest).cast("double") / weights
    return per.select("source", "source_size", F.when(F.col("stopped"), F.col("top").cast("double")).otherwise(share).alias("target"))


def _digits(level: int) -> Column:
    return F.substring("h", 1, DIGITS * level)


def first_bars(sizes: DataFrame) -> DataFrame:
    """(source, bar, size): the histogram of the first level, whose sums give the sizes of the sources, too."""
    return cut(sizes.groupBy("source", _digits(1).alias("bar")).agg(F.sum("size").alias("size")))


def hash_thresholds(sizes: DataFrame, targets: DataFrame, first: DataFrame) -> DataFrame:
    """(source, source_size, target, repeats, threshold, whole) for each source.

    All documents are taken ``repeats`` times, and those whose hash prefix is
    below ``threshold`` (``whole``: at it, too) once more. A null threshold
    takes every document once more.
    """
    plan = targets.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn(
        "budget", F.col("target") - F.col("repeats") * F.col("source_size")
    )
    edge = plan.select("source", "budget", F.lit("").alias("prefix"))
    for level in range(1, LEVELS + 1):
        at = edge.select(F.col("source").alias("s"), "budget", "prefix")
        same = F.col("source").eqNullSafe(F.col("s"))
        if level == 1:
            bars = first.join(at, same).select("source", "bar", F.col("size").alias("n"), "budget")
        else:
            within = sizes.join(at, same & (_digits(level - 1) == F.col("prefix")))
            bars = within.groupBy("source", _digits(level).alias("bar")).agg(F.sum("size").alias("n"), F.first("budget").alias("budget"))
        w = Window.partitionBy("source").orderBy("bar")
        edge = (
            bars.withColumn("upto", F.sum("n").over(w))
            .where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("n") <= F.col("budget")))
            .select("source", (F.col("budget") - (F.col("upto") - F.col("n"))).alias("budget"), F.col("bar").alias("prefix"), "n")
        )
    edge = edge.select(F.col("source").alias("s"), F.col("prefix").alias("threshold"), (F.col("budget") * 2 >= F.col("n")).alias("whole"))
    return plan.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "budget")


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: str) -> DataFrame:
    """Figures of each row, with its digits ``h``."""
    h = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))).substr(1, DIGITS * HASH_LEVELS)
    number = F.md5(F.monotonically_increasing_id().cast("string")).substr(1, DIGITS * ROW_LEVELS)
    return docs.select(*more, F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.concat(h, number).alias("h"))


def _mix_plan(sizes: DataFrame) -> DataFrame:
    """Figures of each source, marked for broadcast if they are few, so that texts stay where they are."""
    first = first_bars(sizes)
    plan = cut(hash_thresholds(sizes, source_targets(first), first))
    return F.broadcast(plan) if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan


def _taken(rows: DataFrame, plan: DataFrame, *more: str) -> DataFrame:
    """Rows of ``_sizes`` with their source's figures and the words taken."""
    again = F.col("threshold").isNull() | (F.col("h") < F.col("threshold")) | ((F.col("h") == F.col("threshold")) & F.col("whole"))
    joined = rows.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return joined.select(*more, "id", "size", "source_size", "target", (F.col("size") * (F.col("repeats") + again.cast("long"))).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of each row: (id, size, source_size, target, taken).

    Null text has size 0; a null source is a source of its own; rows without
    id are told apart by their texts, equal rows by their number, so that a
    source of equal rows meets its target, too. A source of no words takes
    none. An empty table gives no rows. Other columns are not looked at.
    """
    sizes = cut(_sizes(docs, id_col, text_col, source_col))
    plan = _mix_plan(sizes)
    return _taken(sizes, plan).withColumnRenamed("id", id_col)


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, with ``copies``, how often, beside their columns.

    A column ``copies`` of the input is replaced. Only the plan, one row a source, meets the texts. Up to BROADCAST_SOURCES
    sources it is broadcast and no text is shuffled.
    """
    sizes = cut(_sizes(docs, id_col, text_col, source_col))
    plan = _mix_plan(sizes)
    whole = docs.withColumn("__row", F.struct(*[c for c in docs.columns if c != "copies"]))
    rows = _taken(_sizes(whole, id_col, text_col, source_col, "__row"), plan, "__row").where(F.col("taken") > 0)
    return rows.select("__row.*", (F.col("taken") / F.col("size")).cast("int").alias("copies"))


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of the whole ``documents`` table."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    steps, last = [], "SELECT source AS s, budget, '' AS prefix FROM plan"
    for k in range(1, LEVELS + 1):
        steps.append(
            f"""bars{k} AS (
  SELECT source, bar, n, budget, sum(n) OVER (PARTITION BY source ORDER BY bar) AS upto FROM (
    SELECT z.source, substr(h, 1, {DIGITS * k}) AS bar, sum(size) AS n, first(budget) AS budget
    FROM sizes z JOIN ({last}) e ON z.source IS NOT DISTINCT FROM e.s AND substr(h, 1, {DIGITS * (k - 1)}) = e.prefix GROUP BY 1, 2)),
edge{k} AS (SELECT source AS s, budget - (upto - n) AS budget, bar AS prefix, n FROM bars{k} WHERE upto > budget AND upto - n <= budget)"""
        )
        last = f"SELECT s, budget, prefix FROM edge{k}"
    return f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, {DIGITS * HASH_LEVELS}) || substr(md5((row_number() OVER ())::VARCHAR), 1, {DIGITS * ROW_LEVELS}) AS h FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM sizes GROUP BY source),
ranked AS (
  SELECT *, 3 * source_size AS top,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE * weight
    > (3 * source_size)::DOUBLE * (sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS stopped
  FROM per),
shared AS (SELECT *, sum(source_size) OVER () - sum(CASE WHEN stopped THEN top ELSE 0 END) OVER () AS rest, sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () AS weights FROM ranked),
targets AS (SELECT source, source_size, CASE WHEN stopped THEN top::DOUBLE ELSE (weight * rest)::DOUBLE / weights::DOUBLE END AS target FROM shared),
plan AS (
  SELECT *, target - repeats * source_size AS budget FROM (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS repeats FROM targets)),
{", ".join(steps)}
SELECT z.doc_id, z.size, p.source_size, p.target,
  (z.size * (p.repeats + CASE WHEN e.prefix IS NULL OR h < e.prefix OR (h = e.prefix AND e.budget * 2 >= e.n) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sizes z JOIN plan p ON z.source IS NOT DISTINCT FROM p.source LEFT JOIN edge{LEVELS} e ON z.source IS NOT DISTINCT FROM e.s
"""


SQL = _sql()
