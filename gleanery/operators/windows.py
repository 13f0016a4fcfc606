"""Window operators over ordered rows of a key.

Hot keys are cut into pieces (see ``running``). Null keys are a key of their
own; rows that are equal in key and order may come in either order, so give an
order without ties where that matters. Empty frames give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.running import Running


def drop_with_next(lines: DataFrame, by: list[str], order: list[str], match: Column) -> DataFrame:
    """Rows without matches and their followers; a follower is itself not tested.

    In a run of matches every second one is a follower, so a match acts if
    its place in the run is odd. A null match is none.
    """
    run = Running(lines.withColumn("__m", F.coalesce(match, F.lit(False))), by, order)
    run.add("__n", "sum", F.lit(1).cast("long")).add("__last", "last", F.when(~F.col("__m"), F.col("__n")))
    acts = F.col("__m") & ((F.col("__n") - F.coalesce("__last", F.lit(0))) % 2 == 1)
    rows = run.add("__f", "prev", acts).rows
    return rows.where(~acts & ~F.coalesce("__f", F.lit(False))).select(*lines.columns)


def first_shape(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's first row."""
    return df.groupBy(*by).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("v")).select(*by, "v.*")


def running_unique(trace: DataFrame, by: list[str], order: list[str], key: list[str]) -> DataFrame:
    """Distinct keys seen so far, row by row (``fresh``, ``so_far``).

    First a key's first row in each piece is marked; only these are compared
    between pieces.
    """
    run = Running(trace, by, order)
    rows = run.rows.withColumn("fresh", F.row_number().over(Window.partitionBy(*run.keys, *key).orderBy(*order)) == 1)
    if run.split:
        rows = rows.withColumn("fresh", F.when(F.col("fresh"), F.col("__piece")))
        first = F.min("fresh").over(Window.partitionBy(*by, *key))
        marked = rows.where("fresh IS NOT NULL").withColumn("fresh", F.col("fresh") == first)
        rows = marked.unionByName(rows.where("fresh IS NULL").withColumn("fresh", F.lit(False)))
    run.rows = rows
    return run.add("so_far", "sum", F.col("fresh").cast("long")).done()


def error_limit(diags: DataFrame, by: list[str], order: list[str], is_error: Column, n: int) -> DataFrame:
    """The first ``n`` errors of a key and what stands between them; ``fatal`` marks the row that would be error n+1. A null is no error."""
    error = F.coalesce(is_error, F.lit(False)).cast("long")
    rows = Running(diags.withColumn("__e", error), by, order).add("errors", "sum", F.col("__e")).done()
    kept = rows.withColumn("fatal", (F.col("errors") == n + 1) & (F.col("__e") == 1)).drop("__e")
    return kept.where((F.col("errors") <= n) | F.col("fatal"))


def deflake(attempts: DataFrame, by: list[str], order: list[str], failed: Column, output: str, max_n: int = 10) -> DataFrame:
    """Verdict over the first attempts, and the first failing one's output."""
    rows = attempts.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= max_n)
    return rows.groupBy(*by).agg(F.coalesce(F.bool_or(failed), F.lit(False)).alias("failed"), F.min_by(F.when(failed, F.col(output)), F.when(failed, F.col("__n"))).alias("output"))


def ffill(lines: DataFrame, by: list[str], order: list[str], is_header: Column, value: str, name: str) -> DataFrame:
    """The value of the latest header at or above each row; null above the first one."""
    return Running(lines, by, order).add(name, "last", F.when(is_header, F.col(value))).done()


#: (operation, operation before it on the key or none) to the fault this is.
RULES = {
    ("release", None): "release without acquire",
    ("release", "release"): "release without acquire",
    ("acquire", "acquire"): "acquire while held",
    ("destroy", "acquire"): "destroy while held",
    ("free", "free"): "second free",
    ("use", "free"): "use after free",
    ("acquire", "destroy"): "acquire after destroy",
}


def violations(trace: DataFrame, key: list[str], order: list[str], op: str, mode: str | None = None, rules: dict | None = None) -> DataFrame:
    """Rows that break a rule, given the operation before them on the same key.

    With a ``mode`` column a release or free of another mode than the
    operation before it is a mismatch.
    """
    rules = RULES if rules is None else rules
    run = Running(trace, key, order).add("before", "prev", F.col(op))
    if mode:
        run.add("__mode", "prev", F.col(mode))
    before, fault = F.col("before"), F.lit(None).cast("string")
    for (now, last), name in rules.items():
        same = before.isNull() if last is None else before == last
        fault = F.when((F.col(op) == now) & same, F.lit(name)).otherwise(fault)
    if mode:
        fault = F.coalesce(fault, F.when(F.col(op).isin("release", "free") & before.isin("acquire", "alloc") & (F.col(mode) != F.col("__mode")), F.lit("mode mismatch")))
    return run.done().withColumn("fault", fault).where("fault IS NOT NULL").select(*trace.columns, "before", "fault")


def live_bytes(trace: DataFrame, by: list[str], order: list[str], signed_size: Column, bound: float) -> DataFrame:
    """Running total, and whether a row is the first at which it passes the bound. Null sizes add nothing."""
    run = Running(trace, by, order).add("live", "sum", signed_size)
    over = F.coalesce(F.col("live") > bound, F.lit(False))
    return run.add("__over", "sum", over.cast("long")).done().withColumn("crosses", over & (F.col("__over") == 1)).drop("__over")
