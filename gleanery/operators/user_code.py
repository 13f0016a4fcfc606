"""User functions over groups, checkers and files. Work inside a task is the user's; Spark deals out the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.session import cut

#: Rows of one group up to which one task sees it whole.
PART_ROWS = 100_000


def reduce_groups(
    df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str, merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None, parts: int = 64
) -> DataFrame:
    """A user function over each group of rows.

    Without ``merge`` a group must fit one task. With it ``fn`` sees a group
    of more than PART_ROWS rows in ``parts`` parts, or more if these were larger than
    that, and ``merge`` puts its results of one group together, so that a
    group of any size is dealt out. Smaller groups go through both in one call.
    """
    if merge is None:
        return df.groupBy(*keys).applyInPandas(fn, schema)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > PART_ROWS)
    large = cut(sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.greatest(F.lit(parts), F.ceil(F.col("__n") / PART_ROWS)).alias("__parts")))
    whole = lambda rows: rows.groupBy(*keys).applyInPandas(lambda g: merge(fn(g)), schema)
    if large.isEmpty():
        return whole(df)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    large = F.broadcast(large)  # a row for PART_ROWS rows at most
    part = F.pmod(F.xxhash64(*df.columns), F.col("__parts")).alias("__part")
    some = df.join(large, same).select(*df.columns, part).groupBy(*keys, "__part").applyInPandas(lambda g: fn(g.drop(columns="__part")), schema)
    return whole(df.join(large, same, "left_anti")).unionByName(some.groupBy(*keys).applyInPandas(merge, schema))


def run_checkers(df: DataFrame, checkers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Reports of several checkers over one frame, each row with its checker's name."""
    reports = None
    for name, checker in checkers.items():
        rows = checker(df).withColumn("checker", F.lit(name))
        reports = rows if reports is None else reports.unionByName(rows)
    return reports


def scan_files(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: StructType | str) -> DataFrame:
    """A user generator over batches of files or rows."""
    return df.mapInPandas(fn, schema)
