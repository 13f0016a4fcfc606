"""Sorting, top rows, set operations and de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_numeric(df: DataFrame, col: str) -> DataFrame:
    """Descending order of a text column read as numbers; what is none comes last."""
    return df.orderBy(F.col(col).try_cast("double").desc_nulls_last())


def top1(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's greatest row."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(*by, "v.*")


def sorted_unique(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct().orderBy(*cols)


def sort_pair(a: Column, b: Column) -> Column:
    """Two arrays as pairs, sorted by the first."""
    return F.array_sort(F.arrays_zip(a.alias("a"), b.alias("b")))


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), dfs)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of the first side that the second lacks."""
    return a.subtract(b)


def insert_new(base: DataFrame, batch: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """All keys after an insert, and those that were new."""
    new = batch.select(*keys).distinct().join(base.select(*keys).distinct(), keys, "left_anti")
    return base.select(*keys).distinct().unionByName(new), new


def dedup(reports: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first report of each key, chosen by a combinable minimum and not by sorting."""
    rest = [c for c in reports.columns if c not in keys]
    return reports.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("v")).select(*keys, "v.*").select(*reports.columns)
