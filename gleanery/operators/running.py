"""Running figures over the ordered rows of a key, with hot keys cut into pieces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import cut

#: Rows of one key up to which a plain window serves.
HOT_ROWS = 1_000_000


class Running:
    """Rows in order within keys, to which running columns are added.

    While no key has more than HOT_ROWS rows this is a window by key. Beyond
    that the rows are dealt out by ranges of (key, order), so that a hot key
    lies in several pieces; each piece runs by itself and the state in which
    the pieces before it end is added. A piece ends within one key, so only as
    many states are carried as there are pieces, and these are broadcast.

    Null keys are a key of their own. Rows that are equal in key and order lie
    in one piece; which of them comes first is open.
    """

    def __init__(self, df: DataFrame, by: list[str], order: list[str]):
        self.by, self.order, spark = by, order, df.sparkSession
        sizes = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("total")).first()
        self.split = (sizes["top"] or 0) > HOT_ROWS
        if self.split:
            count = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sizes["total"] // HOT_ROWS))
            df = cut(df.repartitionByRange(count, *by, *order).withColumn("__piece", F.spark_partition_id()))
        self.rows, self.keys = df, [*by, "__piece"] if self.split else by

    def add(self, name: str, kind: str, value: Column) -> Running:
        """``sum`` of the value so far, ``last`` one that is not null, or that of the row before (``prev``)."""
        ordered = Window.partitionBy(*self.keys).orderBy(*self.order)
        upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
        run = {"sum": lambda v: F.sum(v).over(upto), "last": lambda v: F.last(v, ignorenulls=True).over(upto), "prev": lambda v: F.lag(v).over(ordered)}[kind]
        if not self.split:
            self.rows = self.rows.withColumn(name, run(value))
            return self
        rows, at, v = self.rows.withColumn("__v", value), F.struct(*self.order), F.col("__v")
        end = {"sum": F.sum(v), "last": F.max_by(v, F.when(v.isNotNull(), at)), "prev": F.max_by(v, at)}[kind]
        before = Window.partitionBy(*self.by).orderBy("__piece")
        earlier = before.rowsBetween(Window.unboundedPreceding, -1)
        carried = {"sum": F.sum("__end").over(earlier), "last": F.last("__end", ignorenulls=True).over(earlier), "prev": F.lag("__end").over(before)}[kind]
        ends = rows.groupBy(*self.keys).agg(end.alias("__end")).withColumn("__pieces", F.count("*").over(Window.partitionBy(*self.by))).where("__pieces > 1")
        ends = ends.withColumn("__carried", carried).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)], "__carried")
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(self.keys)])
        rows = rows.withColumn("__own", run(v)).withColumn("__first", F.row_number().over(ordered) == 1)
        rows = rows.join(F.broadcast(ends), same, "left")  # two rows for each piece at most
        own, carry = F.col("__own"), F.col("__carried")
        value = {"sum": F.when(own.isNull() & carry.isNull(), None).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0))), "last": F.coalesce(own, carry), "prev": F.when(F.col("__first"), carry).otherwise(own)}[kind]
        self.rows = rows.withColumn(name, value).drop("__v", "__own", "__first", "__carried", *[f"__k{i}" for i in range(len(self.keys))])
        return self

    def done(self) -> DataFrame:
        return self.rows.drop("__piece")
