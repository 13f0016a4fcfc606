"""All registered queries of the core library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.aggregates import rank_by_size
from gleanery.plans import joining, scans, summing
from gleanery.plans.base import table

BOOKS = [scans.BOOK, joining.BOOK, summing.BOOK]
QUERIES = {name: q for book in BOOKS for name, q in book.queries.items()}
SQL = {name: s for book in BOOKS for name, s in book.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of each event type, ranked by the number of their events."""
    sizes = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n_events"))
    return rank_by_size(sizes, "n_events")
