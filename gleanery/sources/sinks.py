"""Writers of ranked reports, test results and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Test cases of a suite that come together in one record.
CASES = 10_000


def write_ranked(df: DataFrame, path: str, by: str, then: list[str] | None = None) -> None:
    """CSV in descending numeric order of a column, a title row in each part; ``then`` orders what is equal. What is no number comes last."""
    df.orderBy(F.col(by).try_cast("double").desc_nulls_last(), *(then or [])).write.csv(path, header=True)


def _parts(df: DataFrame, cases: int) -> DataFrame:
    """The rows with ``__part``: a suite of many cases is cut into parts of about ``cases``."""
    sizes = df.groupBy(F.col("suite").alias("__suite")).agg(F.ceil(F.count("*") / cases).alias("__parts"))
    rows = df.join(sizes, F.col("suite").eqNullSafe(F.col("__suite")))
    return rows.withColumn("__part", F.pmod(F.xxhash64("suite", "test"), F.col("__parts"))).drop("__suite", "__parts")


def xunit(df: DataFrame, cases: int = CASES) -> DataFrame:
    """Rows in the shape of a JUnit ``testsuite``: one for a suite, several of its name for one of many cases."""
    case = F.struct(F.col("suite").alias("_classname"), F.col("test").alias("_name"), F.format_number(F.coalesce("elapsed", F.lit(0.0)), 2).alias("_time"))
    groups = _parts(df, cases).groupBy(F.col("suite").alias("_name"), "__part")
    return groups.agg(F.count("*").alias("_tests"), F.count_if(F.col("code").isin("FAIL", "XPASS", "UNRESOLVED")).alias("_failures"), F.sort_array(F.collect_list(case)).alias("testcase")).drop("__part")


def write_xunit(df: DataFrame, path: str) -> None:
    xunit(df).write.format("xml").option("rootTag", "testsuites").option("rowTag", "testsuite").save(path)


def results_json(df: DataFrame, cases: int = CASES) -> DataFrame:
    """Records with the fields that ``read_results`` reads: one for a suite, several for one of many cases."""
    test = F.struct("code", "elapsed", "metrics", F.concat_ws(" :: ", "suite", "test").alias("name"), "output")
    return _parts(df, cases).groupBy("suite", "__part").agg(F.array(F.lit(0), F.lit(1)).alias("__version__"), F.sum("elapsed").alias("elapsed"), F.collect_list(test).alias("tests")).drop("suite", "__part")


def write_results(df: DataFrame, path: str) -> None:
    results_json(df).write.json(path)


def profile_text(df: DataFrame) -> DataFrame:
    """Profile records as text, one a row, that ``parse_profiles`` reads back."""
    numbers = F.array_join(F.transform("counters", lambda c: c.cast("string")), "\n")
    return df.select(F.concat_ws("\n", "name", F.col("hash").cast("string"), F.size("counters").cast("string"), numbers, F.lit("")).alias("value"))


def write_profile(df: DataFrame, path: str) -> None:
    profile_text(df).write.text(path)
