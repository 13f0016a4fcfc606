"""Corpus queries against their SQL, and the columns and rows that the rest must have."""

import pytest
from compare import SF, present, same

from gleanery.llm.registry import QUERIES, SQL

pytestmark = pytest.mark.skipif(not present(), reason="no test tables")
COLUMNS = {
    "op1_toxicity": (["doc_id", "held_out", "score", "predicted"], "documents"),
    "op6_language_id": (["page_id", "host", "suffix", "declared", "text_language", "language", "probability"], "pages"),
    "op10_simhash_dedup": (["doc_id", "fingerprint", "component_id"], "documents"),
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert same(spark, QUERIES[name], SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_rows(spark, name):
    columns, table = COLUMNS[name]
    got = QUERIES[name](spark, SF)
    assert got.columns == columns
    assert got.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_leaks_have_ids(spark):
    assert QUERIES["op8_decontaminate"](spark, SF).columns == ["doc_id", "item_id", "score", "end_word"]
