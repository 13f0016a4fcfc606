"""Every registered query of the core library against its SQL."""

import pytest
from compare import SF, present, same

from gleanery.plans.registry import QUERIES, SQL, flagship

pytestmark = pytest.mark.skipif(not present(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    same(spark, QUERIES[name], SQL[name])


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0
