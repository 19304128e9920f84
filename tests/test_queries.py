"""Every registered query against the SQL that gives the same rows."""

import os

import pytest
from helpers import by_sql, rows

from tidemark import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, name):
    assert rows(plans.QUERIES[name](spark, FOLDER).toPandas()) == rows(by_sql(plans.SQL[name], FOLDER))
