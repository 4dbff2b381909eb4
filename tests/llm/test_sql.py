"""Queries against their SQL."""

import pytest

from checks.compare import rows, views
from gleaner.llm.queries import QUERIES
from gleaner.llm.sql import ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    mine = rows(df.columns, df.collect())
    result = views(sf).execute(ORACLE[name])
    assert mine == rows([d[0] for d in result.description], result.fetchall()) and mine[1]
