"""The numbered queries against their SQL, on whole tables."""

import pytest

from tarja.llm import queries

from ..compare import DATA, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    got, cols = spark_rows(queries.queries()[name](spark, DATA))
    want, names = duck_rows(queries.oracle_sql()[name])
    assert cols == names
    assert len(got) == len(want)
    assert got == want
