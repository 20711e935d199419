"""The queries that have an SQL form, next to it."""

import check
import pytest

from tracegrid.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    result = check.compare(spark, check.duck(SF), SF, name)
    assert result.startswith("ok"), result


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
