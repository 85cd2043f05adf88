"""The package's queries against their SQL, over whole tables."""

import __spark_entry__ as registered
import pytest
from compare import connection, differences

from cardwatch.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_sql(lm, sf, name):
    assert differences(registered.queries()[name](lm, sf), connection(sf), oracle.oracle_sql()[name]) == []


def test_all_thirteen_and_the_pipeline_are_registered():
    names = set(registered.queries())
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 14)}
    assert set(queries.queries()) | {"pipeline"} <= names
    assert set(oracle.oracle_sql()) <= set(registered.oracle_sql())
