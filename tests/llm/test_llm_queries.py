import os

import pytest

from conftest import DATA, same
from histolith.llm import queries, sql

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query(spark, name):
    same(queries.queries()[name](spark, DATA), sql.oracle_sql()[name])


@pytest.mark.parametrize("name", ["p7_found", "p8_found", "p9_documents"])
def test_shape(spark, name):
    columns = {"p7_found": ["repo", "path"], "p8_found": ["doc_id", "item_id"], "p9_documents": ["doc_id", "source", "tokens", "times"]}
    df = queries.queries()[name](spark, DATA)
    assert df.columns == columns[name] and df.count() == df.distinct().count() > 0
