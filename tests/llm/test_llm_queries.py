"""Every training-text query runs on the smallest tables; those with SQL agree with it."""

import pytest

from comparing import SMALL, check, database
from millrace.llm.queries import LLM_QUERIES, LLM_SQL

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(LLM_QUERIES))
def test_query(spark, name):
    if name in LLM_SQL:
        check(spark, LLM_QUERIES[name], LLM_SQL[name], database())
    else:
        assert LLM_QUERIES[name](spark, str(SMALL)).count() >= 0


def test_raw_documents_are_repaired(spark):
    got = LLM_QUERIES["p4_repaired"](spark, str(SMALL)).filter("item_table = 'raw_documents'").toPandas()
    want = database().sql("select count(distinct doc_id) from raw_documents where raw_text is not null").fetchall()[0][0]
    assert got.doc_id.nunique() == len(got) == want > 0 and (got.n_found > 0).any()
