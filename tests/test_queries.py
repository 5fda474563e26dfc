"""Every core query against its SQL on the smallest tables; those without SQL run and give rows of a stable schema."""

import pytest

import millrace.plans.asking  # noqa: F401
import millrace.plans.content  # noqa: F401
import millrace.plans.feedback  # noqa: F401
import millrace.plans.financial  # noqa: F401
import millrace.plans.hierarchy  # noqa: F401
import millrace.plans.navigator  # noqa: F401
import millrace.plans.packs  # noqa: F401
import millrace.plans.problems  # noqa: F401
import millrace.plans.rerank  # noqa: F401
import millrace.plans.retrieval  # noqa: F401
import millrace.plans.sweeps  # noqa: F401
import millrace.plans.verdicts  # noqa: F401
from comparing import SMALL, check, database
from millrace.plans.registry import QUERIES, SQL

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    check(spark, QUERIES[name], SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(SMALL)).count() >= 0


def test_every_chunk_is_an_anchor(spark, con):
    chunks = con.sql("select count(distinct chunk_id) from chunks").fetchall()[0][0]
    rows = QUERIES["j_neighbours_all"](spark, str(SMALL)).toPandas()
    assert rows[rows.distance == 0].anchor_id.nunique() == chunks
    for place in ("page", "section"):
        placed = con.sql(f"select count(distinct chunk_id) from chunks where {place} is not null and {place}::varchar <> ''").fetchall()[0][0]
        assert QUERIES[f"j_{place}_members"](spark, str(SMALL)).select("chunk_id").distinct().count() == placed > 0


def test_field_search_has_every_component(spark):
    from millrace.operators.index import FIELD_WEIGHTS
    from millrace.plans.retrieval import field_chunks

    got = field_chunks(spark, str(SMALL)).toPandas()
    assert set(FIELD_WEIGHTS) <= set(got.columns) and got.chunk_id.is_unique
    assert all((got[c] != "").any() for c in ("title", "numbers", "dates", "tables"))
