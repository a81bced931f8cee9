import functools

import pytest

from emberlattice.plans import queries
from emberlattice.plans import landed  # noqa: F401  registers its queries
from emberlattice.plans.queries import QUERIES, SQL
from emberlattice.scratch import written
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def stages_once():
    """Each stage of the long chain is worked out once and read by all queries that start from it."""
    patch = pytest.MonkeyPatch()
    for name in ("nightly", "hot", "clustered", "ranked", "scored"):
        stage = getattr(queries, name)
        patch.setattr(queries, name, functools.cache(lambda spark, d, stage=stage, name=name: written(stage(spark, d), name)))
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], SQL[name], SF) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
