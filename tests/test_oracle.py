"""Every registered query against its DuckDB oracle on the sf0.01 tables."""
import pytest

from tests.oracle_compare import compare, duck
from tests.conftest import SF_DIR
from tonality.plans import load_all

QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    q = QUERIES[name]
    r = compare(spark, con, name, q.build, q.sql, SF_DIR)
    assert r["status"] == "match", r
    assert r["spark_rows"] > 0, r
