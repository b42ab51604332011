"""Every registered query against its DuckDB oracle (rows-only ones must run)."""

import pytest

from conftest import SF_SMALL
from inboxlake.plans.catalog import oracle_sql, queries

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    import sys, os
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    from oracle_check import duck
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_oracle(spark, con, name):
    import sys, os
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    from oracle_check import rows_of
    got = queries()[name](spark, SF_SMALL).toPandas()
    if name not in ORACLE:
        assert got.shape[1] > 0
        return
    want = con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows_of(got) == rows_of(want)
