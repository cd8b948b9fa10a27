"""Every named query against its SQL oracle on the smallest tables."""

import pytest

from astrolake.plans.registry import entries, run_entry
from check import compare, connect

SF = "/root/testdata/sf0.001"
ALL = entries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, con, name):
    e = ALL[name]
    df = run_entry(e, spark, SF)
    assert df.columns == list(e.out)
    got = [tuple(r) for r in df.collect()]
    if e.sql is not None:
        assert compare(list(e.out), got, con.execute(e.sql).fetchall()) == ""
    else:
        assert got
