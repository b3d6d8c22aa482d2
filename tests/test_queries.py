"""Every registered query against its SQL on the smallest tables."""

import pytest
from check import compare, connect

from opsinlake.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    problem, _, _ = compare(spark, con, SF, name)
    assert problem is None, problem


def test_upsert_of_systems_that_came_at_one_time(spark, tmp_path):
    """Times of arrival repeat every 1,009 keys, those of a shared name every 21,189: content decides."""
    con = connect(SF)
    con.execute(f"""CREATE OR REPLACE VIEW supplier AS SELECT s.* REPLACE (s_suppkey + 21189 * i AS s_suppkey, CAST((s_nationkey + 3 * i) % 25 AS INTEGER) AS s_nationkey)
        FROM '{SF}/supplier.parquet' s, range(12) t(i) ORDER BY hash(s_suppkey * 31 + i)""")
    con.execute(f"COPY supplier TO '{tmp_path}/supplier.parquet'")
    assert compare(spark, con, str(tmp_path), "library_upsert")[0] is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 500
    assert set(e.oracle_sql()) <= set(e.queries())
