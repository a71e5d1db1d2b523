"""Every registered query against its SQL oracle; those without one must at least run and give rows."""

import os

import pytest

from clipmill.plans import catalog
from compare import compare, oracle_connection

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CATALOG = catalog()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, con, name):
    q = CATALOG[name]
    df = q.run(spark, SF_DIR)
    if q.oracle is None:
        assert df.columns and df.count() > 0
    else:
        assert compare(df, con, q.oracle) is None


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_operator_of_the_inventory_has_a_query():
    sizes = {"A": 19, "B": 21, "C": 19, "D": 14, "E": 12, "F": 26, "G": 3}
    want = {f"{k}{i:02d}" for k, n in sizes.items() for i in range(1, n + 1)}
    assert {name[:3] for name in CATALOG} == want
