"""Every registered query against its SQL counterpart, over whole tables."""

import compare
import pytest

from mnemora.plans import registry

QUERIES, SQL = registry()


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, con):
    df = QUERIES[name](spark, folder)
    if name in SQL:
        assert compare.difference(df, con, SQL[name]) is None
    else:
        assert df.count() > 0
