"""Every registered query of the core on odd tables, against its SQL, and on empty tables."""

import pytest

from murmur.plans import registry
from tests.conftest import connect, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()

@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, odd_tables, name):
    frame = QUERIES[name](spark, odd_tables)
    if name in SQL:
        same(frame, connect(odd_tables), SQL[name])
    else:
        frame.collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_tables, name):
    assert len(QUERIES[name](spark, empty_tables).collect()) <= 8
