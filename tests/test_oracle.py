"""Every registered query against its independent DuckDB text (column
names, types, row count, order-insensitive values) at sf0.01 -- the
driver's gate -- and at sf0.001, where small-data edge cases show up
(empty batches, no moves, single buckets)."""

import os

import pytest

from marquee import oracle
from marquee.plans import registry
from harness import compare, duck

SFS = ["/root/testdata/sf0.01", "/root/testdata/sf0.001"]
QUERIES = registry.queries()
SQL = oracle.all_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SFS[0]), reason="driver test data missing")


@pytest.fixture(scope="module")
def cons():
    out = {sf: duck(sf) for sf in SFS}
    yield out
    for c in out.values():
        c.close()


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(SQL)


@pytest.mark.parametrize("sf", SFS, ids=["sf0.01", "sf0.001"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, cons, name, sf):
    ok, msg = compare(QUERIES[name](spark, sf), cons[sf], SQL[name])
    assert ok, f"{name} @ {sf}: {msg}"
