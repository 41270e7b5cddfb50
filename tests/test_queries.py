import os

import pytest

from archspark import queries

from . import differential

pytestmark = pytest.mark.skipif(not os.path.isdir(differential.SF), reason="no tables here")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_equals_sql(spark, name):
    got, want = differential.both(spark, queries.QUERIES[name], queries.ORACLES[name])
    assert got == want


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, differential.SF).count() > 0


def test_dump_order_has_every_directory(spark):
    pages = queries._tree(spark, differential.SF)[0]
    want = {r.abs.rsplit("/", 1)[0] for r in pages.select("abs").collect()}
    got = {r.dir: r.position for r in queries.QUERIES["dump_order"](spark, differential.SF).collect()}
    assert set(got) == want and sorted(got.values()) == list(range(1, len(want) + 1))
