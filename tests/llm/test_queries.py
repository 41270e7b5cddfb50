import os

import pytest

from archspark.llm import entry

from .. import differential

pytestmark = pytest.mark.skipif(not os.path.isdir(differential.SF), reason="no tables here")


@pytest.mark.parametrize("name", list(entry.ORACLES))
def test_equals_sql(spark, name):
    got, want = differential.both(spark, entry.QUERIES[name], entry.ORACLES[name])
    assert got == want
