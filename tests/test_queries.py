"""Every registered query against its SQL on the smallest tables, also in many blocks."""

import oracle
import pytest

from linewright.plans import catalog

SF = "/root/testdata/sf0.001"
BLOCKED = [
    "chronology_check", "walk_forward_linear", "residual_prefix_cdf", "line_probability", "max_drawdown", "rolling_turnover_3d",
    "decision_table", "chain_verify",
]


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        count, difference = oracle.compare(df, duck, catalog.ORACLES[name])
        assert difference is None
    else:
        count = df.count()
    assert count > 0


@pytest.mark.parametrize("name", BLOCKED)
def test_query_in_many_blocks(spark, duck, small_blocks, name):
    assert oracle.compare(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLES[name])[1] is None
