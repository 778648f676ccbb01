"""Only groups of many rows, as counted, are spread; the others are windows, and all have the same shares."""

import pytest

from riskloom.operators import macro as M
from riskloom.sources.shared import settle

SCHEMA = "n int, indicator_code string, ref_area string, obs_value double, change_abs double"


@pytest.fixture
def ts(spark):
    hot = [(i, "hot", "U2", float(i * 7 % 31), None if i % 5 == 0 else float(i % 4 - 2)) for i in range(200)]
    few = [(200 + i, "few", None if i % 2 else "DE", float(i % 3), float(-i)) for i in range(12)]
    odd = [(300, None, "DE", 1.0, 1.0), (301, "hot", "U2", None, 9.0), (302, "few", None, 0.0, None), (303, "few", None, float("nan"), float("nan")), (304, "one", "DE", -0.0, 0.0)]
    return settle(spark.createDataFrame(hot + few + odd, SCHEMA))


@pytest.mark.parametrize("most", [None, 100, 3, 0])
def test_shares_are_the_same_however_groups_are_split(ts, most):
    want, got = (sorted(map(repr, df.select(*ts.columns, "current_level_percentile", "momentum_percentile").collect())) for df in (M.level_momentum_percentile(ts), M.level_momentum_percentile(ts, True, most)))
    assert got == want and len(want) == 215


def test_groups_that_are_not_large_meet_no_join(ts):
    plan = M.level_momentum_percentile(ts, spread=True)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
