"""Frames with several kinds of EXCLUDE share their windows, so a task sorts its rows a few times and not for each."""

import pytest

from tarnwick.plans import catalog


@pytest.mark.parametrize("name,most", [("exclude_from_whole_range", 5), ("exclude_from_running_range", 5)])
def test_sorts(spark, sf, name, most):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Sort [") <= most
