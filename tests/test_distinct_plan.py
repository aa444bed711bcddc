"""The exact distinct count stands apart from the sketches, so none is kept for each value."""

from tarnwick.plans import catalog


def test_no_sketch_by_value(spark, sf):
    plan = catalog.QUERIES["approximate_distinct_error"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    by_value = [line for line in plan.splitlines() if "keys=[l_orderkey" in line]
    assert by_value and not any("hll" in line or "sketch" in line or "approx" in line for line in by_value)
