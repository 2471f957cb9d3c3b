"""Tops are cut in each task before rows of a position meet."""

from tidelag.plans import registry


def test_topn_hit_rate_cuts_before_the_shuffle(spark):
    plan = registry.QUERIES["topn_hit_rate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
