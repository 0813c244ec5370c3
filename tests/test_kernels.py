"""Parameters of registered queries that have no SQL."""

from tidemark.operators import markets
from tidemark.queries.catalog import QUERIES
from tidemark.queries import kernels  # noqa: F401


def test_bootstrap_takes_the_whole_number_of_resamples(spark):
    assert QUERIES["lead_lag_bootstrap"](spark, "/root/testdata/sf0.01").first()["resamples"] == 2000


def test_draws_of_few_clusters_are_many_tasks(spark):
    """Their sums are some bytes each, which adaptive execution would put into one task, with all the draws."""
    pairs = spark.createDataFrame([(c, float(c % 7 + i), float(c % 5 - i)) for c in range(40) for i in range(3)], "c long, x double, y double")
    plan = markets.cluster_bootstrap(pairs, "c", "x", "y", 50)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate explode") :].splitlines()
    assert any("RepartitionByExpression" in line for line in below[:4])
