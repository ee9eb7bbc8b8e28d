"""One user holding a third of all rows: results stay exact, work stays spread."""

import pytest
from pyspark.sql import functions as F

from playmetrics.operators import kpis, monthly_listening, relabel_ever_paid

N = 30_000


@pytest.fixture()
def skewed(spark):
    return spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 101 == 0, F.lit(None).cast("string"))
        .otherwise((F.col("id") % 997).cast("string")).alias("userId"),
        F.lit("CA").alias("state"), F.lit(1.0).alias("duration"),
        F.when(F.col("id") % 50 == 0, "paid").otherwise("free").alias("subscription"),
        F.lit(2024).alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"),
        F.lit("x").alias("month_name"))


@pytest.fixture()
def no_broadcast(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_relabel_spreads_hot_user(spark, skewed, no_broadcast):
    out = relabel_ever_paid(skewed, max_hot_users=100)
    paid_users = {r.userId for r in skewed.where("subscription = 'paid' AND userId IS NOT NULL")
                  .select("userId").distinct().collect()}
    got = out.groupBy("userId", "subscription").agg(F.count(F.lit(1)).alias("n")).collect()
    for r in got:
        if r.userId is not None and r.userId in paid_users:
            assert r.subscription == "paid"
    assert out.count() == N
    assert out.where("userId IS NULL AND subscription = 'paid'").count() == \
        skewed.where("userId IS NULL AND subscription = 'paid'").count()
    # rows per post-join partition: the hot third is not in one task
    sizes = [r.n for r in out.groupBy(F.spark_partition_id().alias("p"))
             .agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < N / 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_aggregates_under_skew(spark, skewed, no_broadcast):
    (u, avg, paid), = [tuple(r) for r in kpis(skewed).collect()]
    assert u == skewed.select("userId").distinct().count()
    assert paid == skewed.where("subscription = 'paid'").count()
    total = sum(r.total_duration for r in monthly_listening(skewed).collect())
    assert total == pytest.approx(N / 60)
