"""Rounds over large forests: no table of a round goes through the driver."""

from pyspark.sql import functions as F

from netloom.operators import sizing, trees
from netloom.operators.lineage import cut


def sized(spark, n=300):
    nodes = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 2)).cast("long").alias("up"), (10 + F.col("id") % 50).cast("decimal(14,3)").alias("length"), (F.col("id") % 7).cast("decimal(18,3)").alias("flow"))
    edges = nodes.select(F.lit("all").alias("network"), F.col("node").alias("edge"), F.coalesce("up", F.lit(-1)).alias("up"), F.col("node").alias("down"), "length")
    return sorted(map(str, sizing.size_networks(edges, nodes.select(F.lit("all").alias("network"), "node", "flow"), small=10).collect()))


def test_rounds_are_not_broadcast(spark, monkeypatch):
    wanted = sized(spark)
    assert len(wanted) == 300
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(trees, "WIDE", 100)
    monkeypatch.setattr(trees, "cut", seen)
    assert sized(spark) == wanted
    assert len(plans) > 10 and any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
