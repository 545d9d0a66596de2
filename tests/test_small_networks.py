"""Small networks are worked on within a task and large ones by joins: both ways give the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import evaluate, lineage, sizing, trees


def forests(seed, networks):
    """(network, edge, up, down, length, flow) with cycles, repeated ids, two feeders and bad demands here and there."""
    rng = random.Random(seed)
    rows = []
    for k in range(networks):
        for i in range(1, rng.randint(2, 9)):
            up = rng.randrange(i) if rng.random() < 0.96 else rng.randrange(10)
            rows.append((k, i if rng.random() < 0.98 else 1, up, i if rng.random() < 0.98 else 1, rng.choice([1, 90, 200, 12000]), rng.choice([0, 1, 2, 30, 22000] if rng.random() < 0.99 else [-1, None])))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return lineage.cut(spark.createDataFrame(forests(3, 120), "network long, edge long, up long, down long, length int, flow int"))


def rows(df):
    return sorted(map(str, df.collect()))


def test_sizing(spark, table):
    edges, demands = table.select("network", "edge", "up", "down", F.col("length") + F.lit("0.125").cast("decimal(4,3)")).toDF("network", "edge", "up", "down", "length"), table.select("network", F.col("down").alias("node"), "flow")
    found = rows(sizing.size_networks(edges, demands))
    assert found == rows(sizing.size_networks(edges, demands, small=0)) == rows(sizing.size_networks(edges, demands, small=8))
    for issue in ("DUPLICATE_EDGE_ID", "MULTIPLE_UPSTREAM_EDGES", "INVALID_DEMAND_FLOW", "NETWORK_CYCLE", "FLOW_EXCEEDS_CATALOG", "MAX_CONTINUOUS_LENGTH_EXCEEDED", "issue=None"):
        assert any(issue in r for r in found)


def test_integrity(table):
    found = rows(evaluate.graph_integrity(table))
    assert found == rows(evaluate.graph_integrity(table, small=0)) == rows(evaluate.graph_integrity(table, small=4))
    assert any("tree=True" in r for r in found) and any("tree=False" in r for r in found)


def test_roots(table):
    links = lineage.cut(table.groupBy("network", (F.col("network") * 100 + F.col("down")).alias("node")).agg(F.min(F.when(F.col("up") > 0, F.col("network") * 100 + F.col("up"))).alias("up")))
    whole = rows(trees.chase(links))
    assert whole == rows(trees.chase_within(links, "network")) == rows(trees.chase_within(links, "network", 3))


def test_small_networks_take_few_stages(spark, table):
    """The joins and rounds over all edges are left to large networks."""
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    spark.sparkContext.setJobGroup("few", "few")
    try:
        evaluate.graph_integrity(table).collect()
        sizing.size_networks(table.select("network", "edge", "up", "down", "length"), table.select("network", F.col("down").alias("node"), "flow")).collect()
        assert jobs() < 25
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
