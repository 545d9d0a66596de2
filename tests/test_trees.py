"""Trees deeper and larger than a recursion would take."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import reconstruct, routing, sizing, topology, trees


def test_long_chain(spark):
    n = 5000
    chain = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("up"), F.lit(1).cast("decimal(18,3)").alias("demand"))
    flows = sizing.subtree_flow(chain)
    assert {(r.node, int(r.flow)) for r in flows.collect()} == {(i, n - i) for i in range(n)}
    assert {(r.node, r.end, r.hops) for r in trees.chase(chain).collect()} == {(i, 0, i) for i in range(n)}
    links = chain.where("up IS NOT NULL").select(F.col("node").alias("a"), F.col("up").alias("b"))
    assert topology.reachable(links, spark.createDataFrame([(n - 1,)], "node long")).count() == n
    edges = links.select(F.col("b").alias("up"), F.col("a").alias("down"), F.lit(2).alias("length"), F.lit(1).alias("flow"), F.lit(50).alias("diameter"))
    keep = spark.createDataFrame([(3000,)], "node long")
    assert sorted(map(tuple, routing.collapse_chains(edges, keep).collect())) == [(0, 3000, 6000, 3000), (3000, n - 1, 2 * (n - 1 - 3000), n - 1 - 3000)]


def test_large_tree(spark):
    n = 300_000
    tree = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 2)).alias("up"), F.lit(1).cast("decimal(18,3)").alias("demand"))
    found = sizing.subtree_flow(tree).agg(F.max("flow"), F.sum("flow"), F.count("*")).first()
    assert (found[0], found[2]) == (n, n) and found[1] == sum((i + 1).bit_length() for i in range(n))


def test_random_forest(spark):
    rng = random.Random(11)
    up = {i: (None if rng.random() < 0.05 or i == 0 else rng.randrange(i)) for i in range(400)}
    tree = spark.createDataFrame([(i, u, i % 7) for i, u in up.items()], "node long, up long, demand int")
    want = dict.fromkeys(up, 0)
    for i in up:
        at = i
        while at is not None:
            want[at] += i % 7
            at = up[at]
    assert {r.node: int(r.flow) for r in sizing.subtree_flow(tree).collect()} == want
    flows = sizing.subtree_flow(tree)

    def head(i):
        while up[i] is not None and want[up[i]] == want[i]:
            i = up[i]
        return i

    assert {r.node: r.head for r in sizing.same_flow_components(tree, flows).collect()} == {i: head(i) for i in up}
    loads = tree.where("demand = 3").selectExpr("node", "CAST(2 AS DECIMAL(18,3)) flow", "CAST(1 AS DECIMAL(14,3)) station")
    got = {}
    for r in reconstruct.upstream_loads(tree.selectExpr("node", "up", "CAST(4 AS DECIMAL(14,3)) length"), loads).collect():
        got[r.node, int(r.e)] = got.get((r.node, int(r.e)), 0) + int(r.flow)
    below = {i: sum(2 for j in up if j % 7 == 3 and j != i and i in ancestors(up, j)) for i in up}
    assert got == {(i, 4): f for i, f in below.items() if f} | {(i, 1): 2 for i in up if i % 7 == 3}


def ancestors(up, i):
    out = set()
    while up[i] is not None:
        i = up[i]
        out.add(i)
    return out


def test_cycles(spark):
    rows = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (4, 1, 1), (5, None, 1)], "node long, up long, demand int")
    with pytest.raises(ValueError, match="NETWORK_CYCLE"):
        sizing.subtree_flow(rows)
    assert [tuple(r) for r in trees.chase(rows).collect()] == [(5, 5, 0)]
