"""Rows at one place share their search: what the searches are given, and that no row's result is lost."""

import pytest
from pyspark.sql import functions as F

from netloom.operators import obstacles, topology


def watch(monkeypatch, module, name):
    """Row counts of the first argument of each call."""
    seen, real = [], getattr(module, name)

    def spy(df, *rest, **named):
        seen.append(df.count())
        return real(df, *rest, **named)

    monkeypatch.setattr(module, name, spy)
    return seen


def test_terminals_of_a_place_share_a_search(spark, monkeypatch):
    seen = watch(monkeypatch, obstacles, "points_in_rings")
    square = lambda a: [(a, a), (a + 10.0, a), (a + 10.0, a + 10.0), (a, a + 10.0), (a, a)]
    areas = spark.createDataFrame([(1, "park", square(0.0)), (2, "oks", square(0.0)), (3, "oks", square(4.0)), (4, "road", square(0.0))], "obstacle long, kind string, ring array<struct<x:double,y:double>>")
    rows = [(t, t % 4, 5.0, 5.0) for t in range(40)] + [(50, 9, 1.0, 1.0), (51, 9, 30.0, 1.0), (52, None, 1.0, 1.0), (53, 3, 12.0, 12.0), (54, 9, 1.0, 1.0), (54, 9, 12.0, 12.0)]
    t = spark.createDataFrame(rows, "terminal long, own long, x double, y double")
    got = {r.terminal: r.blockers for r in obstacles.terminal_blockers(t, areas, 5.0).collect()}
    assert got == {n: [b for b in (1, 2, 3) if b != n % 4] for n in range(40)} | {50: [1, 2], 52: [1, 2], 54: [1, 2, 3]}
    assert seen == [4]


def test_incidence_of_copies(spark):
    """Long segments stand in the cells along them, not in all of their boxes; copies count as often as they are there."""
    cells = spark.range(1).select(topology.line_cells(*map(F.lit, (0, 0, 1000, 1000)), 10.0).alias("c")).first().c
    assert {(k, k) for k in range(100)} <= {tuple(c) for c in cells} and len(cells) == len(set(map(tuple, cells))) < 400
    c = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 500, 500), (4, 1000, 1000), (5, 500, 501), (6, 7, 900), (7, 7, 3)], "chamber_id long, x long, y long")
    s = spark.createDataFrame([(0, 0, 1000, 1000)] * 3 + [(7, 950, 7, 3), (1000, 1000, 1000, 1000)], "ax long, ay long, bx long, by long")
    want = {1: 3, 2: 3, 3: 6, 4: 3, 5: 0, 6: 2, 7: 1}
    for size in (10_000.0, 3.0):
        assert {r.chamber_id: r.incident for r in topology.incidence(c, s, size).collect()} == want


def test_nearest_of_copies(spark, monkeypatch):
    seen = watch(monkeypatch, topology, "within_distance")
    p = spark.range(300).select(F.col("id").alias("point_id"), (F.col("id") % 3 * 40).alias("x"), F.lit(0).alias("y"))
    t = spark.createDataFrame([(9, 3, 0), (5, 3, 0), (7, -3, 0), (8, 40, 60), (6, 500, 500)], "chamber_id long, x long, y long")
    got = {(r.point_id % 3, r.chamber_id, r.distance2) for r in topology.nearest_in_grid(p, t, 62).collect()}
    assert got == {(0, 5, 9), (1, 5, 37 * 37)}
    assert topology.nearest_in_grid(p, t, 80).count() == 300
    assert topology.nearest_in_grid(p, t.limit(0), 80).count() == topology.nearest_in_grid(p.limit(0), t, 80).count() == 0
    assert max(seen) == 3


def test_distance_of_copies(spark, monkeypatch):
    """Equal points and equal segments take part once."""
    rows = []
    real = topology.dealt
    monkeypatch.setattr(topology, "dealt", lambda df, *k: rows.append(df.select("ax", "ay", "bx", "by", "cell").count()) or real(df, *k))
    p = spark.range(200).select(F.col("id").alias("point_id"), (F.col("id") % 2 * 900).alias("x"), F.lit(100).alias("y"))
    s = spark.createDataFrame([(0, 0, 1000, 1000)] * 50, "ax long, ay long, bx long, by long")
    got = {(r.point_id % 2, round(r.distance, 6)) for r in topology.distance_to_segments(p, s).collect()}
    assert got == {(0, round(50 * 2**0.5, 6)), (1, round(400 * 2**0.5, 6))}
    assert max(rows) < 50


@pytest.mark.parametrize("length", [1024, 2])
def test_pairs_of_places(spark, monkeypatch, length):
    seen = watch(monkeypatch, topology, "within_distance")
    monkeypatch.setattr(topology, "LIST", length)
    p = spark.range(60).select(F.col("id").alias("point_id"), (F.col("id") % 3 * 10).alias("x"), F.lit(0).alias("y"))
    t = spark.range(8).select(F.col("id").alias("chamber_id"), (F.col("id") % 4 * 10).alias("x"), F.lit(5).alias("y"))
    want = sorted((a, b, d) for a in range(60) for b in range(8) if (d := (a % 3 * 10 - b % 4 * 10) ** 2 + 25) <= 125)
    assert sorted(map(tuple, topology.pairs_within(p, t, 125**0.5, "point_id", "chamber_id").collect())) == want
    assert seen[0] == 3 if length == 1024 else seen[0] > 3


def test_search_by_place(spark):
    """The search gets one point of a place; all points there get its rows."""
    p = spark.range(30).select(F.col("id").alias("point_id"), (F.col("id") % 2).alias("x"), F.lit(0).alias("y"))
    p = p.unionByName(p.where("point_id = 7"))  # a row that is there twice
    counts = []

    def search(places):
        counts.append(places.count())
        return places.select("point_id", F.explode(F.array(F.col("x"), F.col("x") + 10)).alias("v"))

    assert sorted(map(tuple, topology.by_place(p, search).collect())) == sorted((i, i % 2 + k) for i in range(30) for k in (0, 10))
    assert counts == [2]
