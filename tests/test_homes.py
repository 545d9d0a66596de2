"""Routes that meet what is around their home in a task, against the joins in cells that larger routes go by."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import homes, obstacles

RING = "obstacle long, kind string, ring array<struct<x:double,y:double>>"


def tables(spark, seed=3):
    rnd = random.Random(seed)
    at = lambda n: float(rnd.randrange(n))
    vertices = []
    for route in range(60):
        x, y = at(100), at(100)
        for seq in range(rnd.choice((1, 2, 3, 6))):
            vertices.append((route, seq, x, y))
            reach = 90 if route % 9 == 0 else 12
            if rnd.random() < 0.85:  # else the next vertex is at the same place
                x, y = x + rnd.randrange(-reach, reach + 1), y + (rnd.randrange(-reach, reach + 1) if rnd.random() < 0.8 else 0)
    areas = []
    for k in range(24):
        x, y, half = at(100), at(100), 2.5 + k % 7
        ring = [(x, y - half), (x + half, y), (x, y + half), (x - half, y), (x, y - half)]
        kind = ("road", "park", "tram_tracks", "water")[k % 4]
        areas.append((k, kind, ring))
        if k % 5 == 0:
            areas.append((100 + k, kind, ring))  # the same ring again
        if k % 6 == 0:
            areas.append((k, kind, [(a + 20, b - 3) for a, b in ring]))  # a second ring of one obstacle
    lines = [(k % 20, *(v := (at(100), at(100))), v[0] + rnd.randrange(-9, 10), v[1] + rnd.choice((0, 0, 5, -7))) for k in range(50)]
    long = spark.createDataFrame(vertices, "route long, seq int, x double, y double")
    return long, spark.createDataFrame(areas, RING), spark.createDataFrame(lines, "utility long, cx double, cy double, dx double, dy double")


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize("hot", [8192, 2])
def test_home_and_cells_agree(spark, monkeypatch, hot):
    monkeypatch.setattr(homes, "HOT", hot)
    v, areas, lines = (t.cache() for t in tables(spark))
    rules = spark.createDataFrame([("road", 90.0, 6.0, 9.0), ("tram_tracks", 45.0, 6.0, 5.0)], "kind string, min_angle double, extension double, horizontal double")
    straight = obstacles.route_segments(v).select(F.struct("route", F.col("seq") % 2).alias("line"), "ax", "ay", "bx", "by")
    for near, far in (
        (obstacles.routes_on_obstacles(v, areas, 8.0), obstacles._routes_on_obstacles(v, areas, 8.0)),
        (obstacles.line_blockers(straight, areas, 8.0), obstacles._line_blockers(straight, areas, 8.0)),
        (obstacles.assess_crossings(v, areas, rules, 8.0), obstacles._assess_crossings(v, areas, rules, 8.0, 9.0)),
        (obstacles.near_intervals(v, lines, 4.0, 8.0), obstacles._near_intervals(v, lines, 4.0, 8.0)),
        (obstacles.utility_plateaus(v, lines, 8.0), obstacles._utility_plateaus(v, lines, 8.0)),
        (obstacles.floors_from_areas(v, areas, 8.0), obstacles._floors_from_areas(v, areas, 8.0)),
    ):
        found = rows(near)
        assert found and found == rows(far)


def test_pairs_are_not_exchanged(spark):
    """What is made of pairs grows with the product of both tables, so nothing is exchanged or sorted after they meet."""
    v, areas, lines = tables(spark)
    rules = spark.createDataFrame([("road", 90.0, 6.0, 9.0)], "kind string, min_angle double, extension double, horizontal double")
    near = obstacles.near_intervals(v, lines, 4.0, 8.0)
    middle = F.expr("e - s > 2000")
    for df in (
        obstacles.routes_on_obstacles(v, areas, 8.0),
        obstacles.assess_crossings(v, areas, rules, 8.0),
        near,
        obstacles.outside_stretches(near, (F.when(middle, F.col("s") + 1000), F.when(middle, F.col("e") - 1000))),
        obstacles.utility_plateaus(v, lines, 8.0),
        obstacles.floors_from_areas(v, areas, 8.0),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        above = plan[: plan.index("MapInArrow")]
        assert "Exchange" not in above and "Aggregate" not in above and "Window" not in above


def test_outside_stretches(spark):
    """Row by row as ``clearance_violations`` has it by joins."""
    schema = "route long, utility long, s long, e long, lo long, hi long"
    near = spark.createDataFrame([(1, 7, 5, 5, None, None), (2, 7, 10, 30, 15, 20), (3, 7, 10, 30, 0, 12), (4, 7, 10, 30, 25, 40), (5, 7, 10, 30, 0, 40), (6, 7, 5, 5, 5, 9), (7, 7, 5, 5, 6, 9), (8, 7, 10, 30, 30, 44), (9, 7, 10, 30, None, None)], schema)
    allowed = near.where("lo IS NOT NULL").select("route", "utility", F.col("lo").alias("s"), F.col("hi").alias("e"))
    assert rows(obstacles.outside_stretches(near, (F.col("lo"), F.col("hi")))) == rows(obstacles.clearance_violations(near.drop("lo", "hi"), allowed))
