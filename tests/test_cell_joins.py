"""Joins in grid cells: how they are dealt, what their plans hold, and the exact predicates on small grids."""

import itertools

import pytest
from pyspark.sql import functions as F

from netloom.functions import geometry
from netloom.operators import catalog, obstacles


def test_cells_keep_their_partitions(spark):
    """Adaptive execution must not merge the cells of small tables into one task."""
    a = spark.range(200).select(F.col("id").alias("route"), *[(F.col("id") * k % 97).cast("double").alias(n) for k, n in ((3, "ax"), (5, "ay"), (7, "bx"), (11, "by"))])
    b = spark.range(200).select(F.col("id").alias("line"), *[(F.col("id") * k % 97).cast("double").alias(n) for k, n in ((13, "cx"), (17, "cy"), (19, "dx"), (23, "dy"))])
    assert obstacles.pairs_in_reach(a, b, 10.0).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_grid_is_not_exchanged_again(spark):
    t = spark.createDataFrame([(1, 0, 0), (1, 50, 40), (2, 10, 10)], "problem long, x long, y long")
    b = spark.createDataFrame([(1, -5, 5, -5, 5), (1, 20, 60, 30, 70), (1, 20, 60, 30, 70), (2, 0, 5, 0, 5)], "problem long, x1 long, x2 long, y1 long, y2 long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    grid = catalog.corridor_grid(t, b)
    plan = grid._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(problem" in line and "(x#" in line]
    axes = {p: [sorted({v for q, *c in t.collect() if q == p for v in c[k : k + 1]} | {v for q, *c in b.collect() if q == p for v in c[2 * k : 2 * k + 2]}) for k in (0, 1)] for p in (1, 2)}
    free = lambda p, x, y: not any(q == p and x1 < x < x2 and y1 < y < y2 for q, x1, x2, y1, y2 in b.collect())
    assert sorted(map(tuple, grid.collect())) == sorted((p, float(x), float(y)) for p, (xs, ys) in axes.items() for x in xs for y in ys if free(p, x, y))


def test_near_intervals_write_no_step_out_again(spark):
    v = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 10.0, 0.0)], "route long, seq int, x double, y double")
    u = spark.createDataFrame([(7, 5.0, 1.0, 5.0, 8.0)], "utility long, cx double, cy double, dx double, dy double")
    near = obstacles.near_intervals(v, u, 2.0, 5.0)
    assert len(near._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    (row,) = near.collect()
    assert (row.route, row.utility, row.s, row.e) == (1, 7, 3268, 6732)


def test_blocked_lines(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    areas = spark.createDataFrame([(1, "park", ring)], "obstacle long, kind string, ring array<struct<x:double,y:double>>")
    lines = spark.createDataFrame([(1, 5.0, 5.0, 6.0, 6.0), (2, -5.0, 5.0, 15.0, 5.0), (3, -5.0, 11.0, 15.0, 12.0), (4, 20.0, 20.0, 20.0, 20.0), (5, 10.0, 0.0, 20.0, 0.0)], "line long, ax double, ay double, bx double, by double")
    found = [r.line for r in obstacles.blocked_lines(lines, areas, 4.0).collect()]
    assert sorted(found) == [1, 2, 5] == sorted(r.line for r in obstacles.line_blockers(lines, areas, 4.0).collect())


@pytest.mark.parametrize("size", [3])
def test_segments_intersect_on_a_grid(spark, size):
    """All pairs of segments, points among them, of a small grid against rational arithmetic."""
    from fractions import Fraction

    points = list(itertools.product(range(size), repeat=2))
    pairs = [(*p, *q) for p in points for q in points]

    def meet(s, t):
        (ax, ay, bx, by), (cx, cy, dx, dy) = s, t
        ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
        det = ux * vy - uy * vx
        if det:
            a, b = Fraction((cx - ax) * vy - (cy - ay) * vx, det), Fraction((cx - ax) * uy - (cy - ay) * ux, det)
            return 0 <= a <= 1 and 0 <= b <= 1
        on = lambda x, y, l: (l[2] - l[0]) * (y - l[1]) == (l[3] - l[1]) * (x - l[0]) and min(l[0], l[2]) <= x <= max(l[0], l[2]) and min(l[1], l[3]) <= y <= max(l[1], l[3])
        return on(ax, ay, t) or on(bx, by, t) or on(cx, cy, s) or on(dx, dy, s)

    df = spark.createDataFrame([(*s, *t, meet(s, t)) for s in pairs for t in pairs], "ax int, ay int, bx int, by int, cx int, cy int, dx int, dy int, wanted boolean")
    assert df.where(geometry.segments_intersect(*[F.col(c) for c in "ax ay bx by cx cy dx dy".split()]) != F.col("wanted")).count() == 0


def test_short_stretches_are_violations(spark):
    """Near stretches that round to one millimetre stay, unless they are allowed."""
    schema = "route long, utility long, s long, e long"
    near = spark.createDataFrame([(1, 7, 5, 5), (1, 7, 10, 30), (2, 7, 5, 5), (2, 8, 5, 5), (3, 7, 3, 3), (4, 7, 9, 9)], schema)
    allowed = spark.createDataFrame([(1, 7, 15, 20), (2, 7, 0, 9), (3, 7, 3, 8), (4, 7, 0, 5)], schema)
    assert sorted(map(tuple, obstacles.clearance_violations(near, allowed).collect())) == [(1, 7, 5, 5), (1, 7, 10, 15), (1, 7, 20, 30), (2, 8, 5, 5), (4, 7, 9, 9)]
