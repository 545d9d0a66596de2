"""Buffers against closed forms: area, length, rings, holes that close, and overlaps."""

from math import pi, sin, sqrt

import pytest
from pyspark.sql import functions as F

from netloom.operators import buffers
from netloom.operators.polygons import rings_of, sides_of

LINES = "feature_index long, piece int, distance double, ax double, ay double, bx double, by double"
SCHEMA = "feature_index long, parts array<array<array<struct<x:double,y:double>>>>"
Q = 8


def disc(d):
    """Area of the polygon that stands for a disc."""
    return 2 * Q * d * d * sin(pi / (2 * Q))


def box(x, y, w):
    return [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))]


def shoelace(found):
    out = {}
    for (f, _), g in found.groupby(["feature_index", "ring"]):
        p = list(zip(g.sort_values("seq")["x"], g.sort_values("seq")["y"]))
        out.setdefault(f, []).append(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2)
    return out


def test_lines(spark):
    rows = [
        (1, 1, 2.0, 0.0, 0.0, 10.0, 0.0),  # a capsule
        (2, 1, 2.0, 0.0, 0.0, 10.0, 0.0), (2, 2, 2.0, 10.0, 0.0, 20.0, 0.0),  # a straight joint
        (3, 1, 2.0, 0.0, 0.0, 10.0, 0.0), (3, 2, 2.0, 10.0, 0.0, 0.0, 0.0),  # back on itself
        (4, 1, 2.0, 5.0, 5.0, 5.0, 5.0),  # a point
        (5, 1, 1.0, 0.0, 0.0, 10.0, 0.0), (5, 2, 1.0, 10.0, 0.0, 10.0, 10.0), (5, 3, 1.0, 10.0, 10.0, 0.0, 10.0), (5, 4, 1.0, 0.0, 10.0, 0.0, 0.0),  # round a court
        (6, 1, 1.0, 0.0, 0.0, 10.0, 0.0), (6, 2, 1.0, 5.0, -5.0, 5.0, 5.0),  # a cross
        (7, 1, 1.0, 0.0, 0.0, 10.0, 0.0), (7, 2, 1.0, 0.0, 2.0, 10.0, 2.0),  # flanks that run together
        (8, 1, 0.0, 0.0, 0.0, 1.0, 0.0), (9, 1, None, 0.0, 0.0, 1.0, 0.0), (9, 2, 1.0, None, 0.0, 1.0, 0.0),  # nothing
    ]
    edges = buffers.boundary(spark.createDataFrame(rows, LINES), 3.0, Q).cache()
    area = {r.feature_index: r.area for r in buffers.measures(edges).collect()}
    found = shoelace(buffers.rings(edges).toPandas())
    want = {1: 40 + disc(2), 2: 80 + disc(2), 3: 40 + disc(2), 4: disc(2), 5: 80 - 4 + disc(1), 6: 40 - 4 + 2 * disc(1), 7: 40 + 2 * disc(1)}
    assert set(area) == set(want) == set(found)
    for f in set(want) - {7}:
        assert area[f] == pytest.approx(want[f], abs=1e-5), f
        assert sum(found[f]) == pytest.approx(want[f], abs=1e-5), f
    assert area[7] == pytest.approx(40 + 2 * disc(1), abs=1e-5)
    assert sorted(map(len, found.values()), reverse=True)[0] == 2 and sorted(x > 0 for x in found[5]) == [False, True]


@pytest.mark.parametrize("turned", [False, True])
def test_polygons(spark, turned):
    ring = lambda *p: list(reversed(p[0])) if turned else p[0]
    hole, small = box(5, 5, 10), box(9, 9, 2)
    cases = [(1, [[ring(box(0, 0, 20))]]), (2, [[ring(box(0, 0, 20)), ring(hole)]]), (3, [[ring(box(0, 0, 20)), ring(small)]]), (4, [[ring(box(0, 0, 20))], [ring(box(22, 0, 20))]]), (5, None)]
    sides = buffers.oriented(sides_of(rings_of(spark.createDataFrame(cases, SCHEMA)))).cache()
    named = sides.select("feature_index", F.struct("part", "ring", "id").alias("piece"), F.lit(3.0).alias("distance"), "ax", "ay", "bx", "by")
    outer = buffers.boundary(named, 4.0, Q, sides).cache()
    area = {r.feature_index: r.area for r in buffers.measures(outer).collect()}
    whole = 400 + 4 * 20 * 3 + disc(3)
    assert area[1] == pytest.approx(whole, abs=1e-5)
    assert area[2] == pytest.approx(whole - 16, abs=1e-5)  # the court of 10 keeps 4 * 4
    assert area[3] == pytest.approx(whole, abs=1e-5)  # the court of 2 closes
    both = buffers.difference(outer, sides)
    ring_area = {r.feature_index: r.area for r in buffers.measures(both).collect()}
    assert ring_area[1] == pytest.approx(whole - 400, abs=1e-5)
    assert ring_area[2] == pytest.approx(whole - 16 - 300, abs=1e-5)
    found = shoelace(buffers.rings(both).toPandas())
    assert len(found[1]) == 2 and len(found[2]) == 4 and len(found[3]) == 3
    assert {f: pytest.approx(sum(r), abs=1e-4) for f, r in found.items()} == ring_area
    assert 5 not in area


def test_true_distance(spark):
    """Every corner lies at the distance or a little below it, never beyond, and none is nearer than the chord allows."""
    rows = [(1, i, 2.0, float(a), float(b), float(c), float(d)) for i, (a, b, c, d) in enumerate([(0, 0, 9, 4), (9, 4, 3, 8), (3, 8, 12, 9), (12, 9, 5, -3)])]
    edges = buffers.boundary(spark.createDataFrame(rows, LINES), 2.5, Q).toPandas()
    for x, y in zip((edges.ax + edges.bx) / 2, (edges.ay + edges.by) / 2):
        least = 1e9
        for *_, a, b, c, d in rows:
            t = max(0.0, min(1.0, ((x - a) * (c - a) + (y - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))
            least = min(least, sqrt((a + t * (c - a) - x) ** 2 + (b + t * (d - b) - y) ** 2))
        assert 2 * 0.99 <= least <= 2 + 1e-9


def test_empty(spark):
    edges = buffers.boundary(spark.createDataFrame([], LINES), 3.0)
    assert edges.count() == 0 and buffers.rings(edges).count() == 0
