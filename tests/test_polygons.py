"""Each defect of polygons with holes and of multi-polygons, planted and found."""

from netloom.operators.polygons import polygon_issues

SCHEMA = "feature_index long, parts array<array<array<struct<x:double,y:double>>>>"


def box(x, y, w, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def ring(*points):
    return [*points, points[0]]


SHELL = box(0, 0, 20)
CASES = {
    "square": ([[SHELL]], set()),
    "hole": ([[SHELL, box(5, 5, 3)]], set()),
    "hole that touches once": ([[SHELL, ring((0, 10), (5, 8), (5, 12))]], set()),
    "hole that touches twice": ([[SHELL, ring((0, 10), (10, 0), (10, 10))]], {"DISCONNECTED_INTERIOR"}),
    "hole outside": ([[SHELL, box(30, 5, 3)]], {"HOLE_OUTSIDE_SHELL"}),
    "hole around the shell": ([[SHELL, box(-5, -5, 40)]], {"HOLE_OUTSIDE_SHELL"}),
    "hole outside, touching": ([[SHELL, ring((20, 10), (25, 8), (25, 12))]], {"HOLE_OUTSIDE_SHELL"}),
    "hole across": ([[SHELL, box(15, 5, 10)]], {"SELF_INTERSECTION"}),
    "hole along the shell": ([[SHELL, box(0, 5, 5)]], {"SELF_INTERSECTION"}),
    "hole in a hole": ([[SHELL, box(5, 5, 10), box(7, 7, 2)]], {"NESTED_HOLES"}),
    "two holes": ([[SHELL, box(2, 2, 5), box(10, 10, 5)]], set()),
    "holes that touch": ([[SHELL, box(2, 2, 5), ring((7, 5), (10, 3), (10, 7))]], set()),
    "equal holes": ([[SHELL, box(2, 2, 5), box(2, 2, 5)]], {"SELF_INTERSECTION"}),
    "bow tie": ([[ring((0, 0), (10, 10), (10, 0), (0, 10))]], {"SELF_INTERSECTION"}),
    "touches itself": ([[ring((0, 0), (10, 0), (10, 10), (5, 0), (0, 10))]], {"SELF_INTERSECTION"}),
    "spike": ([[ring((0, 0), (10, 0), (10, 10), (10, 0), (0, 10))]], {"SELF_INTERSECTION"}),
    "repeated point": ([[[(0, 0), (10, 0), (10, 0), (10, 10), (0, 0)]]], set()),
    "two parts": ([[SHELL], [box(30, 0, 5)]], set()),
    "parts that touch": ([[SHELL], [box(20, 20, 5)]], set()),
    "part in a part": ([[SHELL], [box(5, 5, 5)]], {"NESTED_SHELLS"}),
    "part in a hole": ([[SHELL, box(2, 2, 15)], [box(5, 5, 5)]], set()),
    "part in a part in a hole": ([[SHELL, box(2, 2, 15)], [box(5, 5, 5)], [box(6, 6, 2)]], {"NESTED_SHELLS"}),
    "parts that overlap": ([[SHELL], [box(10, 10, 20)]], {"SELF_INTERSECTION"}),
    "through a corner": ([[ring((0, 0), (20, 0), (20, 20), (10, 10), (0, 20)), ring((2, 10), (18, 10), (10, 5))]], set()),
    "out at a corner": ([[ring((0, 0), (20, 0), (20, 20), (10, 8), (0, 20)), ring((5, 8), (15, 8), (10, 12), (10, 9))]], {"SELF_INTERSECTION"}),
    "piece outside": ([[ring((0, 0), (30, 0), (30, 20), (20, 10), (15, 12), (10, 10), (0, 20)), ring((5, 5), (25, 5), (20, 10), (10, 10))]], {"DISCONNECTED_INTERIOR"}),
    "open": ([[[(0, 0), (10, 0), (10, 10), (0, 10)]]], {"OPEN_RING"}),
    "short": ([[[(0, 0), (10, 0), (0, 0)]]], {"EMPTY_GEOMETRY"}),
    "nothing": ([], {"EMPTY_GEOMETRY"}),
    "null": (None, {"EMPTY_GEOMETRY"}),
    "far away": ([[[(0, 0), (200, 0), (10, 10), (0, 0)]]], {"INVALID_COORDINATE"}),
    "not a number": ([[[(0, 0), (float("nan"), 0), (10, 10), (0, 0)]]], {"INVALID_COORDINATE"}),
    "null coordinate": ([[[(0, 0), (None, 0), (10, 10), (0, 0)]]], {"INVALID_COORDINATE"}),
    "two defects": ([[SHELL, box(30, 5, 3), [(0, 0), (1, 1), (0, 0)]]], {"EMPTY_GEOMETRY", "HOLE_OUTSIDE_SHELL"}),
}


def test_planted_defects(spark):
    rows = [(i, p and [[[(None if x is None else float(x), float(y)) for x, y in r] for r in part] for part in p] if p is not None else None) for i, (p, _) in enumerate(CASES.values())]
    got = {}
    for r in polygon_issues(spark.createDataFrame(rows, SCHEMA), 4.0).collect():
        got.setdefault(r.feature_index, set()).add(r.code)
    assert {name: got.get(i, set()) for i, name in enumerate(CASES)} == {name: want for name, (_, want) in CASES.items()}
