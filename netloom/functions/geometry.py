"""Planar geometry as column expressions: they stay in whole-stage code and need no Python worker.

Points are pairs of columns in metres; coordinates that come from whole
millimetres stay exact in the predicates that only add and multiply.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 3) -> Column:
    """floor(x * 10^digits + 0.5), a long: the rounding of stored coordinates, also for negative values."""
    return F.floor(x * 10**digits + 0.5).cast("long")


def segment_length(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def station_share(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where the nearest point of a segment lies, from 0 at a to 1 at b; 0 on a segment without length."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    raw = ((px - ax) * dx + (py - ay) * dy) / F.nullif(square, F.lit(0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(0.0))


def point_segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = station_share(px, py, ax, ay, bx, by)
    return segment_length(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum(((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)).cast("double"))


def straddle(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether neither of two segments lies wholly on one side of the other's line."""
    o1, o2 = orientation(ax, ay, bx, by, cx, cy), orientation(ax, ay, bx, by, dx, dy)
    o3, o4 = orientation(cx, cy, dx, dy, ax, ay), orientation(cx, cy, dx, dy, bx, by)
    return (o1 * o2 <= 0) & (o3 * o4 <= 0)


def segments_intersect(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether two closed segments share a point: their boxes overlap, and neither lies on one side of the other. Exact on whole coordinates."""
    return boxes_overlap(ax, ay, bx, by, cx, cy, dx, dy) & straddle(ax, ay, bx, by, cx, cy, dx, dy)


def boxes_overlap(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    return (F.least(ax, bx) <= F.greatest(cx, dx)) & (F.greatest(ax, bx) >= F.least(cx, dx)) & (F.least(ay, by) <= F.greatest(cy, dy)) & (F.greatest(ay, by) >= F.least(cy, dy))


def angle_between(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Degrees from 0 to 180 between two vectors."""
    dot = ux * vx + uy * vy
    cross = ux * vy - uy * vx
    return F.degrees(F.atan2(F.abs(cross).cast("double"), dot.cast("double")))


def acute_angle(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    a = angle_between(ux, uy, vx, vy)
    return F.least(a, 180 - a)


def satisfies_least_angle(actual: Column, least: Column) -> Column:
    """A right angle is allowed 0.1 degrees, others only the error of arithmetic."""
    return actual + F.when(least >= 89.9, 0.1).otherwise(1e-7) >= least


def turn_tolerance(length_a: Column, length_b: Column) -> Column:
    """Degrees by which millimetre rounding can turn a segment, at most 0.1."""
    shortest = F.least(length_a, length_b)
    return F.least(F.lit(0.1), F.degrees(F.asin(F.least(F.lit(1.0), 0.001414 / F.nullif(shortest, F.lit(0.0))))))


def turn_allowed(turn: Column, tolerance: Column, least_turn: float = 60.0) -> Column:
    """A route goes straight on (half a degree) or turns by ``least_turn`` to 90 degrees; 0 allows every turn up to 90."""
    return (turn <= 0.5) | ((turn + tolerance >= least_turn) & (turn <= 90 + tolerance))


def compatible_rays(ux, uy, vx, vy, tolerance: float = 0.1) -> Column:
    a = angle_between(ux, uy, vx, vy)
    return (F.abs(a - 90) <= tolerance) | (F.abs(a - 180) <= tolerance)


def axis_clearance(kind: Column, horizontal: Column, building: Column, half_width: Column, existing_half_width: Column) -> Column:
    """Metres from a new pipe's axis to a constraint: its clearance, half of the new pair, half of the object."""
    own = F.when(kind == "gas_pipeline", 0.20).when(kind == "power_cable", 0.10).when(kind == "heat_network", existing_half_width).otherwise(0.0)
    return F.when(kind == "oks", building).otherwise(horizontal.cast("double")) + half_width + own


def vertices_to_segments(vertices: DataFrame, route: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """Segments of polylines with the turn at their start: one window over each route, no self-join."""
    w = Window.partitionBy(route).orderBy(order)
    nx, ny = F.lead(x).over(w), F.lead(y).over(w)
    px, py = F.lag(x).over(w), F.lag(y).over(w)
    out = vertices.select("*", nx.alias("nx"), ny.alias("ny"), px.alias("px"), py.alias("py"))
    return out.where("nx IS NOT NULL").withColumns(
        {
            "length": segment_length(F.col(x), F.col(y), F.col("nx"), F.col("ny")),
            "turn": F.when(F.col("px").isNotNull(), angle_between(F.col(x) - F.col("px"), F.col(y) - F.col("py"), F.col("nx") - F.col(x), F.col("ny") - F.col(y))),
        }
    )


#: WGS84 ellipsoid and UTM scale.
SEMI_MAJOR, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996


def utm_forward(lon: Column, lat: Column, zone: int = 37) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series in the third flattening, to the sixth order of the series."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2
    s = F.sin(phi)
    t = F.sinh(atanh(s) - e * atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + SCALE * radius * east, SCALE * radius * north


def utm_inverse(east: Column, north: Column, zone: int = 37) -> tuple[Column, Column]:
    """Longitude and latitude of a projected place: the inverse Krueger series, then fixed-point steps from the conformal latitude."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    e = 2 * math.sqrt(n) / (1 + n)
    eta, xi = (east - 500_000) / (SCALE * radius), north / (SCALE * radius)
    x, y = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal = F.asin(F.sin(x) / F.cosh(y))
    goal = F.log((1 + F.sin(conformal)) / (1 - F.sin(conformal))) / 2
    step = lambda phi, _: F.atan(F.sinh(goal + e * F.log((1 + e * F.sin(phi)) / (1 - e * F.sin(phi))) / 2))
    latitude = F.aggregate(F.sequence(F.lit(1), F.lit(6)), conformal, step)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(latitude)


def ring_contains(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd test of a point against a closed ring, an array of structs (x, y)."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        above = (a["y"] > py) != (b["y"] > py)
        at = a["x"] + (py - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0))
        return F.when(above & (px < at), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n - 1), crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


def wall_normals(walls: DataFrame) -> DataFrame:
    """From walls (point_id, px, py, ax, ay, bx, by): the perpendicular exits of each point, nearest first, ties by wall order."""
    share = ((F.col("px") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("py") - F.col("ay")) * (F.col("by") - F.col("ay"))) / F.nullif((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2, F.lit(0.0))
    out = walls.withColumn("t", share).where("t BETWEEN 0 AND 1").withColumns({"fx": F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax")), "fy": F.col("ay") + F.col("t") * (F.col("by") - F.col("ay"))})
    out = out.withColumn("distance", segment_length(F.col("px"), F.col("py"), F.col("fx"), F.col("fy")))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("point_id").orderBy("distance", "wall")))
