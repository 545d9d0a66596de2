"""Registered queries of buffers and their rings, with SQL checks that compare all edges of a feature."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import half_up, vertices_to_segments
from ..operators import buffers
from ..operators.polygons import rings_of, sides_of
from .project import role, role_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CELL = 1000.0
#: Corners of the buildings and of their courts, in shares of their half width.
SHELL = [(0.0, -1.0), (1.0, 0.0), (0.0, 1.0), (-1.0, 0.5), (-0.25, 0.0), (-1.0, -0.5), (0.0, -1.0)]
COURT = [(0.0625, 0.0), (0.25, 0.1875), (0.4375, 0.0), (0.25, -0.1875), (0.0625, 0.0)]


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def buffer_sql(sides: str, quadrant: int, polygon: bool = False) -> str:
    """CTEs from ``sides`` (f, p, d, ax, ay, ex, ey) to ``kept`` (f, ax, ay, ex, ey, n): every edge against every other of its feature."""
    turns = ", ".join(f"({k}, {end}, {c!r}, {s!r})" for k, end, c, s in buffers.turns(quadrant))
    odd = "AND NOT (SELECT count(*) % 2 = 1 FROM sd s WHERE s.f = g.f AND (s.ay > g.my) <> (s.ey > g.my) AND s.ax + (g.my - s.ay) * (s.ex - s.ax) / nullif(s.ey - s.ay, 0.0) > g.mx)" if polygon else ""
    return f""", sd AS ({sides}), turn(k, b, c, s) AS (VALUES {turns}),
unit AS (SELECT *, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE (ex - ax) / n END AS ux, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE (ey - ay) / n END AS uy FROM (SELECT *, sqrt((ex-ax)*(ex-ax)+(ey-ay)*(ey-ay)) AS n FROM sd)),
corner AS (SELECT f, p, k, CASE WHEN b THEN ex ELSE ax END + d * (ux * c::DOUBLE - uy * s::DOUBLE) AS x, CASE WHEN b THEN ey ELSE ay END + d * (ux * s::DOUBLE + uy * c::DOUBLE) AS y FROM unit, turn),
edge AS (SELECT *, sqrt((ex-ax)*(ex-ax)+(ey-ay)*(ey-ay)) AS n FROM (SELECT f, p, k, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS ex, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ey FROM corner WINDOW w AS (PARTITION BY f, p ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))),
e AS (SELECT * FROM edge WHERE n > 1e-6),
pair AS (SELECT a.f, a.p, a.k, a.n, o.n AS m, a.ex-a.ax AS ux, a.ey-a.ay AS uy, o.ex-o.ax AS vx, o.ey-o.ay AS vy, o.ax-a.ax AS wx, o.ay-a.ay AS wy, o.ex-a.ax AS zx, o.ey-a.ay AS zy FROM e a JOIN e o ON a.f = o.f AND a.p <> o.p AND least(a.ax,a.ex) <= greatest(o.ax,o.ex)+1e-6 AND greatest(a.ax,a.ex) >= least(o.ax,o.ex)-1e-6 AND least(a.ay,a.ey) <= greatest(o.ay,o.ey)+1e-6 AND greatest(a.ay,a.ey) >= least(o.ay,o.ey)-1e-6),
stop AS (SELECT f, p, k, (wx*vy-wy*vx)/(ux*vy-uy*vx) AS t FROM pair WHERE abs(ux*vy-uy*vx) > 1e-9*n*m AND (wx*uy-wy*ux)/(ux*vy-uy*vx) BETWEEN -1e-9 AND 1+1e-9
  UNION ALL SELECT f, p, k, unnest([(wx*ux+wy*uy)/(n*n), (zx*ux+zy*uy)/(n*n)]) FROM pair WHERE abs(ux*vy-uy*vx) <= 1e-9*n*m AND abs(wx*uy-wy*ux) <= 1e-6*n
  UNION ALL SELECT f, p, k, unnest([0.0, 1.0]) FROM e),
frag AS (SELECT f, p, k, e.ax+t*(ex-ax) AS ax, e.ay+t*(ey-ay) AS ay, e.ax+u*(ex-ax) AS ex, e.ay+u*(ey-ay) AS ey, (u-t)*n AS n, e.ax+(t+u)/2*(ex-ax) AS mx, e.ay+(t+u)/2*(ey-ay) AS my FROM (SELECT *, lead(t) OVER (PARTITION BY f, p, k ORDER BY t) AS u FROM stop WHERE t BETWEEN 0 AND 1) JOIN e USING (f, p, k) WHERE (u-t)*n > 1e-6),
test AS (SELECT g.f, g.p, g.k, g.mx, g.my, o.p AS q, min(((o.ex-o.ax)*(g.my-o.ay)-(o.ey-o.ay)*(g.mx-o.ax))/o.n) AS depth, arg_min((o.ex-o.ax)*(g.ex-g.ax)+(o.ey-o.ay)*(g.ey-g.ay), ((o.ex-o.ax)*(g.my-o.ay)-(o.ey-o.ay)*(g.mx-o.ax))/o.n) AS along FROM frag g JOIN e o ON g.f = o.f AND g.p <> o.p GROUP BY ALL),
gone AS (SELECT DISTINCT f, p, k, mx, my FROM test WHERE depth > 1e-6 OR (depth >= -1e-6 AND (along < 0 OR q < p))),
kept AS (SELECT g.* FROM frag g ANTI JOIN gone USING (f, p, k, mx, my) WHERE true {odd})"""


CORRIDOR = "SELECT route AS f, seq AS p, CAST(100 + 50 * (route % 5) AS DOUBLE) AS d, x AS ax, y AS ay, ex AS ex, ey AS ey FROM (SELECT *, lead(x) OVER w AS ex, lead(y) OVER w AS ey FROM bends WINDOW w AS (PARTITION BY route ORDER BY seq)) WHERE ex IS NOT NULL"
SIZE = "CAST(floor(sum(ax*ey-ex*ay) / 2 * %s + 0.5) AS BIGINT)"


@query(role_sql("bends") + buffer_sql(CORRIDOR, 4) + f" SELECT f AS route, {SIZE % '0.1'} AS tens, CAST(floor(sum(n) * 10 + 0.5) AS BIGINT) AS length_dm FROM kept GROUP BY f")
def route_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the ground within a route's clearance, with four segments a quarter circle: area in tens and length of the boundary."""
    sides = vertices_to_segments(role(spark, sf_dir, "bends"), "route", "seq").select(F.col("route").alias("feature_index"), F.col("seq").alias("piece"), (100 + 50 * (F.col("route") % 5)).cast("double").alias("distance"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("nx").alias("bx"), F.col("ny").alias("by"))
    found = buffers.measures(buffers.boundary(sides, CELL, 4))
    return found.select(F.col("feature_index").alias("route"), half_up(F.col("area") * 0.1, 0).alias("tens"), half_up(F.col("length"), 1).alias("length_dm"))


def _sides_sql() -> str:
    runs = [(i + 10 * r, *a, *b) for r, ring in enumerate((SHELL, COURT)) for i, (a, b) in enumerate(zip(ring, ring[1:], strict=False))]
    values = ", ".join(str(v) for v in runs)
    return f"SELECT obstacle AS f, p, CAST(50 + 150 * (obstacle % 4) AS DOUBLE) AS d, mx + half * x1::DOUBLE AS ax, my + half * y1::DOUBLE AS ay, mx + half * x2::DOUBLE AS ex, my + half * y2::DOUBLE AS ey FROM areas, (VALUES {values}) v(p, x1, y1, x2, y2)"


BUILDING = role_sql("areas") + buffer_sql(_sides_sql(), 8, polygon=True) + ", own AS (SELECT f, sum(ax*ey-ex*ay) AS twice FROM sd GROUP BY f)"


@query(BUILDING + " SELECT k.f AS obstacle, CAST(floor(sum(ax*ey-ex*ay) / 2 * 0.1 + 0.5) AS BIGINT) AS buffer_tens, CAST(floor((sum(ax*ey-ex*ay) - any_value(twice)) / 2 * 0.1 + 0.5) AS BIGINT) AS ring_tens, CAST(floor(sum(n) * 10 + 0.5) AS BIGINT) AS length_dm FROM kept k JOIN own USING (f) GROUP BY k.f")
def building_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strip around buildings with a notch and a court, which closes where the distance is large: area with and without the
    building, of the closed rings that the strip's edges link into, and length of the outer boundary."""
    place = lambda c: F.struct((F.col("mx") + F.col("half") * c[0]).alias("x"), (F.col("my") + F.col("half") * c[1]).alias("y"))
    shapes = role(spark, sf_dir, "areas").select(F.col("obstacle").alias("feature_index"), F.array(F.array(F.array(*map(place, SHELL)), F.array(*map(place, COURT)))).alias("parts"))
    sides = buffers.oriented(sides_of(rings_of(shapes)))
    named = sides.select("feature_index", F.struct("part", "ring", "id").alias("piece"), (50 + 150 * (F.col("feature_index") % 4)).cast("double").alias("distance"), "ax", "ay", "bx", "by")
    outer = buffers.cut(buffers.boundary(named, CELL, 8, sides))
    linked = buffers.rings(buffers.difference(outer, sides))
    strip = buffers.measures(vertices_to_rings(linked)).select("feature_index", half_up(F.col("area") * 0.1, 0).alias("ring_tens"))
    whole = buffers.measures(outer).select("feature_index", half_up(F.col("area") * 0.1, 0).alias("buffer_tens"), half_up(F.col("length"), 1).alias("length_dm"))
    return whole.join(strip, "feature_index").withColumnRenamed("feature_index", "obstacle")


def vertices_to_rings(linked: DataFrame) -> DataFrame:
    """The edges of closed rings (feature_index, ring, seq, x, y)."""
    w = Window.partitionBy("feature_index", "ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    out = linked.select("feature_index", F.col("x").alias("ax"), F.col("y").alias("ay"), after("x").alias("bx"), after("y").alias("by"))
    return out.withColumn("length", F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2))
