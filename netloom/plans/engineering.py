"""Registered queries of geometry, quality, depth, catalogs, search, validation, export and jobs, with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, geometry
from ..functions.dims import constraints_sql, pipes_sql
from ..operators import catalog, depth, economics, pieces, reconstruct, routing, sizing, solve, statistics, topology, validate
from ..operators.lineage import cut
from ..sources import features as sources
from ..streaming import jobs
from .network import doubles, longs
from .project import role, role_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
P, C = pipes_sql(), constraints_sql()


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


SEG = """, seg AS (SELECT * FROM (SELECT route, seq, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lag(x) OVER w AS px, lag(y) OVER w AS py FROM vertices WINDOW w AS (PARTITION BY route ORDER BY seq)) WHERE nx IS NOT NULL),
ang AS (SELECT *, sqrt(CAST((nx-x)*(nx-x)+(ny-y)*(ny-y) AS DOUBLE)) AS length, sqrt(CAST((x-px)*(x-px)+(y-py)*(y-py) AS DOUBLE)) AS before, degrees(atan2(CAST(abs((x-px)*(ny-y)-(y-py)*(nx-x)) AS DOUBLE), CAST((x-px)*(nx-x)+(y-py)*(ny-y) AS DOUBLE))) AS turn FROM seg)"""


@query(role_sql("vertices") + SEG + " SELECT route, seq, CAST(floor(length * 1000 + 0.5) AS BIGINT) AS length_mm, CAST(floor(coalesce(turn, -1) * 100 + 0.5) AS BIGINT) AS turn_centi FROM ang")
def polyline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and turns along routes."""
    s = geometry.vertices_to_segments(role(spark, sf_dir, "vertices"), "route", "seq")
    return s.select("route", "seq", geometry.half_up(F.col("length")).alias("length_mm"), geometry.half_up(F.coalesce("turn", F.lit(-1.0)), 2).alias("turn_centi"))


@query(role_sql("vertices") + SEG + " SELECT route, seq, 'ROUTE_TURN' AS code FROM ang WHERE turn IS NOT NULL AND length > 0 AND before > 0 AND NOT (turn <= 0.5 OR (turn + least(0.1, degrees(asin(least(1.0, 0.001414 / least(length, before))))) >= 60 AND turn <= 90 + least(0.1, degrees(asin(least(1.0, 0.001414 / least(length, before)))))))")
def turn_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns outside the allowed band."""
    return validate.turn_issues(role(spark, sf_dir, "vertices"))


@query(
    role_sql("vertices").replace("vertices AS (", "wide AS (", 1)
    + ", vertices AS (SELECT route, seq, CAST(x AS DOUBLE) / 250 AS x, CAST(y AS DOUBLE) / 250 AS y FROM wide)"
    + SEG
    + """, st AS (SELECT *, sum(length) OVER (PARTITION BY route ORDER BY seq ROWS UNBOUNDED PRECEDING) - length AS station FROM ang),
g AS (SELECT route, seq, station - lag(station) OVER (PARTITION BY route ORDER BY seq) AS gap FROM st WHERE turn > 0.5 AND length > 0 AND before > 0) SELECT route, seq, 'BEND_SPACING' AS code FROM g WHERE gap < CASE WHEN route % 4 = 0 THEN 2 WHEN route % 4 = 1 THEN 3 WHEN route % 4 = 2 THEN 4 ELSE 6 END * 1 - 1e-7"""
)
def bend_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bends closer than the diameter allows, on routes of a few metres."""
    v = role(spark, sf_dir, "vertices").withColumns({c: F.col(c).cast("double") / 250 for c in ("x", "y")})
    k = F.col("route") % 4
    d = v.select("route").distinct().withColumn("diameter", F.when(k == 0, 50).when(k == 1, 200).when(k == 2, 400).otherwise(1000))
    return validate.bend_spacing_issues(v, d)


@query(
    role_sql("vertices")
    + SEG
    + """, b AS (SELECT route, greatest(0.0, 90 - (180 - turn), (180 - turn) - 120) AS dev FROM ang WHERE turn > 0.5 AND length > 0 AND before > 0)
SELECT r.route, count(b.route) AS bends, count(b.route) FILTER (WHERE dev > 0.5) AS invalid, CAST(coalesce(sum(floor(dev * 1000 + 0.5)), 0) AS BIGINT) AS deviation_milli FROM (SELECT DISTINCT route FROM seg) r LEFT JOIN b USING (route) GROUP BY r.route"""
)
def route_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bends and their deviation from the engineering band."""
    return validate.quality(role(spark, sf_dir, "vertices"))


RAYS = ", rays AS (SELECT route AS node, seq AS ray, x - 500 AS dx, y - 500 AS dy FROM vertices WHERE x <> 500 OR y <> 500)"


def _rays(spark, sf_dir):
    return role(spark, sf_dir, "vertices").where("x <> 500 OR y <> 500").select(F.col("route").alias("node"), F.col("seq").alias("ray"), (F.col("x") - 500).alias("dx"), (F.col("y") - 500).alias("dy"))


@query(role_sql("vertices") + RAYS + ", p AS (SELECT a.node, a.ray, b.ray AS other, degrees(atan2(CAST(abs(a.dx*b.dy-a.dy*b.dx) AS DOUBLE), CAST(a.dx*b.dx+a.dy*b.dy AS DOUBLE))) AS g FROM rays a JOIN rays b ON a.node = b.node AND a.ray < b.ray) SELECT node, ray, other, 'CHAMBER_RAYS' AS code FROM p WHERE NOT (abs(g - 90) <= 0.1 OR abs(g - 180) <= 0.1)")
def chamber_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays of chambers that are neither perpendicular nor opposite."""
    return validate.ray_issues(_rays(spark, sf_dir))


@query(role_sql("vertices") + RAYS + ", p AS (SELECT a.node, degrees(atan2(CAST(abs(a.dx*b.dy-a.dy*b.dx) AS DOUBLE), CAST(a.dx*b.dx+a.dy*b.dy AS DOUBLE))) AS g FROM rays a JOIN rays b ON a.node = b.node AND a.ray < b.ray) SELECT node, CAST(floor(min(g) * 100 + 0.5) AS BIGINT) AS least_centi FROM p GROUP BY node")
def junction_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: the least angle between rays of each junction."""
    return validate.junction_angles(_rays(spark, sf_dir)).select("node", geometry.half_up(F.col("least"), 2).alias("least_centi"))


@query(
    role_sql("vertices")
    + """, s AS (SELECT * FROM (SELECT route, seq AS id, x AS ax, y AS ay, lead(x) OVER w AS ex, lead(y) OVER w AS ey FROM vertices WINDOW w AS (PARTITION BY route ORDER BY seq)) WHERE ex IS NOT NULL AND (ax <> ex OR ay <> ey)),
o AS (SELECT a.route, a.ax, a.ay, a.ex, a.ey, b.ax AS cx, b.ay AS cy, b.ex AS dx, b.ey AS dy, sign((a.ex-a.ax)*(b.ay-a.ay)-(a.ey-a.ay)*(b.ax-a.ax)) AS o1, sign((a.ex-a.ax)*(b.ey-a.ay)-(a.ey-a.ay)*(b.ex-a.ax)) AS o2,
 sign((b.ex-b.ax)*(a.ay-b.ay)-(b.ey-b.ay)*(a.ax-b.ax)) AS o3, sign((b.ex-b.ax)*(a.ey-b.ay)-(b.ey-b.ay)*(a.ex-b.ax)) AS o4 FROM s a JOIN s b ON a.route = b.route AND b.id > a.id + 1)
SELECT DISTINCT route FROM o WHERE (o1 <> o2 AND o3 <> o4) OR (o1 = 0 AND cx BETWEEN least(ax,ex) AND greatest(ax,ex) AND cy BETWEEN least(ay,ey) AND greatest(ay,ey)) OR (o2 = 0 AND dx BETWEEN least(ax,ex) AND greatest(ax,ex) AND dy BETWEEN least(ay,ey) AND greatest(ay,ey))
 OR (o3 = 0 AND ax BETWEEN least(cx,dx) AND greatest(cx,dx) AND ay BETWEEN least(cy,dy) AND greatest(cy,dy)) OR (o4 = 0 AND ex BETWEEN least(cx,dx) AND greatest(cx,dx) AND ey BETWEEN least(cy,dy) AND greatest(cy,dy))"""
)
def self_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """routes that cross themselves."""
    return validate.self_intersections(role(spark, sf_dir, "vertices"), 500)


@query(
    role_sql("variant_edges")
    + """, e AS (SELECT variant, up_node AS node FROM variant_edges UNION ALL SELECT variant, down_node FROM variant_edges), d AS (SELECT variant, node, count(*) AS n FROM e GROUP BY variant, node)
SELECT variant, CAST(node AS BIGINT) AS node, 'CHAMBER_DEGREE' AS code FROM d WHERE n + node % 3 > 4 UNION ALL SELECT variant, CAST(node AS BIGINT), 'BRANCH_WITHOUT_CHAMBER' FROM d WHERE n >= 3 AND node >= 5"""
)
def degree_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chambers with too many edges, branches without a chamber."""
    nodes = spark.range(10).select(F.col("id").cast("int").alias("node"), (F.col("id") % 3).alias("incident"))
    return longs(validate.degree_issues(role(spark, sf_dir, "variant_edges"), nodes, nodes.where("node < 5").select("node")), "node")


CROSS = ", c AS (SELECT route * 10 + seq AS id, x - 500 AS ux, y - 500 AS uy, y - 300 AS vx, x - 700 AS vy, CASE WHEN seq % 2 = 0 THEN 90.0 ELSE 60.0 END AS lim FROM vertices WHERE (x <> 500 OR y <> 500) AND (y <> 300 OR x <> 700))"


@query(role_sql("vertices") + CROSS + ", g AS (SELECT id, lim, degrees(atan2(CAST(abs(ux*vy-uy*vx) AS DOUBLE), CAST(ux*vx+uy*vy AS DOUBLE))) AS a FROM c), h AS (SELECT id, lim, least(a, 180 - a) AS a FROM g) SELECT id, CAST(floor(a * 1000 + 0.5) AS BIGINT) AS angle_milli FROM h WHERE NOT (a + CASE WHEN lim >= 89.9 THEN 0.1 ELSE 1e-7 END >= lim)")
def crossing_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crossings below their least angle."""
    v = role(spark, sf_dir, "vertices").where("(x <> 500 OR y <> 500) AND (y <> 300 OR x <> 700)")
    x, y = F.col("x"), F.col("y")
    return validate.crossing_angle_issues(v.select((F.col("route") * 10 + F.col("seq")).alias("id"), (x - 500).alias("ux"), (y - 500).alias("uy"), (y - 300).alias("vx"), (x - 700).alias("vy"), F.when(F.col("seq") % 2 == 0, 90.0).otherwise(60.0).alias("least")))


@query(
    role_sql("spans")
    + """, c AS (SELECT route * 10 + span AS id, s % 4 <> 0 AS straight, CAST(s % 91 AS DOUBLE) AS angle, s % 6 AS b, e % 6 AS a, e % 5 AS p FROM spans WHERE type = 'road')
SELECT id, 'NOT_STRAIGHT' AS code FROM c WHERE NOT straight UNION ALL SELECT id, 'ANGLE' FROM c WHERE NOT angle + 0.1 >= 90 UNION ALL SELECT id, 'EXTENSION_BEFORE' FROM c WHERE b < 3 UNION ALL SELECT id, 'EXTENSION_AFTER' FROM c WHERE a < 3 UNION ALL SELECT id, 'PARALLEL_CLEARANCE' FROM c WHERE p < 1.5"""
)
def road_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five codes of road crossings."""
    c = role(spark, sf_dir, "spans").where("type = 'road'").join(F.broadcast(dims.constraints(spark)), "type")
    rows = c.select((F.col("route") * 10 + F.col("span")).alias("id"), (F.col("s") % 4 != 0).alias("straight"), (F.col("s") % 91).cast("double").alias("angle"), F.col("min_angle").cast("double").alias("least"), (F.col("s") % 6).alias("before"), (F.col("e") % 6).alias("after"), "extension", (F.col("e") % 5).alias("parallel"), F.col("horizontal").alias("clearance"))
    return validate.road_crossing_issues(rows)


@query(
    role_sql("spans", "variant_edges")
    + f""", x AS (SELECT diameter, row_number() OVER (ORDER BY diameter) AS n, max_flow FROM {P}), e AS (SELECT v.variant, v.edge, s.type, (SELECT min(diameter) FROM x WHERE max_flow >= v.flow * (1 + v.variant % 300)) AS diameter FROM variant_edges v JOIN spans s ON s.route = v.variant AND s.span = v.edge)
SELECT e.variant, e.edge, e.type, CAST(e.diameter AS BIGINT) AS diameter, (CASE WHEN e.type = 'gas_pipeline' THEN 2000 WHEN e.type = 'road' THEN 1500 ELSE 1000 END) + CAST([400,430,470,510,600,650,880,1050,1150,1370,1670,1850,2050,2250,2450,2650,3100,3450][n] / 2 AS BIGINT) + CASE e.type WHEN 'gas_pipeline' THEN 200 WHEN 'heat_network' THEN 200 ELSE 0 END AS clearance_mm FROM e JOIN x ON x.diameter = e.diameter"""
)
def axis_clearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how far the axis of every edge, at its pipe, must keep from what it passes, beside an existing DU 50 pair."""
    flow = (F.col("flow") * (1 + F.col("variant") % 300)).cast(dims.FLOW)
    e = role(spark, sf_dir, "variant_edges").withColumn("diameter", dims.diameter_for(flow)).join(role(spark, sf_dir, "spans").select(F.col("route").alias("variant"), F.col("span").alias("edge"), "type"), ["variant", "edge"])
    known = e.join(F.broadcast(dims.constraints(spark).select("type", "horizontal")), "type").join(F.broadcast(dims.pipes(spark).select("diameter", "pair_width")), "diameter")  # fixed catalogs
    c = geometry.axis_clearance(F.col("type"), F.col("horizontal"), dims.building_clearance(F.col("diameter")), F.col("pair_width").cast("double") / 2, F.lit(0.2))
    return longs(known.select("variant", "edge", "type", "diameter", geometry.half_up(c).alias("clearance_mm")), "diameter")


@query(
    role_sql("points", "chambers")
    + """, seg AS (SELECT a.chamber_id AS id, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM chambers a JOIN chambers b ON b.chamber_id = a.chamber_id + 1),
t AS (SELECT p.point_id, s.*, p.x, p.y, coalesce(greatest(0.0, least(1.0, CAST((p.x-ax)*(ex-ax)+(p.y-ay)*(ey-ay) AS DOUBLE) / nullif((ex-ax)*(ex-ax)+(ey-ay)*(ey-ay), 0))), 0.0) AS t FROM points p, seg s)
SELECT point_id, CAST(floor(min(sqrt((ax + t*(ex-ax) - x)*(ax + t*(ex-ax) - x) + (ay + t*(ey-ay) - y)*(ay + t*(ey-ay) - y))) * 100 + 0.5) AS BIGINT) AS cm FROM t GROUP BY point_id"""
)
def distance_to_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """distance of every point to the network, searched in grid cells."""
    c = role(spark, sf_dir, "chambers")
    seg = c.join(c.select((F.col("chamber_id") - 1).alias("chamber_id"), F.col("x").alias("bx"), F.col("y").alias("by")), "chamber_id").select(F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")
    return topology.distance_to_segments(role(spark, sf_dir, "points"), seg).select("point_id", geometry.half_up(F.col("distance"), 2).alias("cm"))


@query(
    role_sql("vertices")
    + """, w AS (SELECT route AS block, x AS ax, y AS ay, lead(x) OVER q AS ex, lead(y) OVER q AS ey FROM vertices WINDOW q AS (PARTITION BY route ORDER BY seq)), d AS (SELECT block, sqrt(CAST((ex-ax)*(ex-ax)+(ey-ay)*(ey-ay) AS DOUBLE)) AS l, atan2(CAST(ey-ay AS DOUBLE), CAST(ex-ax AS DOUBLE)) AS a FROM w WHERE ex IS NOT NULL),
s AS (SELECT block, sum(l*cos(4*a)) AS c, sum(l*sin(4*a)) AS s, sum(l) AS t FROM d GROUP BY block) SELECT block, CAST(floor(coalesce(sqrt(c*c+s*s)/nullif(t,0), 0) * 10000 + 0.5) AS BIGINT) AS concentration FROM s"""
)
def facade_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant direction of walls."""
    s = geometry.vertices_to_segments(role(spark, sf_dir, "vertices"), "route", "seq")
    w = s.select(F.col("route").alias("block"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("nx").alias("bx"), F.col("ny").alias("by"))
    return catalog.facade_axis(w).select("block", geometry.half_up(F.coalesce("concentration", F.lit(0.0)), 4).alias("concentration"))


@query(
    role_sql("variant_edges")
    + """, w AS (SELECT variant % 200 AS grp, CAST(length AS BIGINT) AS v, sum(CAST(flow AS BIGINT)) AS w FROM variant_edges GROUP BY 1, 2), r AS (SELECT *, sum(w) OVER (PARTITION BY grp ORDER BY v) AS run, sum(w) OVER (PARTITION BY grp) AS total FROM w)
SELECT grp, min(v) FILTER (WHERE run >= total * 0.5) AS p50, min(v) FILTER (WHERE run >= total * 0.95) AS p95 FROM r GROUP BY grp"""
)
def weighted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G15."""
    e = role(spark, sf_dir, "variant_edges").select((F.col("variant") % 200).alias("grp"), F.col("length").cast("long").alias("v"), F.col("flow").cast("long").alias("w0"))
    return statistics.weighted_quantile(e, "grp", "v", "w0", {"p50": 0.5, "p95": 0.95})


@query(role_sql("variant_edges") + " SELECT variant, CAST(sum(CAST(flow AS BIGINT)) AS BIGINT) AS total, CAST(sum(CASE WHEN length <= 100 THEN CAST(flow AS BIGINT) ELSE 0 END) AS BIGINT) AS near, CAST(sum(CASE WHEN length <= 250 THEN CAST(flow AS BIGINT) ELSE 0 END) AS BIGINT) AS far FROM variant_edges GROUP BY variant")
def share_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G17."""
    e = role(spark, sf_dir, "variant_edges").withColumn("w", F.col("flow").cast("long"))
    return longs(statistics.share_within(e, "variant", "length", "w", {"near": 100, "far": 250}), "near", "far")


@query(role_sql("jobs") + ", g AS (SELECT job_id % 50 AS worker, event_id % 1000 AS ms FROM jobs) SELECT worker, min(ms) AS least, CAST(floor(quantile_cont(ms, 0.5) * 100 + 0.5) AS BIGINT) AS p50, CAST(floor(quantile_cont(ms, 0.95) * 100 + 0.5) AS BIGINT) AS p95, max(ms) AS greatest FROM g GROUP BY worker")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G20."""
    found = statistics.latencies(role(spark, sf_dir, "jobs").select((F.col("job_id") % 50).alias("worker"), (F.col("event_id") % 1000).alias("ms")), "worker", "ms")
    return found.withColumns({c: geometry.half_up(F.col(c), 2) for c in ("p50", "p95")})


@query(
    role_sql("links")
    + """, e AS (SELECT node AS a, up AS b FROM links WHERE up >= 0 AND up <> node), sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk(node, c) AS (SELECT node, node FROM links UNION SELECT b.b, w.c FROM walk w JOIN sym b ON b.a = w.node WHERE b.b > w.c), k AS (SELECT node, min(c) AS c FROM walk GROUP BY node)
SELECT (SELECT count(*) FROM links) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT c) FROM k) AS components, (SELECT count(*) FROM e) - (SELECT count(*) FROM links) + (SELECT count(DISTINCT c) FROM k) AS cycles"""
)
def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent cycles of a graph."""
    links = role(spark, sf_dir, "links")
    return statistics.cycle_count(links.where("up >= 0 AND up <> node").select(F.col("node").alias("a"), F.col("up").alias("b")), links.select("node"))


# ---- depth --------------------------------------------------------------------------------------------------------
@query(role_sql("spans") + """, w AS (SELECT route, span, CASE type WHEN 'road' THEN 1.0 END AS floor, s, e FROM spans WHERE type IN ('road','tram_tracks')), m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY route, floor ORDER BY s, e, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM w), i AS (SELECT *, sum(n) OVER (PARTITION BY route, floor ORDER BY s, e, span ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT route, CAST(floor AS DOUBLE) AS floor, min(s) AS s, max(e) AS e FROM i GROUP BY route, floor, k""")
def depth_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least depths under roads and tram tracks."""
    return depth.depth_floors(role(spark, sf_dir, "spans"))


@query(role_sql("spans") + """, w AS (SELECT route, span, greatest(0.0, (s + e) / 2.0 - 2) AS s, least(900.0, (s + e) / 2.0 + 2) AS e FROM spans), m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY route ORDER BY s, e, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM w), i AS (SELECT *, sum(n) OVER (PARTITION BY route ORDER BY s, e, span ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT route, CAST(min(s) AS DOUBLE) AS s, CAST(max(e) AS DOUBLE) AS e FROM i GROUP BY route, k""")
def crossing_plateaus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level stretches at utility crossings."""
    s = role(spark, sf_dir, "spans").select("route", ((F.col("s") + F.col("e")) / 2).alias("station"), F.lit(900.0).alias("length"))
    return depth.crossing_plateaus(s)


@query(
    role_sql("vertices")
    + """, p AS (SELECT route, seq, 700 + x * 3 AS lo, 2000 + y * 4 + x * 3 AS hi FROM vertices), v AS (SELECT a.route, a.seq, any_value(a.hi) AS hi, max(b.lo - 1500 * abs(a.seq - b.seq)) AS least FROM p a JOIN p b ON a.route = b.route GROUP BY a.route, a.seq),
w AS (SELECT *, least(hi, greatest(least, 3000)) AS cap, bool_and(least <= hi) OVER (PARTITION BY route) AS fits FROM v), u AS (SELECT a.route, a.seq, any_value(a.least) AS least, any_value(a.fits) AS fits, min(b.cap + 1500 * abs(a.seq - b.seq)) AS deepest FROM w a JOIN w b ON a.route = b.route GROUP BY a.route, a.seq)
SELECT route, CAST(seq * 15000 AS BIGINT) AS station_mm, CAST(CASE WHEN fits THEN least ELSE -1 END AS BIGINT) AS least_mm, CAST(CASE WHEN fits THEN deepest ELSE -1 END AS BIGINT) AS depth_mm FROM u"""
)
def depth_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and preferred depth profiles under the slope limit. With one interval a point both have a closed form, which the SQL
    states."""
    v = role(spark, sf_dir, "vertices")
    lo, hi = (700 + F.col("x") * 3).cast("long"), (2000 + F.col("y") * 4 + F.col("x") * 3).cast("long")
    found = depth.close_profiles(v.select("route", (F.col("seq") * 15_000).cast("long").alias("station_mm"), F.array(F.struct(lo.alias("lo"), hi.alias("hi"))).alias("domain")))
    return found.fillna({"least_mm": -1, "depth_mm": -1})


#: Crossings, floors and pins of the forest's edges, the same in both engines: lengths in mm, stretches of 4 m in the middle.
NETWORK_LINES = "SELECT network, node, CAST(floor(node / 2) AS BIGINT) AS up, CAST(length * 1000 AS BIGINT) AS length, CAST(floor(CAST(length * 500 AS BIGINT)) AS BIGINT) AS mid, 900 + (node * 37 + network) % 5 * 500 AS top, CASE WHEN node % 2 = 0 THEN 500 ELSE 200 END AS clearance, CASE WHEN node % 3 = 0 THEN 315 WHEN node % 3 = 1 THEN 180 ELSE 125 END AS height FROM forest"
RELAXED = """{name}(k, network, v, d) AS (
  SELECT 0, network, v, d FROM {start}
  UNION ALL
  SELECT s.k + 1, s.network, s.v, coalesce((SELECT min(greatest(i.lo, w)) FROM (SELECT unnest(p.domain) AS i) WHERE i.hi >= w), 1000000000)
  FROM (SELECT s.k, s.network, s.v, greatest(s.d, coalesce(max(t.d - l.gap), s.d)) AS w, any_value(s.d) AS d FROM {name} s LEFT JOIN link l ON l.network = s.network AND l.a = s.v LEFT JOIN {name} t ON t.network = l.network AND t.v = l.b
        WHERE s.k < 40 GROUP BY s.k, s.network, s.v, s.d) s JOIN {points} p ON p.network = s.network AND p.v = s.v
)"""


@query(
    role_sql("forest")
    + f""", line AS ({NETWORK_LINES}),
floor_at AS (SELECT network, node, CAST(0 AS BIGINT) AS s, mid AS e, 1000 AS depth FROM line WHERE node % 3 = 1 UNION ALL SELECT network, node, mid - mid % 10, length, 1200 FROM line WHERE node % 6 = 1),
stretch AS (SELECT network, node, mid - 2000 AS s, mid + 2000 AS e, top - clearance - height AS above, top + 300 + clearance AS below,
  (SELECT max(depth) FROM floor_at f WHERE f.network = line.network AND f.node = line.node AND f.s <= line.mid + 2000 AND f.e >= line.mid - 2000) AS least FROM line WHERE length >= 8000),
corner AS (SELECT DISTINCT f.network, f.node, place, (SELECT max(depth) FROM floor_at g WHERE g.network = f.network AND g.node = f.node AND g.s <= place AND g.e >= place) AS least
  FROM (SELECT network, node, unnest([s, e]) AS place FROM floor_at) f LEFT JOIN stretch t ON t.network = f.network AND t.node = f.node AND place BETWEEN t.s AND t.e WHERE t.network IS NULL),
point AS (
  SELECT network, node AS edge, 'n' || up AS v, 0 AS o, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e, [{{'lo': 700, 'hi': 6000}}] AS domain FROM line
  UNION ALL SELECT network, node, 'n' || node, 2, length, length, [{{'lo': CASE WHEN node = 7 AND network % 3 = 0 THEN 2000 ELSE 700 END, 'hi': CASE WHEN node = 7 AND network % 3 = 0 THEN 2000 ELSE 6000 END}}] FROM line
  UNION ALL SELECT network, node, 'c' || node, 1, s, e, list_filter([{{'lo': greatest(700, coalesce(least, 0)), 'hi': least(6000, above)}}, {{'lo': greatest(700, below, coalesce(least, 0)), 'hi': 6000}}], lambda i: i.lo <= i.hi) FROM stretch
  UNION ALL SELECT network, node, 'f' || node || ' ' || place, 1, place, place, [{{'lo': least, 'hi': 6000}}] FROM corner),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY network, edge ORDER BY o, s) - 1 AS k FROM point),
pair AS (SELECT network, v AS b, lag(v) OVER w AS a, CAST(floor((s - lag(e) OVER w) / 10) AS BIGINT) AS gap FROM ordered WINDOW w AS (PARTITION BY network, edge ORDER BY k)),
link AS MATERIALIZED (SELECT network, a, b, gap FROM pair WHERE a IS NOT NULL UNION ALL SELECT network, b, a, gap FROM pair WHERE a IS NOT NULL),
own AS MATERIALIZED (SELECT network, v, any_value(domain) FILTER (WHERE len(domain) = 0 OR domain[1].lo > 700 OR domain[1].hi < 6000) AS narrow, any_value(domain) AS domain FROM ordered GROUP BY network, v),
own2 AS MATERIALIZED (SELECT network, v, coalesce(narrow, domain) AS domain FROM own),
start AS (SELECT network, v, coalesce(list_min(list_transform(domain, lambda i: i.lo)), 1000000000) AS d FROM own2),
{RELAXED.format(name="up", start="start", points="own2")},
least AS MATERIALIZED (SELECT network, v, d FROM up WHERE k = 40),
bad AS (SELECT DISTINCT network FROM least WHERE d >= 500000000),
turned AS MATERIALIZED (SELECT o.network, o.v, list_filter(list_transform(o.domain, lambda i: {{'lo': -least(i.hi, greatest(l.d, 3000)), 'hi': -greatest(i.lo, l.d)}}), lambda i: i.lo <= i.hi) AS domain FROM own2 o JOIN least l USING (network, v) WHERE o.network NOT IN (SELECT network FROM bad)),
start2 AS (SELECT network, v, list_min(list_transform(domain, lambda i: i.lo)) AS d FROM turned),
{RELAXED.format(name="down", start="start2", points="turned")}
SELECT o.network, o.edge, CAST(o.k AS BIGINT) AS k, o.s, o.e, CAST(CASE WHEN b.network IS NULL THEN l.d ELSE -1 END AS BIGINT) AS least_mm, CAST(CASE WHEN b.network IS NULL THEN -f.d ELSE -1 END AS BIGINT) AS depth_mm
FROM ordered o JOIN least l ON l.network = o.network AND l.v = o.v LEFT JOIN bad b ON b.network = o.network LEFT JOIN down f ON f.k = 40 AND f.network = o.network AND f.v = o.v"""
)
def network_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths of whole networks with shared nodes, utilities to pass above or below, floors and pinned nodes."""
    t = spark.sql(NETWORK_LINES.replace("FROM forest", "FROM {forest}"), forest=role(spark, sf_dir, "forest"))
    named = cut(t.select("network", F.col("node").alias("edge"), "up", F.col("node").alias("down"), "length", "mid", "top", "clearance", "height"))
    crossings = named.where("length >= 8000").select("network", "edge", (F.col("mid") - 2000).alias("s"), (F.col("mid") + 2000).alias("e"), "top", (F.col("top") + 300).alias("bottom"), "clearance", "height")
    half = named.where("edge % 3 = 1").select("network", "edge", F.lit(0).cast("long").alias("s"), F.col("mid").alias("e"), F.lit(1000).cast("long").alias("depth"))
    rest = named.where("edge % 6 = 1").select("network", "edge", (F.col("mid") - F.col("mid") % 10).alias("s"), F.col("length").alias("e"), F.lit(1200).cast("long").alias("depth"))
    pins = named.where("edge = 7 AND network % 3 = 0").select("network", F.col("edge").alias("node"), F.lit(2000).cast("long").alias("depth"))
    found = depth.profile_depths(named, crossings, half.unionByName(rest), pins, 700, 6000)
    return found.select("network", "edge", F.col("k").cast("long").alias("k"), "s", "e", "least_mm", "depth_mm").fillna({"least_mm": -1, "depth_mm": -1})


@query(
    role_sql("vertices")
    + """, p AS (SELECT route, seq AS point, CAST(seq * 1000 - x % 3 * 600 AS BIGINT) AS st, CAST(600 + x * 2 AS BIGINT) AS d FROM vertices), l AS (SELECT *, st - lag(st) OVER w AS ds, abs(d - lag(d) OVER w) AS dd FROM p WINDOW w AS (PARTITION BY route ORDER BY point))
SELECT route, point, 'STATION_ORDER' AS code FROM l WHERE ds <= 0 UNION ALL SELECT route, point, 'SLOPE_EXCEEDED' FROM l WHERE dd > ds * 0.10 UNION ALL SELECT route, point, 'DEPTH_RANGE' FROM l WHERE d < 700 OR d > 50000"""
)
def profile_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, slope and range of stored profiles."""
    v = role(spark, sf_dir, "vertices")
    return depth.profile_issues(v.select("route", F.col("seq").alias("point"), (F.col("seq") * 1000 - F.col("x") % 3 * 600).cast("long").alias("station_mm"), (600 + F.col("x") * 2).cast("long").alias("depth_mm")))


@query(role_sql("variant_edges") + ", e AS (SELECT variant * 10 + up_node AS node, CAST(flow AS BIGINT) % 5 AS d FROM variant_edges UNION ALL SELECT variant * 10 + down_node, CAST(flow AS BIGINT) % 5 FROM variant_edges) SELECT node, 'NODE_DEPTH_DISCONTINUITY' AS code FROM e GROUP BY node HAVING max(d) - min(d) > 1")
def node_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that meet at different depths."""
    e = role(spark, sf_dir, "variant_edges")
    return depth.node_depth_issues(e.select(F.explode(F.array((F.col("variant") * 10 + F.col("up_node")), (F.col("variant") * 10 + F.col("down_node")))).alias("node"), (F.col("flow").cast("long") % 5).alias("depth_mm")))


# ---- export pieces ------------------------------------------------------------------------------------------------
#: A route of each order: crossings and length from its lines, depth 2.0 to 5.5 m at both ends and in the middle.
PIECE_ROUTES = "SELECT route, CAST(max(e) + 1 AS BIGINT) * 1000 AS length, CAST(route % 400 AS DECIMAL(18,3)) AS flow FROM spans GROUP BY route"
PIECE_SQL = f""", r AS (SELECT *, (SELECT min(diameter) FROM {P} WHERE max_flow >= r.flow) AS diameter FROM ({PIECE_ROUTES}) r),
x AS (SELECT o.route, o.type, o.span AS id, o.s % 91 AS angle, greatest(0, o.s * 1000 - CASE WHEN type = 'road' THEN 3000 ELSE 2000 END) AS s, least(r.length, o.e * 1000 + CASE WHEN type = 'road' THEN 3000 ELSE 2000 END) AS e FROM spans o JOIN r USING (route)),
prof AS (SELECT route, CAST(0 AS BIGINT) AS st, 2000 + route % 8 * 500 AS d FROM r WHERE route % 10 > 0 UNION ALL SELECT route, length - length % 2000 - CAST((length - length % 2000) / 2 AS BIGINT), 2000 + route % 5 * 700 FROM r WHERE route % 10 > 0 UNION ALL SELECT route, length, 2000 + route % 7 * 550 FROM r WHERE route % 10 > 0),
leg0 AS (SELECT * FROM (SELECT route, st AS s, lead(st) OVER w AS e, d AS ds, lead(d) OVER w AS de FROM prof WINDOW w AS (PARTITION BY route ORDER BY st)) WHERE e > s),
leg1 AS (SELECT *, CASE WHEN (ds - 3000) * (de - 3000) < 0 THEN CAST(floor(s + (e - s) * ((3000 - ds) / CAST(de - ds AS DOUBLE)) + 0.5) AS BIGINT) END AS m FROM leg0),
leg AS (SELECT route, s, e, ds, de FROM leg1 WHERE m IS NULL OR m <= s OR m >= e UNION ALL SELECT route, s, m, ds, 3000 FROM leg1 WHERE m > s AND m < e UNION ALL SELECT route, m, e, 3000, de FROM leg1 WHERE m > s AND m < e),
cutting AS (SELECT route, s AS a FROM x UNION SELECT route, e FROM x UNION SELECT route, s FROM leg UNION SELECT route, e FROM leg UNION SELECT route, 0 FROM r UNION SELECT route, length FROM r),
piece AS (SELECT * FROM (SELECT route, a, lead(a) OVER w AS b, row_number() OVER w AS i FROM cutting WINDOW w AS (PARTITION BY route ORDER BY a)) WHERE b IS NOT NULL),
typed AS (SELECT p.route, p.i, string_agg(DISTINCT x.type, '+' ORDER BY x.type) AS types, min(x.angle) AS angle, count(DISTINCT x.id) AS ids FROM piece p JOIN x ON x.route = p.route AND x.s <= p.a AND x.e >= p.b GROUP BY p.route, p.i),
deep AS (SELECT p.route, p.i, CAST(floor(ds + (de - ds) * ((p.a - l.s) / CAST(l.e - l.s AS DOUBLE)) + 0.5) AS BIGINT) AS d0, CAST(floor(ds + (de - ds) * ((p.b - l.s) / CAST(l.e - l.s AS DOUBLE)) + 0.5) AS BIGINT) AS d1 FROM piece p JOIN leg l ON l.route = p.route AND l.s <= p.a AND l.e >= p.b),
priced_piece AS (SELECT p.route, p.i, p.a, p.b, coalesce(t.types, 'base') AS types, t.angle, coalesce(t.ids, 0) AS ids, r.diameter, r.length, coalesce(d.d0, 3000) AS d0, coalesce(d.d1, 3000) AS d1,
  round(CAST(c.rate AS DECIMAL(20,0)) * CAST(p.b - p.a AS DECIMAL(8,0)) * CAST(CASE WHEN t.types LIKE '%road%' THEN 1.60 WHEN t.types LIKE '%gas%' THEN 1.25 WHEN t.types IS NOT NULL THEN 1.05 ELSE 1 END AS DECIMAL(4,2)) * CAST(20000 + greatest(0, coalesce(d.d0 + d.d1, 6000) - 6000) AS DECIMAL(6,0)) * CAST(0.00000005 AS DECIMAL(9,8)), 2) AS cost
  FROM piece p JOIN r USING (route) JOIN {P} c ON c.diameter = r.diameter LEFT JOIN typed t ON t.route = p.route AND t.i = p.i LEFT JOIN deep d ON d.route = p.route AND d.i = p.i)"""


def _pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    spans = cut(role(spark, sf_dir, "spans"))
    routes = cut(spark.sql(PIECE_ROUTES.replace("FROM spans", "FROM {spans}"), spans=spans).withColumn("diameter", dims.diameter_for(F.col("flow"))))
    metres = lambda c: (F.col(c) * 1000).alias(c)
    crossings = spans.select("route", metres("s"), metres("e"), "type", F.col("span").alias("id"), (F.col("s") % 91).alias("angle"))
    r, even = F.col("route"), F.col("length") - F.col("length") % 2000
    points = F.array(*[F.struct(at.cast("long").alias("station"), d.cast("long").alias("depth")) for at, d in ((F.lit(0), 2000 + r % 8 * 500), (even - even / 2, 2000 + r % 5 * 700), (F.col("length"), 2000 + r % 7 * 550))])
    profile = routes.where("route % 10 > 0").select("route", F.explode(points).alias("p")).select("route", "p.*")
    return pieces.route_pieces(routes, crossings, profile, dims.pipes(spark)), routes


@query(role_sql("spans") + PIECE_SQL + " SELECT route, CAST(i AS BIGINT) AS i, a, b, types, CAST(coalesce(angle, -1) AS BIGINT) AS angle, ids, CAST(diameter AS BIGINT) AS diameter, d0, d1, CAST(cost AS DOUBLE) AS cost FROM priced_piece")
def route_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings with their extensions, depth and its cost steps laid over each route, every piece priced."""
    found, _ = _pieces(spark, sf_dir)
    ids = F.when(F.col("ids") == "", 0).otherwise(F.size(F.split("ids", r"\+"))).cast("long")
    return longs(doubles(found.select("route", "i", "a", "b", "types", F.coalesce("angle", F.lit(-1)).cast("long").alias("angle"), ids.alias("ids"), "diameter", F.col("depth_start").alias("d0"), F.col("depth_end").alias("d1"), "cost"), "cost"), "i", "diameter")


@query(
    role_sql("spans")
    + PIECE_SQL
    + """, f AS (SELECT route % 50 AS variant, 'heat_network' AS object_type, CASE WHEN a = 0 THEN concat(route % 50, ':n', route) ELSE concat(route % 50, ':', route, ':', a) END AS start_node, CASE WHEN b = length THEN concat(route % 50, ':n', route + 1) ELSE concat(route % 50, ':', route, ':', b) END AS end_node, b - a AS length_mm, cost FROM priced_piece
UNION ALL SELECT route % 50, 'technical_node', NULL, NULL, NULL, NULL FROM priced_piece WHERE b < length)
SELECT variant, object_type, count(*) AS n, count(DISTINCT start_node) AS starts, count(DISTINCT end_node) AS ends, CAST(coalesce(sum(length_mm), -1) AS BIGINT) AS length_mm, CAST(coalesce(sum(cost), -1) AS DOUBLE) AS cost FROM f GROUP BY variant, object_type"""
)
def piece_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces as pipes and technical nodes, added up by variant."""
    found, routes = _pieces(spark, sf_dir)
    found, r = cut(found), F.col("route")  # read for pipes and for nodes
    features = pieces.piece_features(found, routes.withColumns({"variant": r % 50, "up_node": r, "down_node": r + 1}))
    return doubles(features.groupBy("variant", "object_type").agg(F.count("*").alias("n"), F.count_distinct("start_node").alias("starts"), F.count_distinct("end_node").alias("ends"), F.sum("length_mm").alias("length_mm"), F.sum("cost").alias("cost")), "cost").fillna({"length_mm": -1, "cost": -1.0})


@query(
    role_sql("spans")
    + PIECE_SQL
    + """, s AS (SELECT route % 50 AS variant, CAST(sum(cost) AS DECIMAL(30,2)) AS pipes FROM priced_piece GROUP BY 1)
SELECT variant, CAST(pipes + 8000000 AS DOUBLE) AS pieces, CAST(pipes + 8000000 + CASE WHEN variant % 9 = 0 THEN 0.01 ELSE 0 END AS DOUBLE) AS declared FROM s WHERE variant % 9 = 0"""
)
def unreconciled_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants whose declared construction cost is a kopeck off the sum of their pieces."""
    found, routes = _pieces(spark, sf_dir)
    found = cut(found)  # read for the declared costs and for the features
    r, off = F.col("route"), F.when(F.col("variant") % 9 == 0, F.lit("0.01")).otherwise("0").cast("decimal(3,2)")
    named = routes.withColumns({"variant": r % 50, "up_node": r, "down_node": r + 1})
    whole = found.join(named.select("route", "variant"), "route").groupBy("variant").agg(F.sum("cost").alias("pipes"))
    money = lambda v: F.lit(v).cast("decimal(12,2)")
    declared = whole.select("variant", money(3_000_000).alias("chambers"), money(5_000_000).alias("tie_in_cost"), (F.col("pipes") + 8_000_000 + off).cast(dims.MONEY).alias("construction"))
    return doubles(pieces.unreconciled(pieces.piece_features(found, named), declared), "pieces", "declared")


# ---- reconstruction -----------------------------------------------------------------------------------------------
@query(
    role_sql("tree")
    + f""", loads AS (SELECT node AS load, node, CAST(3 AS DECIMAL(18,3)) AS flow, CAST(5 AS DECIMAL(14,3)) AS station FROM tree WHERE demand = 6),
up(load, node, flow, s, e) AS (SELECT load, node, flow, CAST(0 AS DECIMAL(14,3)), station FROM loads UNION ALL SELECT u.load, t.up, u.flow, CAST(0 AS DECIMAL(14,3)), p.length FROM up u JOIN tree t ON t.node = u.node JOIN tree p ON p.node = t.up),
cuts AS (SELECT DISTINCT node, a FROM (SELECT node, s AS a FROM up UNION ALL SELECT node, e FROM up)), p AS (SELECT * FROM (SELECT node, a, lead(a) OVER (PARTITION BY node ORDER BY a) AS b FROM cuts) WHERE b IS NOT NULL),
o AS (SELECT p.node, p.a, p.b, sum(u.flow) AS added FROM p JOIN up u ON u.node = p.node AND (p.a + p.b) / 2 BETWEEN u.s AND u.e GROUP BY p.node, p.a, p.b)
SELECT node, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(need AS BIGINT) AS needed FROM (SELECT o.*, (SELECT min(diameter) FROM {P} WHERE max_flow >= CAST(2 + o.added AS DECIMAL(18,3))) AS need FROM o) WHERE need > 80"""
)
def rebuilt_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing pipes that new loads make too small."""
    t = role(spark, sf_dir, "tree")
    loads = t.where("demand = 6").select(F.col("node").alias("load"), "node", F.lit(3).cast(dims.FLOW).alias("flow"), F.lit(5).cast(dims.LENGTH).alias("station"))
    existing = t.withColumns({"flow": F.lit(2).cast(dims.FLOW), "diameter": F.lit(80)})
    return longs(doubles(reconstruct.rebuilt_pieces(existing, loads).select("node", "a", "b", "needed"), "a", "b"), "needed")


# ---- catalog and search -------------------------------------------------------------------------------------------
@query(
    role_sql("spans")
    + """, seg AS (SELECT DISTINCT route AS path, s, e FROM spans WHERE s < e), cuts AS (SELECT DISTINCT path % 100 AS line, t FROM (SELECT path, s AS t FROM seg UNION ALL SELECT path, e FROM seg)),
x AS (SELECT p.path, p.s, p.e, c.t FROM seg p JOIN cuts c ON c.line = p.path % 100 AND c.t BETWEEN p.s AND p.e), q AS (SELECT path, t AS a, lead(t) OVER (PARTITION BY path, s, e ORDER BY t) AS b FROM x)
SELECT path % 100 AS line, a AS x1, b AS x2, count(DISTINCT path) AS paths FROM q WHERE b IS NOT NULL GROUP BY 1, 2, 3"""
)
def physical_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-5, J12: shared assets of overlapping collinear paths, with SHA-256 ids."""
    s = role(spark, sf_dir, "spans").where("s < e").select("route", "s", "e").distinct()
    line = (F.col("route") % 100).cast("long")
    seg = s.select(F.col("route").alias("path"), F.concat_ws("-", "s", "e").alias("seq"), F.lit("street").alias("context"), F.lit("open").alias("mode"), F.col("s").alias("ax"), line.alias("ay"), F.col("e").alias("bx"), line.alias("by"))
    a = catalog.physical_assets(seg).where(F.length("asset") == 64)
    return a.select(F.col("y1").alias("line"), "x1", "x2", F.size("paths").cast("long").alias("paths"))


@query(f"WITH a AS (SELECT CAST(p_partkey AS BIGINT) AS asset, CAST(p_size * 1000 AS BIGINT) AS len FROM part) SELECT a.asset, CAST(p.diameter AS BIGINT) AS diameter, CAST(p.max_flow * 1000 AS BIGINT) AS capacity, CAST(p.rate * a.len AS BIGINT) AS cost_milli FROM a, {P} p WHERE p.diameter <= (SELECT min(diameter) FROM {P} WHERE max_flow * 1000 >= 200000)")
def network_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-6: diameter choices of assets with surrogate costs."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("asset"), (F.col("p_size") * 1000).cast("long").alias("length_mm"))
    return longs(catalog.network_problem(parts, F.lit(200_000)), "diameter")


@query(role_sql("points", "chambers") + " SELECT point_id, chamber_id, root_rank FROM (SELECT p.point_id, c.chamber_id, row_number() OVER (PARTITION BY p.point_id ORDER BY (p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y), c.chamber_id) AS root_rank FROM points p, chambers c) WHERE root_rank <= 3")
def pair_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-1, C-2, J13: root and demand pairs, coverage first."""
    pairs = catalog.pair_order(role(spark, sf_dir, "points"), role(spark, sf_dir, "chambers"), 3)
    return longs(pairs.select("point_id", "chamber_id", "root_rank"), "root_rank")


@query(
    role_sql("vertices", "spans")
    + """, b AS (SELECT route, s AS x1, e AS x2, s AS y1, s + 30 AS y2 FROM spans), ax AS (SELECT route, CAST(x AS DOUBLE) AS v FROM vertices UNION SELECT route, CAST(x1 AS DOUBLE) FROM b UNION SELECT route, CAST(x2 AS DOUBLE) FROM b), ay AS (SELECT route, CAST(y AS DOUBLE) AS v FROM vertices UNION SELECT route, CAST(y1 AS DOUBLE) FROM b UNION SELECT route, CAST(y2 AS DOUBLE) FROM b),
tx AS (SELECT route, min(v) AS x FROM ax GROUP BY route, floor(v / 2.5)), ty AS (SELECT route, min(v) AS y FROM ay GROUP BY route, floor(v / 2.5)), g AS (SELECT route, x, y FROM tx JOIN ty USING (route))
SELECT g.route, count(*) AS n, CAST(sum(x + y) AS DOUBLE) AS total FROM g WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.route = g.route AND x > x1 AND x < x2 AND y > y1 AND y < y2) GROUP BY g.route"""
)
def corridor_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9, C-4: orthogonal grids through terminals and obstacles of every route."""
    v = role(spark, sf_dir, "vertices").select(F.col("route").alias("problem"), "x", "y")
    b = role(spark, sf_dir, "spans").select(F.col("route").alias("problem"), F.col("s").alias("x1"), F.col("e").alias("x2"), F.col("s").alias("y1"), (F.col("s") + 30).alias("y2"))
    return catalog.corridor_grid(v, b).groupBy(F.col("problem").alias("route")).agg(F.count("*").alias("n"), F.sum(F.col("x") + F.col("y")).alias("total"))


@query(
    role_sql("vertices", "spans")
    + """, b AS (SELECT route % 10 AS p, route % 1000 * 50 + s AS x1, route % 1000 * 50 + e AS x2, s AS y1, s + 30 AS y2 FROM spans), ax AS (SELECT route % 10 AS p, CAST(route % 1000 * 50 + x AS DOUBLE) AS v FROM vertices UNION SELECT p, CAST(x1 AS DOUBLE) FROM b UNION SELECT p, CAST(x2 AS DOUBLE) FROM b), ay AS (SELECT route % 10 AS p, CAST(y AS DOUBLE) AS v FROM vertices UNION SELECT p, CAST(y1 AS DOUBLE) FROM b UNION SELECT p, CAST(y2 AS DOUBLE) FROM b),
c AS (SELECT p, 'x' AS axis, count(DISTINCT floor(v / 2.5)) AS found FROM ax GROUP BY p UNION ALL SELECT p, 'y', count(DISTINCT floor(v / 2.5)) FROM ay GROUP BY p) SELECT p, axis, found, 'AXES_TRUNCATED' AS code FROM c WHERE found > 96"""
)
def truncated_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9, C-4: districts of many routes, whose grids can't have all of their axes."""
    shift = F.col("route") % 1000 * 50
    v = role(spark, sf_dir, "vertices").select((F.col("route") % 10).alias("p"), (shift + F.col("x")).alias("x"), "y")
    b = role(spark, sf_dir, "spans").select((F.col("route") % 10).alias("p"), (shift + F.col("s")).alias("x1"), (shift + F.col("e")).alias("x2"), F.col("s").alias("y1"), (F.col("s") + 30).alias("y2"))
    return catalog.truncated_grids(v, b, "p")


@query(
    """WITH o AS (SELECT l_orderkey AS problem, l_linenumber % 3 AS slot, l_partkey AS opt, min(CAST(l_quantity AS BIGINT)) AS cost FROM lineitem GROUP BY 1, 2, 3),
a AS (SELECT * FROM o WHERE slot = 0), b AS (SELECT * FROM o WHERE slot = 1), c AS (SELECT * FROM o WHERE slot = 2), s AS (SELECT problem, count(DISTINCT slot) AS n FROM o GROUP BY problem)
SELECT s.problem, min(coalesce(a.cost, 0) + coalesce(b.cost, 0) + coalesce(c.cost, 0)) AS cost FROM s LEFT JOIN a USING (problem) LEFT JOIN b USING (problem) LEFT JOIN c USING (problem)
WHERE NOT coalesce((a.opt + b.opt) % 3 = 0, false) AND NOT coalesce((a.opt + c.opt) % 3 = 0, false) AND NOT coalesce((b.opt + c.opt) % 3 = 0, false) GROUP BY s.problem"""
)
def discrete_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-14, C-15: one option per slot at least cost without conflicts."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    o = li.groupBy(F.col("l_orderkey").alias("problem"), (F.col("l_linenumber") % 3).alias("slot"), F.col("l_partkey").alias("option")).agg(F.min(F.col("l_quantity").cast("long")).alias("cost"))
    named = o.groupBy("problem").agg(F.collect_set(F.struct("slot", "option")).alias("all"))
    pairs = named.select("problem", "all", F.explode("all").alias("a")).select("problem", "a", F.explode("all").alias("b"))
    conflicts = pairs.where("a.slot < b.slot AND (a.option + b.option) % 3 = 0").select("problem", F.col("a.option").alias("option"), F.col("b.option").alias("other"))
    return solve.discrete_choice(o, conflicts).where("cost IS NOT NULL").select("problem", "cost")


@query()
def root_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demands matched to roots with limited places, one row per problem with the number of placed demands."""
    e = role(spark, sf_dir, "variant_edges").select(F.col("variant").alias("problem"), F.col("edge").alias("demand"), F.col("up_node").alias("root"))
    return solve.root_matching(e, 1).groupBy("problem").agg(F.count("*").alias("placed"))


ORACLES["root_matching"] = role_sql("variant_edges") + " SELECT variant AS problem, count(DISTINCT up_node) AS placed FROM variant_edges GROUP BY variant"


@query()
def obstacle_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest routes around one obstacle, a pair per consumer (checked by brute force in the tests)."""
    p = role(spark, sf_dir, "points")
    a, b = (F.col("x") % 100).cast("long"), (F.col("y") % 100).cast("long")
    pairs = p.select(F.col("point_id").alias("problem"), F.lit(1).alias("pair"), a.alias("ax"), b.alias("ay"), (a + 120).alias("bx"), (b + 40).alias("by"))
    boxes = p.select(F.col("point_id").alias("problem"), (a + 40).alias("x1"), (b - 20).alias("y1"), (a + 70).alias("x2"), (b + 30).alias("y2"))
    return routing.route_pairs(pairs, boxes, least_turn=0.0).withColumn("length", F.round("length", 3))


@query()
def corridor_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy attachment trees on the graph of each order."""
    e = role(spark, sf_dir, "variant_edges").where("up_node <> down_node")
    edges = e.select(F.col("variant").alias("problem"), F.col("up_node").cast("string").alias("a"), F.col("down_node").cast("string").alias("b"), F.col("length").cast("long").alias("w"))
    ends = e.select(F.col("variant").alias("problem"), F.explode(F.array(F.struct(F.col("up_node").cast("string").alias("node"), (F.col("edge") == 1).alias("is_root")), F.struct(F.col("down_node").cast("string").alias("node"), F.lit(False).alias("is_root")))).alias("t")).select("problem", "t.*")
    nodes = ends.groupBy("problem", "node").agg(F.bool_or("is_root").alias("is_root"))
    rooted = nodes.withColumn("is_root", F.col("is_root"))
    return routing.corridor_trees(edges, rooted)


@query(
    role_sql("variant_edges")
    + """, e AS (SELECT variant, edge, variant * 100 + edge AS down, variant * 100 + edge - 1 AS up, length, CASE WHEN flow > 25 THEN 2 ELSE 1 END AS flow FROM variant_edges),
g AS (SELECT *, sum(CASE WHEN pf = flow THEN 0 ELSE 1 END) OVER (PARTITION BY variant ORDER BY edge ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(flow) OVER (PARTITION BY variant ORDER BY edge) AS pf FROM e))
SELECT min(up) AS first, max(down) AS last, CAST(sum(length) AS DOUBLE) AS length, count(*) AS edges FROM g GROUP BY variant, k"""
)
def collapsed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6, C-13: chains of equal edges become one."""
    e = role(spark, sf_dir, "variant_edges")
    edges = e.select((F.col("variant") * 100 + F.col("edge") - 1).alias("up"), (F.col("variant") * 100 + F.col("edge")).alias("down"), "length", F.when(F.col("flow") > 25, 2).otherwise(1).alias("flow"), F.lit(50).alias("diameter"))
    return doubles(routing.collapse_chains(edges, spark.createDataFrame([], "node long")), "length")


@query(
    role_sql("vertices")
    + """, v AS (SELECT route, seq, x // 250 AS x, y // 250 AS y FROM vertices), q AS (SELECT route, seq, x AS ax, y AS ay, lead(x,1) OVER w AS ex, lead(y,1) OVER w AS ey, lead(x,2) OVER w AS cx, lead(y,2) OVER w AS cy, lead(x,3) OVER w AS dx, lead(y,3) OVER w AS dy FROM v WINDOW w AS (PARTITION BY route ORDER BY seq))
SELECT route, seq FROM q WHERE dx IS NOT NULL AND (ex-ax)*(cx-ex)+(ey-ay)*(cy-ey) = 0 AND (cx-ex)*(dx-cx)+(cy-ey)*(dy-cy) = 0 AND ((ex-ax)*(cy-ey)-(ey-ay)*(cx-ex)) * ((cx-ex)*(dy-cy)-(cy-ey)*(dx-cx)) < 0 AND (cx-ex)*(cx-ex)+(cy-ey)*(cy-ey) <= 4"""
)
def axis_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removable side steps of routes."""
    v = role(spark, sf_dir, "vertices").withColumns({"x": F.floor(F.col("x") / 250), "y": F.floor(F.col("y") / 250)})
    return routing.axis_shifts(v, 2)


# ---- export and contract ------------------------------------------------------------------------------------------
OUT = """, f AS (SELECT variant * 10 + edge AS row, variant AS variant_id, CASE WHEN edge % 4 = 0 THEN 'technical_node' WHEN edge % 4 = 1 THEN 'heat_network' WHEN edge % 4 = 2 THEN 'heat_chamber' ELSE 'variant_summary' END AS object_type,
 concat(CAST(variant AS VARCHAR), ':', CAST(edge % 6 AS VARCHAR)) AS id, concat(CAST(variant AS VARCHAR), ':', CAST(up_node AS VARCHAR)) AS a, concat(CAST(variant AS VARCHAR), ':', CAST(down_node AS VARCHAR)) AS b, length FROM variant_edges)"""


@query(
    role_sql("variant_edges")
    + OUT
    + """, n AS (SELECT DISTINCT id FROM f WHERE object_type IN ('heat_chamber','technical_node'))
SELECT row, 'MISSING_FIELD' AS code FROM f WHERE object_type <> 'technical_node' UNION ALL SELECT row, 'FOREIGN_FIELD' FROM f WHERE length > 350
UNION ALL SELECT row, 'REPEATED_ID' FROM (SELECT row, row_number() OVER (PARTITION BY id ORDER BY row) AS k FROM f) WHERE k > 1
UNION ALL SELECT row, 'UNRESOLVED_NODE' FROM f WHERE object_type = 'heat_network' AND (a NOT IN (SELECT id FROM n) OR b NOT IN (SELECT id FROM n))
UNION ALL SELECT min(row), 'SUMMARY_COUNT' FROM f GROUP BY variant_id HAVING count(*) FILTER (WHERE object_type = 'variant_summary') <> 1"""
)
def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, ids, node references and summaries of an export."""
    e = role(spark, sf_dir, "variant_edges")
    k = F.col("edge") % 4
    name = lambda c: F.concat_ws(":", "variant", c)
    base = F.array(*map(F.lit, ("id", "object_type", "variant_id")))
    f = e.select((F.col("variant") * 10 + F.col("edge")).alias("row"), F.col("variant").alias("variant_id"), F.when(k == 0, "technical_node").when(k == 1, "heat_network").when(k == 2, "heat_chamber").otherwise("variant_summary").alias("object_type"), name(F.col("edge") % 6).alias("id"), name("up_node").alias("start_node_id"), name("down_node").alias("end_node_id"), F.when(F.col("length") > 350, F.concat(base, F.array(F.lit("colour")))).otherwise(base).alias("fields"))
    return validate.contract_issues(f)


@query(role_sql("variant_edges") + ", s AS (SELECT variant, sum(length) AS total, sum(CASE WHEN edge <> 2 THEN length ELSE 0 END) AS stored FROM variant_edges GROUP BY variant) SELECT variant AS variant_id FROM s WHERE total <> stored")
def reconcile_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports whose parts do not add up."""
    e = role(spark, sf_dir, "variant_edges")
    stored = e.groupBy(F.col("variant").alias("variant_id")).agg(F.sum(F.when(F.col("edge") != 2, F.col("length")).otherwise(0)).alias("construction_cost"))
    return validate.reconcile(e.select(F.col("variant").alias("variant_id"), F.col("length").alias("cost")), stored)


@query(role_sql("points") + " SELECT concat('{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[', CAST(x AS VARCHAR), ',', CAST(y AS VARCHAR), ']},\"properties\":{\"id\":\"p', CAST(point_id AS VARCHAR), '\",\"object_type\":\"technical_node\"}}') AS value FROM points")
def geojson_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as GeoJSON text."""
    p = role(spark, sf_dir, "points")
    return sources.to_geojson(p.select(F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"), F.struct(F.concat(F.lit("p"), "point_id").alias("id"), F.lit("technical_node").alias("object_type")).alias("properties")))


# ---- jobs ---------------------------------------------------------------------------------------------------------
@query(
    role_sql("jobs")
    + """, f AS (SELECT job_id, arg_min(kind, ts) AS outcome, count(*) AS finals FROM (SELECT * FROM jobs WHERE kind IN ('completed','failed') ORDER BY ts, event_id) GROUP BY job_id), j AS (SELECT job_id, count(*) FILTER (WHERE kind = 'heartbeat') AS alive, count(*) FILTER (WHERE kind = 'queued') AS queued FROM jobs GROUP BY job_id)
SELECT j.job_id, coalesce(f.outcome, CASE WHEN alive > 0 THEN 'running' WHEN queued > 0 THEN 'queued' ELSE 'unknown' END) AS state, greatest(coalesce(finals, 0) - 1, 0) AS refused FROM j LEFT JOIN f USING (job_id)"""
)
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded states of jobs."""
    return jobs.state(role(spark, sf_dir, "jobs")).select("job_id", "state", "refused")


@query(role_sql("jobs") + ", g AS (SELECT job_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS gap FROM jobs) SELECT job_id, count(*) FILTER (WHERE gap > 300000000) AS expired, CAST(coalesce(max(gap // 1000000), 0) AS BIGINT) AS longest_s FROM g GROUP BY job_id")
def lease_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: expired leases."""
    return jobs.lease_gaps(role(spark, sf_dir, "jobs"))


@query(
    role_sql("jobs")
    + """, q AS (SELECT job_id, min(ts) AS created, max(ts) AS seen, CASE job_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'completed' END AS state FROM jobs GROUP BY job_id), n AS (SELECT max(ts) AS now FROM jobs)
SELECT job_id, slot FROM (SELECT job_id, row_number() OVER (ORDER BY created, job_id) AS slot FROM q, n WHERE state = 'queued' OR (state = 'running' AND seen + INTERVAL 5 MINUTE < now)) WHERE slot <= 16"""
)
def claimable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: the sixteen jobs that workers would claim next."""
    e = role(spark, sf_dir, "jobs")
    k = F.col("job_id") % 3
    q = e.groupBy("job_id").agg(F.min("ts").alias("created"), (F.max("ts") + F.expr(jobs.LEASE)).alias("lease_until")).withColumns({"state": F.when(k == 0, "queued").when(k == 1, "running").otherwise("completed"), "attempt": F.lit(0)})
    now = e.agg(F.max("ts")).first()[0]
    return longs(jobs.claimable(q, F.lit(now), 16).select("job_id", "slot"), "slot")


@query("WITH r AS (SELECT o_custkey AS import_id, o_orderkey AS run_id, o_orderdate AS done, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END AS state FROM orders) SELECT import_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY import_id ORDER BY done DESC, run_id DESC) AS k FROM r WHERE state = 'completed') WHERE k = 1")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest completed run of each import."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    r = o.select(F.col("o_custkey").alias("import_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("completed_at"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("state"))
    return jobs.latest_completed(r, "import_id")
