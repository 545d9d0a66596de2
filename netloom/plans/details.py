"""Registered queries of typed input, linear referencing, projection, catalogs, evaluation and export, with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, geometry
from ..operators import catalog, evaluate, lines, obstacles, polygons, statistics, topology, validate
from ..operators import inspect as inspection
from .network import ECON, PRICED, doubles, longs
from .network import ORACLES as NETWORK
from .obstacles import BASE, CELL, _areas, meets
from .project import role, role_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


# ---- typed input --------------------------------------------------------------------------------------------------
PROPERTIES = """SELECT CAST(c_custkey AS BIGINT) AS feature_index, CASE WHEN c_custkey % 31 = 0 THEN '{{"id":' ELSE concat('{{"id":', CASE c_custkey % 5 WHEN 0 THEN '"f7"' WHEN 1 THEN '12' WHEN 2 THEN '1.5' WHEN 3 THEN 'null' ELSE '" "' END,
 ',"flow_tph":', CASE c_custkey % 7 WHEN 0 THEN '"x"' WHEN 1 THEN '-1' WHEN 2 THEN '2.5' WHEN 3 THEN '0' ELSE '8' END, ',"diameter":', CASE c_custkey % 4 WHEN 0 THEN '50' WHEN 1 THEN '50.5' WHEN 2 THEN '"50"' ELSE '77' END, '}}') END AS properties FROM {customer}"""


@query(
    "WITH p AS ("
    + PROPERTIES.format(customer="customer")
    + """), k AS (SELECT feature_index, properties, json_valid(properties) AS ok FROM p), t AS (SELECT feature_index, json_type(properties, '$.id') AS ti, json_extract_string(properties, '$.id') AS i, json_type(properties, '$.flow_tph') AS tf, TRY_CAST(json_extract_string(properties, '$.flow_tph') AS DOUBLE) AS f, json_type(properties, '$.diameter') AS td, TRY_CAST(json_extract_string(properties, '$.diameter') AS INT) AS d FROM k WHERE ok)
SELECT feature_index, 'INVALID_PROPERTIES' AS code FROM k WHERE NOT ok UNION ALL SELECT feature_index, 'MISSING_FIELD' FROM t WHERE ti = 'NULL' OR trim(i) = '' UNION ALL SELECT feature_index, 'INVALID_ID' FROM t WHERE ti = 'DOUBLE'
UNION ALL SELECT feature_index, 'INVALID_NUMBER' FROM t WHERE tf = 'VARCHAR' OR f <= 0 UNION ALL SELECT feature_index, 'INVALID_DIAMETER' FROM t WHERE td IN ('VARCHAR', 'DOUBLE') OR d = 77"""
)
def property_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties judged by their JSON type."""
    role(spark, sf_dir, "points")
    return inspection.property_issues(spark.sql(PROPERTIES, customer=spark.read.parquet(f"{sf_dir}/customer.parquet")))


@query(
    role_sql("areas")
    + """, k AS (SELECT *, obstacle % 7 AS c FROM areas) SELECT obstacle AS feature_index, 'EMPTY_GEOMETRY' AS code FROM k WHERE c = 1 UNION ALL SELECT obstacle, 'OPEN_RING' FROM k WHERE c = 2 UNION ALL SELECT obstacle, 'INVALID_COORDINATE' FROM k WHERE c = 3 UNION ALL SELECT obstacle, 'SELF_INTERSECTION' FROM k WHERE c = 4"""
)
def geometry_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that are too short, open, out of range or that cross themselves; the cases are made by id."""
    a = role(spark, sf_dir, "areas").select("obstacle", (F.col("mx") / 1000).alias("x"), (F.col("my") / 2000).alias("y"), (F.col("obstacle") % 7).alias("c"))
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("lon"), (F.col("y") + dy).alias("lat"))
    a0, b0, c0, d0 = at(0, 0), at(1, 0), at(1, 1), at(0, 1)
    ring = F.when(F.col("c") == 1, F.array(a0, b0, a0)).when(F.col("c") == 2, F.array(a0, b0, c0, d0)).when(F.col("c") == 3, F.array(a0, at(200, 0), c0, a0)).when(F.col("c") == 4, F.array(a0, c0, b0, d0, a0)).otherwise(F.array(a0, b0, c0, d0, a0))
    return inspection.geometry_issues(a.select(F.col("obstacle").alias("feature_index"), ring.alias("ring")), 1.0)


@query(
    role_sql("areas")
    + """, k AS (SELECT obstacle AS feature_index, obstacle % 12 AS c FROM areas)
SELECT feature_index, CASE c WHEN 1 THEN 'HOLE_OUTSIDE_SHELL' WHEN 2 THEN 'SELF_INTERSECTION' WHEN 3 THEN 'NESTED_HOLES' WHEN 4 THEN 'DISCONNECTED_INTERIOR' WHEN 5 THEN 'NESTED_SHELLS' WHEN 6 THEN 'SELF_INTERSECTION' WHEN 7 THEN 'EMPTY_GEOMETRY' WHEN 8 THEN 'OPEN_RING' END AS code
FROM k WHERE c BETWEEN 1 AND 8"""
)
def polygon_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-polygons with holes around every area. Sound ones stand at 0 and 9 to 11: a hole, a hole that touches its shell once,
    a part in another's hole, two parts that touch at a corner."""
    a = role(spark, sf_dir, "areas").select(F.col("obstacle").alias("feature_index"), "mx", "my", (F.col("obstacle") % 12).alias("c"))
    ring = lambda *at: F.array(*[F.struct((F.col("mx") + x).alias("x"), (F.col("my") + y).alias("y")) for x, y in at])
    box = lambda x, y, w: ring((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))
    shell = box(0, 0, 20)
    cases = [
        F.array(F.array(shell, box(5, 5, 3))), F.array(F.array(shell, box(30, 5, 3))), F.array(F.array(shell, box(15, 5, 10))), F.array(F.array(shell, box(5, 5, 10), box(7, 7, 2))),
        F.array(F.array(shell, ring((0, 10), (10, 0), (10, 10), (0, 10)))), F.array(F.array(shell), F.array(box(5, 5, 5))), F.array(F.array(ring((0, 0), (10, 10), (10, 0), (0, 10), (0, 0)))), F.array(F.array(ring((0, 0), (9, 0), (0, 0)))),
        F.array(F.array(ring((0, 0), (9, 0), (9, 9), (0, 9)))), F.array(F.array(shell, ring((0, 10), (5, 8), (5, 12), (0, 10)))), F.array(F.array(shell, box(2, 2, 15)), F.array(box(5, 5, 5))), F.array(F.array(shell), F.array(box(20, 20, 5))),
    ]
    parts = F.when(F.col("c") == 0, cases[0])
    for c, case in enumerate(cases[1:], 1):
        parts = parts.when(F.col("c") == c, case)
    return polygons.polygon_issues(a.select("feature_index", parts.alias("parts")), 8.0, (1e6, 1e6))


@query("SELECT * FROM (" + NETWORK["inspect_issues"] + ") WHERE code NOT IN ('MISSING_EXISTING_NETWORK_VALUE', 'MISSING_EXISTING_NETWORK_LINK', 'MISSING_CHAMBER_DIAMETER') ORDER BY feature_index, code, feature_id LIMIT 100")
def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first errors of a report in a total order, here 100; warnings don't count."""
    return inspection.first_errors(inspection.issues(role(spark, sf_dir, "features")), 100).select("code", "feature_index", "feature_id")


RUNS = "SELECT CAST(o_orderkey AS BIGINT) AS run_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS state, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE CAST(o_custkey % 40 AS DOUBLE) / 10 END AS least_depth, CAST(o_custkey % 60 AS DOUBLE) AS greatest_depth FROM {orders}"


@query("WITH r AS (" + RUNS.replace("{orders}", "orders") + ") SELECT run_id, 'PARAMETER_PAIR' AS code FROM r WHERE least_depth IS NULL UNION ALL SELECT run_id, 'LEAST_DEPTH' FROM r WHERE least_depth < 0.7 OR least_depth > 3.0 UNION ALL SELECT run_id, 'GREATEST_DEPTH' FROM r WHERE greatest_depth < 3 OR greatest_depth > 50")
def parameter_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that no run may have."""
    return inspection.parameter_issues(spark.sql(RUNS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet")))


@query(
    "WITH r AS ("
    + RUNS.replace("{orders}", "orders")
    + "), j AS (SELECT run_id, CASE WHEN state <> 'completed' THEN 'RUN_NOT_COMPLETED' WHEN least_depth IS NULL OR least_depth < 0.7 OR least_depth > 3.0 OR greatest_depth < 3 OR greatest_depth > 50 THEN 'INVALID_PARAMETERS' END AS problem FROM r) SELECT run_id, concat('v', CAST(k AS VARCHAR)) AS variant_id, CAST(k AS BIGINT) AS rank, problem FROM j, range(1, 4) t(k) WHERE problem IS NULL UNION ALL SELECT run_id, NULL, -1, problem FROM j WHERE problem IS NOT NULL"
)
def export_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of completed runs with valid parameters, or what keeps a run from being published."""
    runs = spark.sql(RUNS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    variants = runs.select("run_id", F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<long>")).alias("rank")).withColumn("variant_id", F.concat(F.lit("v"), F.col("rank")))
    return evaluate.payload(runs, variants).fillna({"rank": -1})


@query("WITH e AS (SELECT CAST(user_id % 500 AS BIGINT) AS subject, event_type AS code, CAST(event_id AS BIGINT) AS event_id FROM events) SELECT code, subject, min(event_id) AS event_id FROM e GROUP BY code, subject")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues without repetitions, the first of each kept."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 500).cast("long").alias("subject"), F.col("event_type").alias("code"), F.col("event_id").cast("long").alias("event_id"))
    return inspection.first_of_each(e, ["code", "subject"], "event_id").select("code", "subject", "event_id")


@query("SELECT DISTINCT CAST(o_custkey AS BIGINT) AS grp, CAST(o_orderkey % 7 AS BIGINT) AS member FROM orders WHERE o_orderkey % 2 = 0 AND (o_custkey, o_orderkey % 7) NOT IN (SELECT o_custkey, o_orderkey % 7 FROM orders WHERE o_orderkey % 2 = 1)")
def lost_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an extended set no longer has."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("long").alias("grp"), (F.col("o_orderkey") % 7).cast("long").alias("member"), (F.col("o_orderkey") % 2).alias("side"))
    return inspection.lost_members(o.where("side = 0"), o.where("side = 1"), "grp", "member")


# ---- lines and projection -----------------------------------------------------------------------------------------
@query(role_sql("points") + " SELECT point_id, CAST(x * 10 AS BIGINT) AS lon_micro, CAST(y * 8 AS BIGINT) AS lat_micro FROM points")
def projection_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the zone projected and taken back to the micro-degree."""
    p = role(spark, sf_dir, "points")
    east, north = geometry.utm_forward(38.5 + F.col("x") * 10 / 1e6, 55.0 + F.col("y") * 8 / 1e6)
    metric = p.select("point_id", east.alias("east"), north.alias("north"))
    lon, lat = geometry.utm_inverse(F.col("east"), F.col("north"))
    return metric.select("point_id", geometry.half_up((lon - 38.5) * 1e6, 0).alias("lon_micro"), geometry.half_up((lat - 55.0) * 1e6, 0).alias("lat_micro"))


SPAN = ", span AS (SELECT route, CAST(500 + route % 900 AS DOUBLE) AS s, CAST(3000 + route % 4000 AS DOUBLE) AS e FROM bends WHERE seq = 1)"


@query(
    BASE
    + SPAN
    + """, p AS (SELECT route, seq, ax, ay, ex, ey, greatest((s - start) / length, 0.0) AS lo, least((e - start) / length, 1.0) AS hi FROM seg JOIN span USING (route) WHERE s < start + length AND e > start)
SELECT route, seq, CAST(floor((ax + lo * (ex - ax)) * 100 + 0.5) AS BIGINT) AS x1, CAST(floor((ay + lo * (ey - ay)) * 100 + 0.5) AS BIGINT) AS y1, CAST(floor((ax + hi * (ex - ax)) * 100 + 0.5) AS BIGINT) AS x2, CAST(floor((ay + hi * (ey - ay)) * 100 + 0.5) AS BIGINT) AS y2 FROM p"""
)
def sub_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """routes between two stations."""
    v = role(spark, sf_dir, "bends")
    span = v.where("seq = 1").select("route", (F.col("route") % 900 + 500).cast("double").alias("s"), (F.col("route") % 4000 + 3000).cast("double").alias("e"))
    return lines.sub_lines(v, span).select("route", "seq", *[geometry.half_up(F.col(c), 2).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    BASE
    + """, one AS (SELECT route AS id, ax, ay, ex, ey, length, CASE WHEN route % 3 = 0 THEN NULL WHEN route % 3 = 1 THEN 0.25 ELSE 1.0 END AS t FROM seg WHERE seq = 1), m AS (SELECT *, coalesce(t > 0 AND t < 1, false) AS inside, ax + t * (ex - ax) AS mx, ay + t * (ey - ay) AS my FROM one),
p AS (SELECT id, 1 AS part, ax AS x1, ay AS y1, CASE WHEN inside THEN mx ELSE ex END AS x2, CASE WHEN inside THEN my ELSE ey END AS y2 FROM m UNION ALL SELECT id, 2, mx, my, ex, ey FROM m WHERE inside)
SELECT id, CAST(part AS BIGINT) AS part, CAST(floor(x1 * 100 + 0.5) AS BIGINT) AS x1, CAST(floor(y1 * 100 + 0.5) AS BIGINT) AS y1, CAST(floor(x2 * 100 + 0.5) AS BIGINT) AS x2, CAST(floor(y2 * 100 + 0.5) AS BIGINT) AS y2 FROM p"""
)
def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segments split at a place beside them."""
    s = obstacles.route_segments(role(spark, sf_dir, "bends")).where("seq = 1").select(F.col("route").alias("id"), "ax", "ay", "bx", "by")
    t = F.when(F.col("id") % 3 == 1, 0.25).otherwise(1.0)
    ux, uy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    places = s.where("id % 3 <> 0").select("id", (F.col("ax") + t * ux - uy).alias("px"), (F.col("ay") + t * uy + ux).alias("py"))
    return longs(lines.split_segments(s, places).select("id", "part", *[geometry.half_up(F.col(c), 2).alias(c) for c in ("x1", "y1", "x2", "y2")]), "part")


@query(BASE + ", b AS (SELECT route, length, degrees(atan2(ey - ay, ex - ax)) AS g FROM seg), o AS (SELECT route, length, abs(((g - route % 90 + 45) - 90 * floor((g - route % 90 + 45) / 90)) - 45) AS off FROM b) SELECT route, CAST(floor(sum(CASE WHEN off <= 6 THEN length ELSE 0 END) * 100 + 0.5) AS BIGINT) AS aligned_cm, CAST(floor(sum(length) * 100 + 0.5) AS BIGINT) AS total_cm FROM o GROUP BY route")
def aligned_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """length of routes along an axis or across it, within six degrees."""
    found = lines.aligned_length(role(spark, sf_dir, "bends"), F.col("route") % 90)
    return found.select("route", geometry.half_up(F.col("aligned"), 2).alias("aligned_cm"), geometry.half_up(F.col("total"), 2).alias("total_cm"))


@query(
    BASE
    + """, i AS (SELECT s.route, s.seq, unnest(range(1, CAST(greatest(1, ceil(s.length / 700)) AS BIGINT) + 1)) AS i, greatest(1, ceil(s.length / 700)) AS n, s.ax, s.ay, s.ex, s.ey FROM seg s), p AS (SELECT route, ax + (i - 0.5) / n * (ex - ax) AS x, ay + (i - 0.5) / n * (ey - ay) AS y FROM i),
q AS (SELECT a.route, a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy FROM bends a JOIN bends b ON a.route = b.route AND a.seq = 1 AND b.seq = 3), d AS (SELECT p.route, p.x, p.y, q.ax, q.ay, q.qx, q.qy, coalesce(greatest(0.0, least(1.0, ((p.x-ax)*(qx-ax)+(p.y-ay)*(qy-ay)) / nullif((qx-ax)*(qx-ax)+(qy-ay)*(qy-ay), 0))), 0.0) AS t FROM p JOIN q ON p.route = q.route)
SELECT route, count(*) AS samples, CAST(floor(max(sqrt((ax+t*(qx-ax)-x)*(ax+t*(qx-ax)-x)+(ay+t*(qy-ay)-y)*(ay+t*(qy-ay)-y))) * 10 + 0.5) AS BIGINT) AS farthest_dm FROM d GROUP BY route"""
)
def proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples of routes against the straight line between their ends."""
    v = role(spark, sf_dir, "bends")
    seg = obstacles.route_segments(v).select("route", "seq", "ax", "ay", "bx", "by")
    ends = v.groupBy("route").agg(*[F.min_by(c, "seq").alias(f"a{c}") for c in "xy"], *[F.max_by(c, "seq").alias(f"b{c}") for c in "xy"])
    found = statistics.proximity(seg, ends, 700).groupBy("route").agg(F.count("*").alias("samples"), F.max("distance").alias("far"))
    return found.select("route", "samples", F.floor(F.col("far") * 10 + 0.5).cast("long").alias("farthest_dm"))


@query(
    BASE
    + """, i AS (SELECT b.route, b.x, b.y, e.obstacle, e.cx, e.cy, e.dx, e.dy, a.mx, a.my, ((b.x-e.cx)*(e.dx-e.cx)+(b.y-e.cy)*(e.dy-e.cy))/((e.dx-e.cx)*(e.dx-e.cx)+(e.dy-e.cy)*(e.dy-e.cy)) AS t FROM bends b JOIN areas a ON abs(b.x - mx) + abs(b.y - my) < half JOIN side e ON e.obstacle = a.obstacle WHERE b.seq = 1)
SELECT route, obstacle, CAST(floor(min(sqrt((cx+t*(dx-cx)-x)*(cx+t*(dx-cx)-x)+(cy+t*(dy-cy)-y)*(cy+t*(dy-cy)-y))) * 100 + 0.5) AS BIGINT) AS nearest_cm, count(*) AS exits FROM i WHERE t BETWEEN 0 AND 1 GROUP BY route, obstacle"""
)
def wall_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """perpendicular exits of points from the areas they lie in."""
    areas = _areas(spark, sf_dir)
    p = role(spark, sf_dir, "bends").where("seq = 1").select("route", "x", "y")
    inside = obstacles.points_in_rings(p, areas, CELL, "route", "x", "y").select("route", "x", "y", "obstacle")
    walls = inside.join(obstacles.ring_edges(areas), "obstacle").select(F.struct("route", "obstacle").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("dx").alias("bx"), F.col("dy").alias("by"), F.col("edge").alias("wall"))
    found = geometry.wall_normals(walls).groupBy("point_id").agg(F.min("distance").alias("d"), F.count("*").alias("exits"))
    return found.select("point_id.route", "point_id.obstacle", geometry.half_up(F.col("d"), 2).alias("nearest_cm"), "exits")


# ---- catalogs -----------------------------------------------------------------------------------------------------
@query(
    role_sql("chambers")
    + """, seg AS (SELECT a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey, 50 * (1 + a.chamber_id % 4) AS diameter FROM chambers a JOIN chambers b ON b.chamber_id = a.chamber_id + 1 OR b.chamber_id = a.chamber_id + 9),
r AS (SELECT ax AS x, ay AS y, ex - ax AS ux, ey - ay AS uy, diameter FROM seg UNION ALL SELECT ex, ey, ax - ex, ay - ey, diameter FROM seg)
SELECT c.chamber_id, CAST(max(r.diameter) AS BIGINT) AS diameter, count(DISTINCT floor(degrees(atan2(CAST(uy AS DOUBLE), CAST(ux AS DOUBLE))) * 100 + 0.5)) AS rays, CAST(greatest(0, 4 - count(DISTINCT floor(degrees(atan2(CAST(uy AS DOUBLE), CAST(ux AS DOUBLE))) * 100 + 0.5))) AS BIGINT) AS free FROM chambers c JOIN r USING (x, y) GROUP BY c.chamber_id"""
)
def support_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions in use at existing chambers, their largest pipe, the places left."""
    c = role(spark, sf_dir, "chambers")
    ends = [c.select((F.col("chamber_id") - step).alias("chamber_id"), F.col("x").alias("bx"), F.col("y").alias("by")) for step in (1, 9)]
    seg = c.join(ends[0].unionByName(ends[1]), "chamber_id").select(F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by", (50 * (1 + F.col("chamber_id") % 4)).alias("diameter"))
    found = catalog.support_index(seg, c.select("chamber_id", "x", "y"))
    return longs(found.select("chamber_id", "diameter", F.size("bearings").alias("rays"), "free"), "diameter", "rays", "free")


COMPASS = """, d AS (SELECT DISTINCT l_orderkey AS node, l_partkey % 9 AS k FROM lineitem WHERE l_partkey % 9 <> 4), ray AS (SELECT CAST(node AS BIGINT) AS node, CAST(k AS BIGINT) AS ray, CAST(k % 3 - 1 AS BIGINT) AS dx, CAST(floor(k / 3) - 1 AS BIGINT) AS dy FROM d),
free AS (SELECT *, CASE WHEN node % 3 = 0 THEN 3 ELSE 4 END AS room FROM ray WHERE node % 3 <> 0 OR ((dx = 0 OR dy = 0) AND NOT (dx = 1 AND dy = 0))),
p AS (SELECT a.node, a.room, a.ray AS r1, b.ray AS r2 FROM free a JOIN free b ON a.node = b.node AND a.ray < b.ray AND (a.dx * b.dx + a.dy * b.dy = 0 OR (a.dx = -b.dx AND a.dy = -b.dy))),
t AS (SELECT p.node, p.room, p.r1, p.r2, q.r2 AS r3 FROM p JOIN p q ON q.node = p.node AND q.r1 = p.r2 JOIN p s ON s.node = p.node AND s.r1 = p.r1 AND s.r2 = q.r2),
f AS (SELECT t.node, t.room, t.r1, t.r2, t.r3, q.r2 AS r4 FROM t JOIN p q ON q.node = t.node AND q.r1 = t.r3 JOIN p s ON s.node = t.node AND s.r1 = t.r2 AND s.r2 = q.r2 JOIN p u ON u.node = t.node AND u.r1 = t.r1 AND u.r2 = q.r2)"""


@query(
    role_sql("tree")
    + COMPASS
    + " SELECT node, CAST(ray AS VARCHAR) AS rays FROM free UNION ALL SELECT node, concat_ws('+', r1, r2) FROM p UNION ALL SELECT node, concat_ws('+', r1, r2, r3) FROM t UNION ALL SELECT node, concat_ws('+', r1, r2, r3, r4) FROM f WHERE room >= 4"
)
def node_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-7: sets of rays that a root may use; every third node already has one to the east."""
    k = F.col("k")
    role(spark, sf_dir, "tree")
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("long").alias("node"), (F.col("l_partkey") % 9).cast("long").alias("k")).where("k <> 4").distinct()
    rays = d.select("node", k.alias("ray"), (k % 3 - 1).alias("dx"), (F.floor(k / 3) - 1).alias("dy"))
    # the ray in use points where no free one of its node may: a free ray to the east would lie on it
    used = d.where("node % 3 = 0").select("node").distinct().select("node", F.lit(1).cast("long").alias("ex"), F.lit(0).cast("long").alias("ey"))
    free = rays.where("node % 3 <> 0 OR dx <> 1 OR dy <> 0")
    return catalog.node_configurations(free, used).select("node", F.array_join(F.col("rays").cast("array<string>"), "+").alias("rays"))


@query(
    BASE
    + f""", pt AS (SELECT route AS demand, x, y FROM bends WHERE seq = 1), pair AS (SELECT demand, root, root_rank, x1, y1, x2, y2 FROM (SELECT p.demand, a.obstacle AS root, p.x AS x1, p.y AS y1, a.mx + 7000 AS x2, a.my AS y2, row_number() OVER (PARTITION BY p.demand ORDER BY (p.x-a.mx-7000)*(p.x-a.mx-7000)+(p.y-a.my)*(p.y-a.my), a.obstacle) AS root_rank FROM pt p, areas a) WHERE root_rank <= 2),
leg AS (SELECT demand, root, 0 AS way, x1 AS ax, y1 AS ay, x2 AS ex, y2 AS ey FROM pair UNION ALL SELECT demand, root, 1, x1, y1, x2, y1 FROM pair UNION ALL SELECT demand, root, 1, x2, y1, x2, y2 FROM pair UNION ALL SELECT demand, root, 2, x1, y1, x1, y2 FROM pair UNION ALL SELECT demand, root, 2, x1, y2, x2, y2 FROM pair),
bad AS (SELECT DISTINCT s.demand, s.root, s.way FROM leg s JOIN side e ON e.kind IN ('park', 'oks', 'water') AND {meets('s', 'e')} UNION SELECT s.demand, s.root, s.way FROM leg s JOIN areas a ON a.kind IN ('park', 'oks', 'water') AND abs(s.ax - mx) + abs(s.ay - my) < half)
SELECT p.demand, p.root, p.root_rank, CASE WHEN b0.way IS NULL THEN 'straight' WHEN b1.way IS NULL THEN 'x_first' WHEN b2.way IS NULL THEN 'y_first' ELSE 'no_path' END AS phase
FROM pair p LEFT JOIN bad b0 ON b0.demand = p.demand AND b0.root = p.root AND b0.way = 0 LEFT JOIN bad b1 ON b1.demand = p.demand AND b1.root = p.root AND b1.way = 1 LEFT JOIN bad b2 ON b2.demand = p.demand AND b2.root = p.root AND b2.way = 2"""
)
def first_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-2, R8: pairs in coverage-first order with the first simple way that nothing forbidden lies on."""
    demands = role(spark, sf_dir, "bends").where("seq = 1").select(F.col("route").alias("point_id"), "x", "y")
    roots = role(spark, sf_dir, "areas").select(F.col("obstacle").alias("chamber_id"), (F.col("mx") + 7000).alias("x"), F.col("my").alias("y"))
    pairs = topology.nearest(demands, roots, 2, carry=["x", "y"]).join(roots.select("chamber_id", F.col("x").alias("x2"), F.col("y").alias("y2")), "chamber_id")
    named = pairs.select(F.col("point_id").alias("demand"), F.col("chamber_id").alias("root"), F.col("rank").alias("root_rank"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    return longs(catalog.first_paths(named, _areas(spark, sf_dir), CELL), "root_rank")


@query(role_sql("variant_edges") + " SELECT variant, CAST(down_node AS BIGINT) AS node FROM variant_edges GROUP BY variant, down_node HAVING count(DISTINCT up_node) > 1")
def multiple_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that several nodes feed."""
    return longs(validate.multiple_upstream(role(spark, sf_dir, "variant_edges")), "node")


@query(role_sql("variant_edges") + " SELECT variant, edge FROM variant_edges WHERE up_node < 5 AND down_node < 5 AND length < 10")
def short_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections between two chambers below the least length."""
    chambers = spark.range(5).select(F.col("id").cast("int").alias("node"))
    return validate.short_sections(role(spark, sf_dir, "variant_edges"), chambers).select("variant", "edge")


# ---- evaluation and export ----------------------------------------------------------------------------------------
def _priced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return role(spark, sf_dir, "variant_edges"), role(spark, sf_dir, "variants"), dims.pipes(spark)


@query(
    role_sql("variant_edges", "variants")
    + ECON
    + """, shape AS (SELECT variant, count(*) AS edges, bool_or(diameter IS NULL) AS oversized, list_sort(list(concat_ws(',', up_node, down_node, length))) AS shape FROM priced GROUP BY variant), deg AS (SELECT variant, max(n) AS degree FROM (SELECT variant, node, count(*) AS n FROM ends GROUP BY variant, node) GROUP BY variant),
j AS (SELECT s.variant, h.edges, s.cost, s.length, h.shape, CASE WHEN oversized THEN 'SIZING' WHEN degree > 4 THEN 'CHAMBERS' WHEN unconnected > 0 THEN 'COVERAGE' END AS o FROM scored s JOIN shape h USING (variant) JOIN deg USING (variant) LEFT JOIN (SELECT variant, max(unconnected) AS unconnected FROM variants GROUP BY variant) USING (variant)),
k AS (SELECT *, coalesce(o, CASE WHEN row_number() OVER (PARTITION BY shape, o IS NULL ORDER BY cost, length, variant) > 1 THEN 'DUPLICATE' ELSE 'ACCEPTED' END) AS outcome FROM j)
SELECT variant, edges, outcome, CASE WHEN outcome = 'ACCEPTED' THEN row_number() OVER (PARTITION BY edges, outcome ORDER BY round(CAST(cost AS DOUBLE) * 0.7 / 25e6 + 0.3 * CAST(length AS DOUBLE) / 100, 9), cost, length, variant) ELSE -1 END AS rank FROM k"""
)
def evaluate_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants checked in the order of the plan, the accepted ones ranked."""
    edges, variants, pipes = _priced(spark, sf_dir)
    found = evaluate.evaluate(edges, variants, pipes, F.col("up_node") == 0)
    return longs(found.select("variant", "edges", "outcome", "rank").fillna({"rank": -1}), "rank")


@query(
    role_sql("variant_edges", "variants")
    + ECON
    + """, n AS (SELECT variant, node, count(*) AS degree, max(diameter) AS d FROM ends GROUP BY variant, node)
SELECT 'heat_network' AS object_type, concat(CAST(variant AS VARCHAR), ':e', CAST(edge AS VARCHAR)) AS id, CAST(coalesce(cost, -1) AS DOUBLE) AS cost, CAST(coalesce(diameter, -1) AS BIGINT) AS diameter FROM priced
UNION ALL SELECT CASE WHEN degree >= 3 THEN 'heat_chamber' ELSE 'technical_node' END, concat(CAST(variant AS VARCHAR), ':n', CAST(node AS VARCHAR)), CASE WHEN degree < 3 THEN -1 WHEN d <= 200 THEN 3000000 WHEN d <= 500 THEN 5000000 WHEN d <= 1000 THEN 8000000 ELSE 12000000 END, CASE WHEN degree >= 3 THEN d ELSE -1 END FROM n
UNION ALL SELECT 'variant_summary', concat(CAST(variant AS VARCHAR), ':summary'), CAST(construction AS DOUBLE), -1 FROM scored"""
)
def emit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes, chambers, technical nodes and summaries of all variants."""
    edges, variants, pipes = _priced(spark, sf_dir)
    from ..operators.economics import variant_economics

    out = evaluate.emit(edges, variant_economics(edges, variants, pipes, F.col("up_node") == 0), pipes)
    return longs(doubles(out.select("object_type", "id", "cost", "diameter"), "cost"), "diameter").fillna({"cost": -1.0, "diameter": -1})


@query(
    role_sql("variant_edges")
    + PRICED
    + """, ends AS (SELECT variant, up_node AS node FROM priced UNION ALL SELECT variant, down_node FROM priced), n AS (SELECT variant, count(*) AS nodes, count(*) FILTER (WHERE d >= 3) AS chambers FROM (SELECT variant, node, count(*) AS d FROM ends GROUP BY variant, node) GROUP BY variant)
SELECT p.variant, count(*) AS edges, CAST(sum(length) AS DOUBLE) AS length, CAST(max(length) AS DOUBLE) AS longest, CAST(sum(cost) AS DOUBLE) AS pipes, any_value(n.nodes) AS nodes, any_value(n.chambers) AS chambers FROM priced p JOIN n USING (variant) GROUP BY p.variant"""
)
def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of variants side by side."""
    edges, _, pipes = _priced(spark, sf_dir)
    return doubles(evaluate.comparison(edges, pipes), "length", "longest", "pipes")
