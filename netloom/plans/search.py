"""Registered queries of catalogs under search, saved results and exact networks, with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, geometry
from ..operators import catalog, evaluate, solve, topology
from ..operators.economics import price_edges
from .network import PRICED, longs
from .project import role, role_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


#: Problems of a root r and two terminals a, b: lengths of the pipes r-a, r-b, a-b, b-a and the demands.
SMALL = "SELECT CAST(o_orderkey AS BIGINT) AS problem, CAST(1 + o_custkey % 17 AS BIGINT) AS ra, CAST(1 + o_orderkey % 23 AS BIGINT) AS rb, CAST(1 + (o_custkey + o_orderkey) % 11 AS BIGINT) AS ab, CAST(1 + (o_custkey + 2 * o_orderkey) % 13 AS BIGINT) AS ba, CAST(1 + o_custkey % 19 AS BIGINT) AS ua, CAST(1 + o_orderkey % 16 AS BIGINT) AS ub FROM {orders}"
PIPE = "CASE WHEN %s <= 10 THEN 2 * %s WHEN %s <= 25 THEN 5 * %s END"
pipe = lambda length, flow: PIPE % (flow, length, flow, length)


@query("WITH p AS (" + SMALL.replace("{orders}", "orders") + f"), c AS (SELECT problem, least({pipe('ra', 'ua')} + {pipe('rb', 'ub')}, {pipe('ra', '(ua + ub)')} + {pipe('ab', 'ub')}, {pipe('rb', '(ua + ub)')} + {pipe('ba', 'ua')}) AS cost FROM p) SELECT problem, CASE WHEN cost IS NULL THEN 'INFEASIBLE' ELSE 'OPTIMAL' END AS status, coalesce(cost, -1) AS cost FROM c")
def network_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-8: cheapest arborescences with flows and pipe sizes; capacities bind, and together the demands may exceed the largest pipe."""
    p = spark.sql(SMALL, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    ends = F.array(*[F.struct(F.lit(n).alias("arc"), F.lit(n[0]).alias("up"), F.lit(n[1]).alias("down"), F.col(n).alias("length"), F.lit(cap).alias("capacity"), F.lit(rate).alias("rate")) for n in ("ra", "rb", "ab", "ba") for cap, rate in ((10, 2), (25, 5))])
    arcs = p.select("problem", F.explode(ends).alias("e")).select("problem", "e.arc", "e.up", "e.down", "e.capacity", (F.col("e.length") * F.col("e.rate")).alias("cost"))
    terminals = p.select("problem", F.explode(F.array(F.struct(F.lit("a").alias("node"), F.col("ua").alias("units")), F.struct(F.lit("b").alias("node"), F.col("ub").alias("units")))).alias("t")).select("problem", "t.*")
    found = solve.solve_networks(arcs, terminals, p.select("problem", F.lit("r").alias("node")))
    return longs(found.select("problem", "status", F.coalesce("cost", F.lit(-1)).alias("cost")), "cost")


ALTERNATIVES = "SELECT CAST(l_orderkey % 400 AS BIGINT) AS grp, CAST(l_orderkey AS BIGINT) AS alt, CAST(l_suppkey % 12 AS BIGINT) AS part, CAST(l_quantity AS BIGINT) AS cost FROM {lineitem}"


@query(
    "WITH l AS ("
    + ALTERNATIVES.replace("{lineitem}", "lineitem")
    + """), a AS (SELECT grp, alt, sum(cost) AS cost, list(DISTINCT part) AS parts FROM l GROUP BY grp, alt), f AS (SELECT grp, arg_min(alt, (cost, alt)) AS a1, arg_min(parts, (cost, alt)) AS p1 FROM a GROUP BY grp),
d1 AS (SELECT a.*, f.p1 FROM a JOIN f USING (grp) WHERE 1 - CAST(len(list_intersect(a.parts, f.p1)) AS DOUBLE) / len(list_distinct(list_concat(a.parts, f.p1))) >= 0.5), s AS (SELECT grp, arg_min(alt, (cost, alt)) AS a2, arg_min(parts, (cost, alt)) AS p2 FROM d1 GROUP BY grp),
t AS (SELECT d1.grp, arg_min(alt, (cost, alt)) AS a3 FROM d1 JOIN s USING (grp) WHERE 1 - CAST(len(list_intersect(parts, p2)) AS DOUBLE) / len(list_distinct(list_concat(parts, p2))) >= 0.5 GROUP BY d1.grp)
SELECT grp, 1 AS place, a1 AS alt FROM f UNION ALL SELECT grp, 2, a2 FROM s UNION ALL SELECT grp, 3, a3 FROM t"""
)
def distinct_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three alternatives that differ in half of their parts."""
    rows = spark.sql(ALTERNATIVES, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    found = catalog.distinct_alternatives(rows.groupBy("grp", "alt").agg(F.sum("cost").alias("cost"), F.collect_set("part").alias("parts")))
    return longs(found, "place")


CONFLICTS = "SELECT CAST(o_orderkey AS BIGINT) AS conflict, concat('s', CAST(o_custkey % 8 AS VARCHAR(9))) AS scope, CAST(o_orderkey % 5 AS BIGINT) AS l1, CAST(o_custkey % 6 AS BIGINT) AS l2, CAST((o_orderkey + o_custkey) % 7 AS BIGINT) AS l3, CAST(o_orderkey % 3 AS BIGINT) AS shape FROM {orders}"


@query(
    "WITH c AS ("
    + CONFLICTS.replace("{orders}", "orders")
    + """), n AS (SELECT conflict, scope, list_sort(list_distinct(CASE shape WHEN 0 THEN [l1, l2, l3] WHEN 1 THEN [l1, l2] ELSE [l1, l2 + 7, l3] END)) AS literals FROM c WHERE scope <> 's3'),
o AS (SELECT scope, literals, min(conflict) AS first FROM n GROUP BY scope, literals), k AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM o s WHERE s.scope = o.scope AND len(s.literals) < len(o.literals) AND len(list_intersect(s.literals, o.literals)) = len(s.literals)))
SELECT scope, array_to_string(literals, '+') AS literals, first FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY first) AS n FROM k) WHERE n <= 20"""
)
def conflict_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-11: conflicts of current scopes, once each, none that holds a smaller one, a bounded number a scope."""
    c = spark.sql(CONFLICTS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    literals = F.when(F.col("shape") == 0, F.array("l1", "l2", "l3")).when(F.col("shape") == 1, F.array("l1", "l2")).otherwise(F.array(F.col("l1"), F.col("l2") + 7, F.col("l3")))
    scopes = c.select("scope").distinct().where("scope <> 's3'")
    kept = catalog.conflict_store(c.select("conflict", "scope", literals.alias("literals")), scopes, 20)
    return kept.select("scope", F.array_join(F.col("literals").cast("array<string>"), "+").alias("literals"), "first")


@query(
    """WITH o AS (SELECT CAST(o_custkey AS BIGINT) AS grp, CAST(o_orderkey % 3 AS BIGINT) AS member, o_orderkey % 4 AS side FROM orders), a AS (SELECT DISTINCT grp, member FROM o WHERE side = 0), b AS (SELECT DISTINCT grp, member FROM o WHERE side <> 0),
m AS (SELECT coalesce(a.grp, b.grp) AS grp, a.grp IS NOT NULL AS was, b.grp IS NOT NULL AS now FROM a FULL JOIN b ON a.grp = b.grp AND a.member = b.member)
SELECT grp, CASE WHEN bool_or(was AND NOT now) THEN 'RESTART' WHEN bool_or(now AND NOT was) THEN 'ADDITIVE' ELSE 'UNCHANGED' END AS kind FROM m GROUP BY grp"""
)
def expansion_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-12: whether a catalog's next version adds to it or starts again."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("long").alias("grp"), (F.col("o_orderkey") % 3).cast("long").alias("member"), (F.col("o_orderkey") % 4).alias("side"))
    return catalog.expansion_kind(o.where("side = 0"), o.where("side <> 0"), "grp", "member")


@query(
    role_sql("variant_edges")
    + PRICED
    + f""", k AS (SELECT variant, edge, flow, length, cost + CASE WHEN edge % 3 = 0 THEN CAST(0.01 AS DECIMAL(6,2)) ELSE 0 END AS stored_cost, cost, diameter, CASE WHEN length % 4 = 0 THEN 50 ELSE diameter END AS stored FROM priced),
c AS (SELECT k.*, p.max_flow, p.max_length, p.rate, q.rate AS due FROM k LEFT JOIN {dims.pipes_sql()} p ON p.diameter = k.stored LEFT JOIN {dims.pipes_sql()} q ON q.diameter = k.diameter)
SELECT variant, edge, 'DIAMETER_TOO_SMALL' AS code FROM c WHERE max_flow IS NULL OR flow > max_flow UNION ALL SELECT variant, edge, 'LENGTH_EXCEEDED' FROM c WHERE length > max_length UNION ALL SELECT variant, edge, 'COST_MISMATCH' FROM c WHERE edge % 3 = 0 OR rate <> due"""
)
def recheck_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored edges checked again; every third cost and some pipes are tampered with."""
    pipes = dims.pipes(spark)
    e = price_edges(role(spark, sf_dir, "variant_edges"), pipes)
    stored = e.withColumns({"stored_cost": F.col("cost") + F.when(F.col("edge") % 3 == 0, F.lit("0.01").cast("decimal(6,2)")).otherwise(F.lit(0).cast("decimal(6,2)")), "stored_diameter": F.when(F.col("length") % 4 == 0, 50).otherwise(F.col("diameter"))}).drop("diameter", "cost", "rate", "rebuild_rate")
    return evaluate.recheck(stored, pipes)


@query(
    role_sql("forest")
    + """, e AS (SELECT network, CASE WHEN node = 1 THEN CASE WHEN CAST(floor(network / 1000) AS BIGINT) % 5 = 0 THEN 3 ELSE 0 END ELSE CAST(floor(node / 2) AS BIGINT) END AS up, node AS down FROM forest), d AS (SELECT network, node, sum(i) AS i, sum(o) AS o FROM (SELECT network, up AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT network, down, 1, 0 FROM e) GROUP BY network, node)
SELECT network, count(*) AS nodes, CAST(sum(i) AS BIGINT) AS edges, count(*) FILTER (WHERE i = 0) AS roots, count(*) FILTER (WHERE o = 0) AS leaves, count(*) FILTER (WHERE i + o >= 3) AS branches, CAST(floor(network / 1000) AS BIGINT) % 5 <> 0 OR sum(i) < 3 AS tree FROM d GROUP BY network"""
)
def graph_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of many graphs; in every fifth network the first node hangs below its third, a cycle where there is one."""
    t = role(spark, sf_dir, "forest")
    up = F.when(F.col("node") == 1, F.when(F.floor(F.col("network") / 1000) % 5 == 0, 3).otherwise(0)).otherwise(F.floor(F.col("node") / 2))
    return evaluate.graph_integrity(t.select("network", up.cast("long").alias("up"), F.col("node").alias("down")))


@query(
    role_sql("vertices")
    + """, s AS (SELECT route AS block, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM vertices WINDOW w AS (PARTITION BY route ORDER BY seq)), w AS (SELECT block, CAST(floor(degrees(atan2(CAST(ny - y AS DOUBLE), CAST(nx - x AS DOUBLE))) * 100 + 0.5) AS BIGINT) AS a, CAST(floor(sqrt(CAST((nx-x)*(nx-x)+(ny-y)*(ny-y) AS DOUBLE)) * 1000 + 0.5) AS BIGINT) AS length FROM s WHERE nx IS NOT NULL AND (nx <> x OR ny <> y)),
m AS (SELECT block, ((a % 9000) + 9000) % 9000 AS angle, length FROM w), h AS (SELECT p.block, p.angle, sum(q.length) AS held FROM (SELECT DISTINCT block, angle FROM m) p JOIN m q ON q.block = p.block AND (q.angle BETWEEN p.angle AND p.angle + 600 OR q.angle + 9000 BETWEEN p.angle AND p.angle + 600) GROUP BY p.block, p.angle)
SELECT block, arg_min(angle, (-held, angle)) AS axis, CAST(max(held) AS BIGINT) AS length FROM h GROUP BY block"""
)
def facade_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six-degree window of directions, modulo 90, that holds most wall length of each block."""
    s = geometry.vertices_to_segments(role(spark, sf_dir, "vertices"), "route", "seq").where("length > 0")
    angle = geometry.half_up(F.degrees(F.atan2((F.col("ny") - F.col("y")).cast("double"), (F.col("nx") - F.col("x")).cast("double"))), 2)
    return catalog.facade_windows(s.select(F.col("route").alias("block"), angle.alias("angle"), geometry.half_up(F.col("length")).alias("length")))


@query(
    role_sql("points", "chambers")
    + """, n AS (SELECT * FROM (SELECT p.point_id AS demand, h.chamber_id AS root, p.x, p.y, h.x AS rx, h.y AS ry, (p.x-h.x)*(p.x-h.x)+(p.y-h.y)*(p.y-h.y) AS d2, row_number() OVER (PARTITION BY p.point_id ORDER BY (p.x-h.x)*(p.x-h.x)+(p.y-h.y)*(p.y-h.y), h.chamber_id) AS k FROM points p, chambers h) WHERE k = 1),
c AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY root ORDER BY d2, demand) - 1) / 4) AS BIGINT) AS cluster FROM n), s AS (SELECT *, coalesce(lag(x) OVER w, rx) AS px, coalesce(lag(y) OVER w, ry) AS py FROM c WINDOW w AS (PARTITION BY root, cluster ORDER BY d2, demand))
SELECT root, cluster, count(*) AS demands, CAST(sum(floor(sqrt(CAST((x-px)*(x-px)+(y-py)*(y-py) AS DOUBLE)) * 1000 + 0.5)) AS BIGINT) AS spine, CAST(sum(floor(sqrt(CAST(d2 AS DOUBLE)) * 1000 + 0.5)) AS BIGINT) AS star FROM s GROUP BY root, cluster"""
)
def shared_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C-3, R11: demands of each root in clusters of four, a chain through them against single lines."""
    c = role(spark, sf_dir, "chambers").select(F.col("chamber_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = topology.nearest(role(spark, sf_dir, "points"), role(spark, sf_dir, "chambers"), 1, carry=["x", "y"]).join(c, "chamber_id")
    return catalog.shared_clusters(near.select(F.col("point_id").alias("demand"), F.col("chamber_id").alias("root"), "distance2", "x", "y", "rx", "ry"))


@query("WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS feature, p_size AS s FROM part) SELECT feature, concat_ws(';', CASE WHEN s % 4 <> 0 THEN concat('id=', CAST(feature AS VARCHAR)) END, CASE WHEN s % 3 = 1 THEN 'note=kept' END, 'source=survey') AS kept FROM p")
def curated_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties without colours and empty values, their origin kept."""
    from ..sources.features import curate

    s = F.col("p_size")
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    properties = F.create_map(F.lit("id"), F.when(s % 4 != 0, F.col("p_partkey").cast("string")), F.lit("note"), F.when(s % 3 == 0, "").when(s % 3 == 1, "kept").otherwise(" "), F.lit("stroke-color"), F.lit("#fff"), F.lit("source"), F.lit("survey"))
    kept = curate(p.select(F.col("p_partkey").cast("long").alias("feature"), properties.alias("properties")))
    return kept.select("feature", F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("kept"))
