"""Registered network queries and the SQL that checks each of them.

Operators get their input from ``project.ROLES``; the SQL states the same result
independently, with joins and windows of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, geometry
from ..functions.dims import pipes_sql
from ..operators import economics, intervals, sizing, topology
from ..operators import inspect as inspection
from ..operators.lineage import cut
from ..sources import features as sources
from .project import role, role_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def doubles(df: DataFrame, *names: str) -> DataFrame:
    """Decimals leave as doubles, so that both engines' results compare by value."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


P = pipes_sql()
DU = f"(SELECT min(diameter) FROM {P} WHERE max_flow >= %s)"


# ---- flagship: attach, roll up, size, price, score ----------------------------------------------------------------
@query(
    role_sql("points", "chambers", "tree")
    + f""", best AS (
  SELECT point_id, chamber_id, d2 FROM (
    SELECT p.point_id, c.chamber_id, (p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y) AS d2,
           row_number() OVER (PARTITION BY p.point_id ORDER BY (p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y), c.chamber_id) AS r
    FROM points p CROSS JOIN chambers c) WHERE r = 1
), flows AS (
  SELECT chamber_id, CAST(sum(flow) AS DECIMAL(18,3)) AS flow, count(*) AS consumers, CAST(sum(floor(sqrt(CAST(d2 AS DOUBLE)) * 10 + 0.5)) AS DECIMAL(14,3)) / 1000 AS len
  FROM best JOIN points USING (point_id) GROUP BY chamber_id
), sized AS (
  SELECT f.*, {DU % "f.flow"} AS diameter FROM flows f
)
SELECT s.chamber_id, CAST(s.flow AS DOUBLE) AS flow, s.consumers, CAST(s.diameter AS BIGINT) AS diameter,
       CAST(round(CAST(p.rate AS DECIMAL(12,0)) * CAST(s.len AS DECIMAL(14,3)), 2) AS DOUBLE) AS cost
FROM sized s LEFT JOIN {P} p ON p.diameter = s.diameter"""
)
def network_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every consumer joins its nearest chamber; flows and lengths by chamber are sized and priced."""
    points = role(spark, sf_dir, "points")
    best = topology.nearest(points, role(spark, sf_dir, "chambers"), 1, carry=["flow"])
    flows = best.groupBy("chamber_id").agg(F.sum("flow").cast(dims.FLOW).alias("flow"), F.count("*").alias("consumers"), (F.sum(F.floor(F.sqrt(F.col("distance2").cast("double")) * 10 + 0.5)).cast("decimal(14,3)") / 1000).cast(dims.LENGTH).alias("length"))
    priced = economics.price_edges(flows.withColumn("crossing", F.lit("base")), dims.pipes(spark))
    return longs(doubles(priced.select("chamber_id", "flow", "consumers", "diameter", "cost"), "flow", "cost"), "diameter")


# ---- sources ------------------------------------------------------------------------------------------------------
@query(role_sql("features") + " SELECT feature_index, feature_id, object_type FROM features WHERE feature_index > 100 ORDER BY feature_index LIMIT 500")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a key."""
    return sources.page(role(spark, sf_dir, "features"), 100, 500, "feature_index").select("feature_index", "feature_id", "object_type")


@query(role_sql("features") + " SELECT feature_index, object_type FROM features WHERE object_type IN ('source','heat_network','heat_chamber','oks_future','oks_connection_point')")
def typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6."""
    return sources.typed(role(spark, sf_dir, "features")).select("feature_index", "object_type")


def _boxed(spark, sf_dir):
    p = role(spark, sf_dir, "points")
    return p.select(F.concat(F.lit("f"), F.col("point_id")).alias("feature_id"), F.when(F.col("point_id") % 3 == 0, "source").when(F.col("point_id") % 3 == 1, "oks_existing").otherwise("restriction").alias("object_type"), F.col("x").alias("minx"), (F.col("x") + 40).alias("maxx"), F.col("y").alias("miny"), (F.col("y") + 40).alias("maxy"), F.lit("feature").alias("layer"))


BOXED = role_sql("points") + ", boxed AS (SELECT concat('f', CAST(point_id AS VARCHAR)) AS feature_id, CASE point_id % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'oks_existing' ELSE 'restriction' END AS object_type, x AS minx, x + 40 AS maxx, y AS miny, y + 40 AS maxy FROM points)"


@query(BOXED + " SELECT feature_id, minx, miny FROM boxed WHERE maxx >= 20000 AND minx <= 60000 AND maxy >= 10000 AND miny <= 70000")
def window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7."""
    return sources.in_window(_boxed(spark, sf_dir), 20000, 10000, 60000, 70000).select("feature_id", "minx", "miny")


@query(BOXED + ", anchors AS (SELECT (s_suppkey * 15485863) % 100000 AS x, (s_suppkey * 32452843) % 100000 AS y FROM supplier WHERE s_suppkey < 5), a AS (SELECT min(x)-610 AS x1, min(y)-610 AS y1, max(x)+610 AS x2, max(y)+610 AS y2 FROM anchors) SELECT feature_id, object_type FROM boxed, a WHERE object_type = 'source' OR (maxx >= x1 AND minx <= x2 AND maxy >= y1 AND miny <= y2)")
def routing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core features and what lies around five anchors."""
    anchors = role(spark, sf_dir, "chambers").where("chamber_id < 5").select(F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"))
    return sources.routing_window(_boxed(spark, sf_dir), anchors).select("feature_id", "object_type")


@query(BOXED + """, layers AS (
  SELECT feature_id, 'feature' AS layer, minx, miny, maxx, maxy FROM boxed
  UNION ALL SELECT feature_id, 'ring', minx - 5, miny - 5, maxx + 5, maxy + 5 FROM boxed WHERE object_type IN ('oks_existing', 'oks_future')
), v AS (SELECT *, row_number() OVER (ORDER BY feature_id, layer) AS n, count(*) OVER () AS total FROM layers WHERE maxx >= 0 AND minx <= 50000 AND maxy >= 0 AND miny <= 50000)
SELECT feature_id, layer, CAST(n AS BIGINT) AS n, total > 300 AS truncated FROM v WHERE n <= 300""")
def map_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and building rings of a viewport, numbered, with the truncation flag."""
    boxed = _boxed(spark, sf_dir)
    return longs(sources.map_view(boxed, sources.building_rings(boxed), 0, 0, 50000, 50000, 300).select("feature_id", "layer", "n", "truncated"), "n")


@query("""WITH c AS (SELECT event_id AS import_id, concat('v', CAST(event_id % 3 AS VARCHAR)) AS contract_version, sha256(CAST(user_id % 50 AS VARCHAR)) AS sha256 FROM events),
r AS (SELECT concat('v', CAST(c_custkey % 3 AS VARCHAR)) AS contract_version, sha256(CAST(c_custkey AS VARCHAR)) AS sha256 FROM customer WHERE c_custkey < 20)
SELECT min(import_id) AS import_id, contract_version, sha256 FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.contract_version = c.contract_version AND r.sha256 = c.sha256) GROUP BY contract_version, sha256""")
def new_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports that the registry doesn't hold, one for each digest."""
    version = lambda c: F.concat(F.lit("v"), F.col(c) % 3)
    candidates = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("import_id"), version("event_id").alias("contract_version"), F.sha2((F.col("user_id") % 50).cast("string"), 256).alias("sha256"))
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey < 20").select(version("c_custkey").alias("contract_version"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha256"))
    return sources.new_imports(candidates, known).select("import_id", "contract_version", "sha256")


@query(BOXED + " SELECT concat_ws(':', CAST(k AS VARCHAR), feature_id) AS feature_id, minx + k * 200000 AS minx, maxx + k * 200000 AS maxx FROM boxed, range(0, 3) t(k)")
def multiply_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S17."""
    return longs(sources.multiply(_boxed(spark, sf_dir), 3, 200000).select("feature_id", "minx", "maxx"), "minx", "maxx")


# ---- inspection ---------------------------------------------------------------------------------------------------
TYPES = "('source','heat_network','heat_chamber','oks_future','oks_connection_point','oks_existing','restriction')"
DUS = "(" + ",".join(map(str, dims.DIAMETERS)) + ")"


@query(
    role_sql("features")
    + f""", k AS (SELECT * FROM features WHERE object_type IN {TYPES}), t AS (SELECT feature_id, arg_min(object_type, feature_index) AS actual FROM k GROUP BY feature_id),
refs AS (SELECT k.*, t.actual FROM k LEFT JOIN t ON t.feature_id = k.reference WHERE k.object_type IN ('oks_connection_point','heat_network','heat_chamber'))
SELECT 'UNSUPPORTED_OBJECT_TYPE' AS code, feature_index, feature_id FROM features WHERE object_type NOT IN {TYPES}
UNION ALL SELECT 'INVALID_GEOMETRY_TYPE', feature_index, feature_id FROM k WHERE NOT CASE WHEN object_type IN ('source','heat_chamber','oks_connection_point') THEN geometry_type = 'Point' WHEN object_type = 'heat_network' THEN geometry_type = 'LineString' WHEN object_type = 'restriction' THEN geometry_type IN ('Polygon','LineString') ELSE geometry_type = 'Polygon' END
UNION ALL SELECT 'INVALID_NUMBER', feature_index, feature_id FROM k WHERE object_type = 'oks_future' AND (flow IS NULL OR flow <= 0)
UNION ALL SELECT 'INVALID_DIAMETER', feature_index, feature_id FROM k WHERE object_type IN ('heat_network','heat_chamber') AND diameter NOT IN {DUS}
UNION ALL SELECT 'MISSING_EXISTING_NETWORK_VALUE', feature_index, feature_id FROM k WHERE object_type = 'heat_network' AND (flow IS NULL OR flow <= 0)
UNION ALL SELECT 'DUPLICATE_FEATURE_ID', feature_index, feature_id FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY feature_index) AS n FROM k) WHERE n > 1
UNION ALL SELECT CASE WHEN actual IS NULL THEN 'UNKNOWN_REFERENCE' ELSE 'INVALID_REFERENCE_TYPE' END, feature_index, feature_id FROM refs
  WHERE actual IS NULL OR NOT CASE WHEN object_type = 'oks_connection_point' THEN actual = 'oks_future' ELSE actual IN ('source','heat_network','heat_chamber') END
UNION ALL SELECT DISTINCT 'MISSING_OKS_CONNECTION_POINT', -1, feature_id FROM k WHERE object_type = 'oks_future' AND feature_id NOT IN (SELECT reference FROM k WHERE object_type = 'oks_connection_point')"""
)
def inspect_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of an input."""
    return inspection.issues(role(spark, sf_dir, "features")).select("code", "feature_index", "feature_id")


@query(role_sql("features") + f" SELECT t.object_type, count(f.feature_index) AS n FROM (SELECT unnest([{TYPES[1:-1]}]) AS object_type) t LEFT JOIN features f ON f.object_type = t.object_type GROUP BY t.object_type")
def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with zeroes."""
    return inspection.counts_by_type(role(spark, sf_dir, "features"))


@query(
    role_sql("features")
    + """, b AS (SELECT feature_id, arg_min(flow, feature_index) FILTER (WHERE flow IS NOT NULL) AS f FROM features WHERE object_type = 'oks_future' GROUP BY feature_id)
SELECT p.feature_index, p.feature_id, CAST(coalesce(p.flow, b.f, -999) AS BIGINT) AS flow, coalesce(p.flow, b.f) IS NULL AS missing FROM features p LEFT JOIN b ON b.feature_id = p.reference WHERE p.object_type = 'oks_connection_point'"""
)
def demand_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own flow, else the building's."""
    found = role(spark, sf_dir, "features")
    demands = inspection.demands(found)
    return longs(demands.fillna({"flow": -999}), "flow")


# ---- topology -----------------------------------------------------------------------------------------------------
@query(
    role_sql("points", "chambers")
    + """ SELECT point_id, chamber_id, distance2, rank FROM (SELECT p.point_id, c.chamber_id, (p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y) AS distance2,
  row_number() OVER (PARTITION BY p.point_id ORDER BY (p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y), c.chamber_id) AS rank FROM points p CROSS JOIN chambers c) WHERE rank <= 12"""
)
def nearest_chambers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve nearest targets of each point."""
    return longs(topology.nearest(role(spark, sf_dir, "points"), role(spark, sf_dir, "chambers")), "rank")


ALL_PAIRS = """ SELECT point_id, chamber_id, distance2%s FROM (SELECT p.point_id, c.chamber_id, c.incident, (p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y) AS distance2 FROM points p, chambers c) WHERE distance2 <= %d"""


@query(role_sql("points", "chambers") + ALL_PAIRS % ("", 4000**2))
def within_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within a distance, through grid cells."""
    return topology.pairs_within(role(spark, sf_dir, "points"), role(spark, sf_dir, "chambers"), 4000, "point_id", "chamber_id")


@query(role_sql("points", "chambers") + ", d AS (" + ALL_PAIRS % (", incident", 6000**2) + ") SELECT point_id, chamber_id, distance2 FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance2, chamber_id) AS r FROM d WHERE incident < 4) WHERE r = 1")
def nearest_with_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chamber in reach that still takes an edge."""
    free = role(spark, sf_dir, "chambers").where(F.col("incident") < topology.CHAMBER_CAPACITY)
    return topology.nearest_in_grid(role(spark, sf_dir, "points"), free, 6000)


SEGMENTS = ", seg AS (SELECT route, seq AS id, x AS ax, y AS ay, nx AS ex, ny AS ey FROM (SELECT *, lead(x) OVER (PARTITION BY route ORDER BY seq) AS nx, lead(y) OVER (PARTITION BY route ORDER BY seq) AS ny FROM vertices) WHERE nx IS NOT NULL)"


@query(
    role_sql("vertices")
    + SEGMENTS
    + """, o AS (SELECT a.route, a.id, b.id AS o_id, a.ax, a.ay, a.ex, a.ey, b.ax AS cx, b.ay AS cy, b.ex AS dx, b.ey AS dy,
  sign((a.ex-a.ax)*(b.ay-a.ay)-(a.ey-a.ay)*(b.ax-a.ax)) AS o1, sign((a.ex-a.ax)*(b.ey-a.ay)-(a.ey-a.ay)*(b.ex-a.ax)) AS o2,
  sign((b.ex-b.ax)*(a.ay-b.ay)-(b.ey-b.ay)*(a.ax-b.ax)) AS o3, sign((b.ex-b.ax)*(a.ey-b.ay)-(b.ey-b.ay)*(a.ex-b.ax)) AS o4 FROM seg a JOIN seg b ON a.route = b.route AND a.id < b.id)
SELECT route, id, o_id FROM o WHERE (o1 <> o2 AND o3 <> o4)
 OR (o1 = 0 AND cx BETWEEN least(ax,ex) AND greatest(ax,ex) AND cy BETWEEN least(ay,ey) AND greatest(ay,ey))
 OR (o2 = 0 AND dx BETWEEN least(ax,ex) AND greatest(ax,ex) AND dy BETWEEN least(ay,ey) AND greatest(ay,ey))
 OR (o3 = 0 AND ax BETWEEN least(cx,dx) AND greatest(cx,dx) AND ay BETWEEN least(cy,dy) AND greatest(cy,dy))
 OR (o4 = 0 AND ex BETWEEN least(cx,dx) AND greatest(cx,dx) AND ey BETWEEN least(cy,dy) AND greatest(cy,dy))"""
)
def segment_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of segments of one route that meet, through grid cells."""
    v = geometry.vertices_to_segments(role(spark, sf_dir, "vertices"), "route", "seq")
    seg = v.select("route", F.col("seq").alias("id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("nx").alias("bx"), F.col("ny").alias("by"))
    return topology.segment_crossings(seg, 500, group=["route"])


@query(
    role_sql("links")
    + """, walk(node, cur, path, ended) AS (
  SELECT node, up, [node], CASE WHEN up IS NULL THEN 'ok' ELSE NULL END FROM links
  UNION ALL SELECT w.node, l.up, list_append(w.path, l.node), CASE WHEN l.node IS NULL THEN 'UPSTREAM_CHAIN_BROKEN' WHEN list_contains(w.path, l.node) THEN 'UPSTREAM_CYCLE' WHEN l.up IS NULL THEN 'ok' ELSE NULL END
  FROM walk w LEFT JOIN links l ON l.node = w.cur WHERE w.ended IS NULL
) SELECT node, ended AS code FROM walk WHERE ended IS NOT NULL AND ended <> 'ok'"""
)
def upstream_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken and cyclic upstream chains."""
    return topology.upstream_issues(role(spark, sf_dir, "links"))


@query(
    role_sql("links")
    + """, e AS (SELECT node AS a, up AS b FROM links WHERE up >= 0 AND valve <> 3), walk(node) AS (
  SELECT CAST(0 AS BIGINT) UNION SELECT CASE WHEN e.a = w.node THEN e.b ELSE e.a END FROM walk w JOIN e ON e.a = w.node OR e.b = w.node
) SELECT node FROM walk"""
)
def reachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: what the source reaches over undirected links."""
    links = role(spark, sf_dir, "links")
    edges = links.where("up >= 0 AND valve <> 3").select(F.col("node").alias("a"), F.col("up").alias("b"))
    return topology.reachable(edges, spark.createDataFrame([(0,)], "node long"))


@query(
    role_sql("links")
    + """, e AS (SELECT node AS a, up AS b FROM links WHERE up >= 0 AND valve <> 2), sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk(node, c) AS (
  SELECT node, node FROM links UNION SELECT b.b, w.c FROM walk w JOIN sym b ON b.a = w.node WHERE b.b > w.c
) SELECT node, min(c) AS component FROM walk GROUP BY node"""
)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components."""
    links = role(spark, sf_dir, "links")
    edges = links.where("up >= 0 AND valve <> 2").select(F.col("node").alias("a"), F.col("up").alias("b"))
    return topology.components(edges, links.select("node"))


@query(
    role_sql("chambers")
    + """, seg AS (SELECT a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey FROM chambers a JOIN chambers b ON b.chamber_id = a.chamber_id + 1),
h AS (SELECT c.chamber_id, CASE WHEN c.x = s.ax AND c.y = s.ay AND c.x = s.ex AND c.y = s.ey THEN 0 WHEN (c.x = s.ax AND c.y = s.ay) OR (c.x = s.ex AND c.y = s.ey) THEN 1
 WHEN (s.ex-s.ax)*(c.y-s.ay) = (s.ey-s.ay)*(c.x-s.ax) AND c.x BETWEEN least(s.ax,s.ex) AND greatest(s.ax,s.ex) AND c.y BETWEEN least(s.ay,s.ey) AND greatest(s.ay,s.ey) THEN 2 ELSE 0 END AS n FROM chambers c, seg s)
SELECT chamber_id, CAST(sum(n) AS BIGINT) AS incident FROM h GROUP BY chamber_id"""
)
def chamber_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions in use at every chamber."""
    c = role(spark, sf_dir, "chambers")
    nxt = c.select((F.col("chamber_id") - 1).alias("chamber_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    seg = c.join(nxt, "chamber_id").select(F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")
    return topology.incidence(c, seg, 10000)


@query(
    role_sql("points", "chambers")
    + """, n AS (SELECT * FROM (SELECT p.point_id, h.chamber_id, (p.x-h.x)*(p.x-h.x)+(p.y-h.y)*(p.y-h.y) AS distance, row_number() OVER (PARTITION BY p.point_id ORDER BY (p.x-h.x)*(p.x-h.x)+(p.y-h.y)*(p.y-h.y), h.chamber_id) AS k FROM points p, chambers h) WHERE k <= 40),
c AS (SELECT point_id, concat('t', CAST(chamber_id % 20 AS VARCHAR)) AS target_id, CASE WHEN chamber_id % 2 = 0 THEN 'heat_chamber' ELSE 'heat_network' END AS target_type, distance, chamber_id % 2 = 1 AS new_chamber, CAST(chamber_id % 40 AS DOUBLE) / 8 AS x FROM n),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id, target_type, target_id, floor(x*1000+0.5) ORDER BY distance, new_chamber, target_id) AS n FROM c) WHERE n = 1)
SELECT point_id, target_id, distance, new_chamber FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, new_chamber, target_id, x) AS r FROM f) WHERE r <= 12"""
)
def tie_in_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates deduplicated to the millimetre and ranked. What is a candidate depends on the place alone."""
    chambers = role(spark, sf_dir, "chambers")
    return topology.by_place(role(spark, sf_dir, "points"), lambda places: _tie_ins(topology.nearest(places, chambers, 40)))


def _tie_ins(near: DataFrame) -> DataFrame:
    k = F.col("chamber_id")
    c = near.select("point_id", F.concat(F.lit("t"), k % 20).alias("target_id"), F.when(k % 2 == 0, "heat_chamber").otherwise("heat_network").alias("target_type"), F.col("distance2").alias("distance"), (k % 2 == 1).alias("new_chamber"), ((k % 40).cast("double") / 8).alias("x"), F.lit(0.0).alias("y"))
    return topology.tie_in_candidates(c).select("point_id", "target_id", "distance", "new_chamber")


# ---- sizing -------------------------------------------------------------------------------------------------------
CLOSURE = """, up(node, ancestor, demand) AS (SELECT node, node, demand FROM tree UNION ALL SELECT u.node, t.up, u.demand FROM up u JOIN tree t ON t.node = u.ancestor WHERE t.up IS NOT NULL),
flows AS (SELECT ancestor AS node, CAST(sum(demand) AS DECIMAL(18,3)) AS flow FROM up GROUP BY ancestor)"""


@query(role_sql("tree") + CLOSURE + " SELECT node, CAST(flow AS DOUBLE) AS flow FROM flows")
def subtree_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand of each subtree."""
    return doubles(sizing.subtree_flow(role(spark, sf_dir, "tree")), "flow")


@query(role_sql("tree") + CLOSURE + " SELECT t.node, t.up, CAST(f.flow AS DOUBLE) AS flow FROM tree t JOIN flows f USING (node) WHERE t.up = 0")
def root_branch_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G19."""
    return doubles(sizing.root_branch_flows(role(spark, sf_dir, "tree")).select("node", "up", "flow"), "flow")


@query(role_sql("points") + " SELECT point_id % 100 AS node, CAST(sum(flow) AS DOUBLE) AS flow FROM points GROUP BY 1")
def demand_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2."""
    return doubles(sizing.demand_by_node(role(spark, sf_dir, "points").select((F.col("point_id") % 100).alias("node"), "flow")), "flow")


@query(role_sql("points") + f" SELECT point_id, CAST({DU % 'CAST(flow * 37 AS DECIMAL(18,3))'} AS BIGINT) AS diameter FROM points")
def diameter_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest pipe for a flow, without a join."""
    flow = (F.col("flow") * 37).cast(dims.FLOW)
    return role(spark, sf_dir, "points").select("point_id", dims.diameter_for(flow).cast("long").alias("diameter"))


CHAIN = ", chain AS (SELECT variant, edge, length, CAST(" + DU % "e.flow" + " AS BIGINT) AS diameter FROM variant_edges e)"


@query(
    role_sql("variant_edges")
    + CHAIN
    + """, r AS (SELECT *, sum(c) OVER (PARTITION BY variant ORDER BY edge) AS run FROM (SELECT *, CASE WHEN lag(diameter) OVER (PARTITION BY variant ORDER BY edge) = diameter THEN 0 ELSE 1 END AS c FROM chain))
SELECT variant, edge, diameter, CAST(sum(length) OVER (PARTITION BY variant, run ORDER BY edge) AS DOUBLE) AS continuous FROM r"""
)
def continuous_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length since the last change of diameter."""
    e = role(spark, sf_dir, "variant_edges").withColumn("diameter", dims.diameter_for(F.col("flow")).cast("long"))
    return doubles(sizing.continuous_length(e, "variant", "edge").select("variant", "edge", "diameter", "continuous"), "continuous")


@query(role_sql("variant_edges") + CHAIN + ", ends AS (SELECT e.up_node AS node, c.diameter FROM variant_edges e JOIN chain c USING (variant, edge) UNION ALL SELECT e.down_node, c.diameter FROM variant_edges e JOIN chain c USING (variant, edge)) SELECT CAST(node AS BIGINT) AS node, max(diameter) AS diameter FROM ends GROUP BY node")
def chamber_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest diameter at each node."""
    e = role(spark, sf_dir, "variant_edges").withColumn("diameter", dims.diameter_for(F.col("flow")))
    return longs(sizing.chamber_diameter(e), "node", "diameter")


#: Smallest pipe of an edge: it carries the flow, is no smaller than the pipes below, and its run of one diameter keeps to the limit.
SIZED = "(SELECT min(p.diameter) FROM " + P + " p WHERE p.max_flow >= %s AND p.diameter >= %s AND %s <= p.max_length)"


@query(
    role_sql("forest")
    + f""", n AS (SELECT network, node, CAST(floor(node / 2) AS BIGINT) AS up, length, flow AS own FROM forest),
l4 AS (SELECT *, {SIZED % ("own", "0", "length")} AS du, own AS flow, length AS run FROM n WHERE node >= 4),
l2 AS (SELECT *, {SIZED % ("flow", "greatest(d1, d2)", "length + greatest(CASE WHEN d1 = p.diameter THEN r1 ELSE 0 END, CASE WHEN d2 = p.diameter THEN r2 ELSE 0 END)")} AS du FROM (
  SELECT n.network, n.node, n.up, n.length, n.own + coalesce(a.flow, 0) + coalesce(b.flow, 0) AS flow, coalesce(a.du, 0) AS d1, coalesce(b.du, 0) AS d2, coalesce(a.run, 0) AS r1, coalesce(b.run, 0) AS r2
  FROM n LEFT JOIN l4 a ON a.network = n.network AND a.node = n.node * 2 LEFT JOIN l4 b ON b.network = n.network AND b.node = n.node * 2 + 1 WHERE n.node IN (2, 3))),
m2 AS (SELECT *, length + greatest(CASE WHEN d1 = du THEN r1 ELSE 0 END, CASE WHEN d2 = du THEN r2 ELSE 0 END) AS run FROM l2),
l1 AS (SELECT *, {SIZED % ("flow", "greatest(d1, d2)", "length + greatest(CASE WHEN d1 = p.diameter THEN r1 ELSE 0 END, CASE WHEN d2 = p.diameter THEN r2 ELSE 0 END)")} AS du FROM (
  SELECT n.network, n.node, n.up, n.length, n.own + coalesce(a.flow, 0) + coalesce(b.flow, 0) AS flow, coalesce(a.du, 0) AS d1, coalesce(b.du, 0) AS d2, coalesce(a.run, 0) AS r1, coalesce(b.run, 0) AS r2
  FROM n LEFT JOIN m2 a ON a.network = n.network AND a.node = 2 LEFT JOIN m2 b ON b.network = n.network AND b.node = 3 WHERE n.node = 1)),
s AS (SELECT network, node, up, length, flow, du FROM l4 UNION ALL SELECT network, node, up, length, flow, du FROM m2 UNION ALL SELECT network, node, up, length, flow, du FROM l1)
SELECT s.network, s.node, CAST(s.flow AS DOUBLE) AS flow, CAST(s.du AS BIGINT) AS diameter,
  CAST(s.length + CASE WHEN u.du = s.du THEN u.length + CASE WHEN v.du = s.du THEN v.length ELSE 0 END ELSE 0 END AS DOUBLE) AS continuous
FROM s LEFT JOIN s u ON u.network = s.network AND u.node = s.up LEFT JOIN s v ON v.network = s.network AND v.node = u.up"""
)
def size_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diameters of many trees by dynamic programming, each tree found by its root."""
    t = cut(role(spark, sf_dir, "forest").withColumns({"id": F.col("network") * 10 + F.col("node"), "above": F.when(F.col("node") > 1, F.col("network") * 10 + F.floor(F.col("node") / 2))}))
    roots = sizing.networks_by_root(t.select("network", F.col("id").alias("node"), F.col("above").alias("up")), "network")
    named = cut(t.join(roots.withColumnsRenamed({"node": "id", "network": "root"}), "id"))
    edges = named.select(F.col("root").alias("network"), F.col("id").alias("edge"), F.coalesce("above", F.lit(-1)).alias("up"), F.col("id").alias("down"), "length")
    demand = named.select(F.col("root").alias("network"), F.col("id").alias("node"), "flow")
    sized = sizing.size_networks(edges, demand).where("issue IS NULL")
    return longs(doubles(sized.select(F.floor(F.col("edge").cast("long") / 10).alias("network"), (F.col("edge").cast("long") % 10).alias("node"), "flow", "diameter", "continuous"), "flow", "continuous"), "diameter")


@query(
    role_sql("tree")
    + CLOSURE
    + f""", above AS (SELECT node, ancestor FROM up), line AS (SELECT u.node, sum(t.length) AS far FROM above u JOIN tree t ON t.node = u.ancestor GROUP BY u.node),
nxt AS (SELECT t.node, CASE WHEN f.flow = g.flow THEN t.up END AS up FROM tree t JOIN flows f USING (node) LEFT JOIN flows g ON g.node = t.up),
w(node, cur) AS (SELECT node, node FROM nxt UNION ALL SELECT w.node, n.up FROM w JOIN nxt n ON n.node = w.cur WHERE n.up IS NOT NULL),
head AS (SELECT w.node, w.cur AS head FROM w JOIN nxt n ON n.node = w.cur WHERE n.up IS NULL),
section AS MATERIALIZED (SELECT h.head, max(f.flow) AS flow, max(l.far) AS bottom, any_value(s.far - t.length) AS top FROM head h JOIN flows f USING (node) JOIN line l USING (node) JOIN tree t ON t.node = h.head JOIN line s ON s.node = h.head GROUP BY h.head),
below AS MATERIALIZED (SELECT DISTINCT b.head AS over, a.head FROM above u JOIN head a ON a.node = u.node JOIN head b ON b.node = u.ancestor),
pipe AS (SELECT *, row_number() OVER (ORDER BY diameter) AS n FROM {P}),
stage(k, head, du, long) AS (
  SELECT CAST(0 AS BIGINT), head, CAST(NULL AS INTEGER), false FROM section
  UNION ALL
  SELECT s.k + 1, s.head, CASE WHEN s.du IS NULL AND c.flow <= p.max_flow AND (r.far - c.top <= p.max_length OR p.n = 18) THEN p.diameter ELSE s.du END,
         s.long OR (s.du IS NULL AND c.flow <= p.max_flow AND p.n = 18 AND r.far - c.top > p.max_length)
  FROM stage s JOIN pipe p ON p.n = s.k + 1 JOIN section c ON c.head = s.head
  LEFT JOIN (SELECT b.over, max(c2.bottom) AS far FROM below b JOIN stage s2 ON s2.head = b.head AND s2.du IS NULL JOIN section c2 ON c2.head = b.head GROUP BY b.over) r ON r.over = s.head),
done AS (SELECT h.node, t.length, s.du, s.long AND h.node = h.head AS long FROM head h JOIN stage s ON s.head = h.head AND s.k = 18 JOIN tree t ON t.node = h.node)
SELECT d.node, CAST(any_value(f.flow) AS DOUBLE) AS flow, CAST(any_value(d.du) AS BIGINT) AS diameter, CAST(sum(a.length) FILTER (WHERE a.du IS NOT DISTINCT FROM d.du) AS DOUBLE) AS continuous,
       CASE WHEN any_value(d.du) IS NULL THEN 'FLOW_EXCEEDS_CATALOG' WHEN any_value(d.long) THEN 'MAX_CONTINUOUS_LENGTH_EXCEEDED' END AS issue
FROM done d JOIN flows f USING (node) JOIN above u ON u.node = d.node JOIN done a ON a.node = u.ancestor GROUP BY d.node"""
)
def size_one_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as one connected network, sized by joins over all of its edges; the SQL goes pipe by pipe instead."""
    t = role(spark, sf_dir, "tree")
    edges = t.select(F.lit("all").alias("network"), F.col("node").alias("edge"), F.coalesce("up", F.lit(-1)).alias("up"), F.col("node").alias("down"), "length")
    sized = sizing.size_networks(edges, t.select(F.lit("all").alias("network"), "node", F.col("demand").alias("flow")))
    return longs(doubles(sized.select(F.col("edge").cast("long").alias("node"), "flow", "diameter", "continuous", "issue"), "flow", "continuous"), "diameter")


@query(
    role_sql("tree")
    + CLOSURE
    + """, n AS (SELECT t.node, CASE WHEN f.flow = g.flow THEN t.up END AS nxt FROM tree t JOIN flows f USING (node) LEFT JOIN flows g ON g.node = t.up),
w(node, cur) AS (SELECT node, node FROM n UNION ALL SELECT w.node, n.nxt FROM w JOIN n ON n.node = w.cur WHERE n.nxt IS NOT NULL)
SELECT w.node, w.cur AS head FROM w JOIN n ON n.node = w.cur WHERE n.nxt IS NULL"""
)
def same_flow_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal flow down a tree."""
    t = role(spark, sf_dir, "tree")
    return sizing.same_flow_components(t, sizing.subtree_flow(t))


# ---- economics ----------------------------------------------------------------------------------------------------
PRICED = f""", priced AS (SELECT e.*, p.diameter, round(CAST(p.rate AS DECIMAL(12,0)) * e.length * CASE WHEN crossing = 'road' THEN CAST(1.60 AS DECIMAL(6,3)) WHEN crossing = 'base' THEN CAST(1.00 AS DECIMAL(6,3)) ELSE CAST(1.25 AS DECIMAL(6,3)) END, 2) AS cost
 FROM (SELECT *, {DU % 've.flow'} AS du FROM variant_edges ve) e LEFT JOIN {P} p ON p.diameter = e.du)"""
ECON = (
    PRICED
    + """, sums AS (SELECT variant, CAST(sum(cost) AS DECIMAL(38,2)) AS pipes, CAST(sum(length) AS DECIMAL(14,3)) AS length, count(*) FILTER (WHERE up_node = 0) AS tie_ins FROM priced GROUP BY variant),
ends AS (SELECT variant, up_node AS node, diameter FROM priced UNION ALL SELECT variant, down_node, diameter FROM priced),
ch AS (SELECT variant, sum(CASE WHEN d <= 200 THEN 3000000 WHEN d <= 500 THEN 5000000 WHEN d <= 1000 THEN 8000000 ELSE 12000000 END) AS chambers FROM (SELECT variant, node, max(diameter) AS d FROM ends GROUP BY variant, node HAVING count(*) >= 3) GROUP BY variant),
pen AS (SELECT variant, sum(CASE WHEN unconnected > 0 THEN 100000000 + 500000 * unconnected_flow ELSE 0 END) AS penalty FROM variants GROUP BY variant),
econ AS (SELECT s.*, coalesce(ch.chambers, 0) AS chambers, coalesce(pen.penalty, 0) AS penalty, CAST(s.pipes + coalesce(ch.chambers, 0) + s.tie_ins * 5000000 AS DECIMAL(30,2)) AS construction FROM sums s LEFT JOIN ch USING (variant) LEFT JOIN pen USING (variant)),
scored AS (SELECT *, CAST(construction + penalty AS DECIMAL(30,2)) AS cost FROM econ)"""
)
@query(role_sql("variant_edges") + PRICED + " SELECT variant, edge, CAST(diameter AS BIGINT) AS diameter, CAST(cost AS DOUBLE) AS cost FROM priced")
def edge_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge costs with the largest crossing multiplier, rounded one by one."""
    e = economics.price_edges(role(spark, sf_dir, "variant_edges"), dims.pipes(spark))
    return longs(doubles(e.select("variant", "edge", "diameter", "cost"), "cost"), "diameter")


def _economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return economics.variant_economics(role(spark, sf_dir, "variant_edges"), role(spark, sf_dir, "variants"), dims.pipes(spark), F.col("up_node") == 0)


@query(role_sql("variant_edges", "variants") + ECON + " SELECT variant, CAST(pipes AS DOUBLE) AS pipes, CAST(chambers AS DOUBLE) AS chambers, tie_ins, CAST(penalty AS DOUBLE) AS penalty, CAST(cost AS DOUBLE) AS cost, CAST(length AS DOUBLE) AS length FROM scored")
def variant_economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost parts of every variant."""
    names = ["pipes", "chambers", "penalty", "cost", "length"]
    return doubles(_economics(spark, sf_dir).select("variant", "tie_ins", *names), *names)


@query(role_sql("variant_edges", "variants") + ECON + " SELECT variant, CAST(floor((CAST(cost AS DECIMAL(28,2)) * 28 + CAST(length AS DECIMAL(28,3)) * 3000000) / 1000000) AS BIGINT) AS score_band FROM scored")
def variant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.7 * cost / 25 million + 0.3 * length / 100, compared at the sixth digit, cut."""
    return _economics(spark, sf_dir).select("variant", F.floor(F.col("score") * 1_000_000 / 1000).cast("long").alias("score_band"))


@query(
    role_sql("variant_edges", "variants")
    + ECON
    + """, s AS (SELECT variant, variant % 97 AS hash, variant % 20 AS grp, cost, length, cost * 28 + length * 3000000 AS score FROM scored),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, hash ORDER BY score, cost, length, variant) AS b FROM s) WHERE b = 1)
SELECT grp, variant, place FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score, cost, length, variant) AS place FROM k) WHERE place <= 8"""
)
def solution_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best variants of each group after deduplication by geometry hash."""
    v = _economics(spark, sf_dir).withColumns({"hash": F.col("variant") % 97, "grp": F.col("variant") % 20})
    v = v.withColumn("score", F.col("cost") * 28 + F.col("length") * 3_000_000)
    return longs(economics.archive(v, "hash", group="grp").select("grp", "variant", "place"), "place")


@query(
    role_sql("variant_edges", "variants")
    + ECON
    + """, v AS (SELECT variant, variant % 50 AS grp, variant % 3 AS coverage, variant % 7 AS bends, cost, length, cost * 28 + length * 3000000 AS score FROM scored),
m AS (SELECT * FROM (SELECT *, max(coverage) OVER (PARTITION BY grp) AS most FROM v) WHERE coverage = most),
l AS (SELECT grp, length AS ll, cost AS lc FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY length, cost, variant) AS r FROM m) WHERE r = 1),
n AS (SELECT m.*, length <= ll + 10 AND length <= ll * 1.30 AND cost <= lc + 1250000 AS near FROM m JOIN l USING (grp)),
b AS (SELECT grp, variant FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score, cost, length, variant) AS r FROM n) WHERE r = 1),
s AS (SELECT grp, variant FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY bends, length, cost, variant) AS r FROM n WHERE near) WHERE r = 1),
c AS (SELECT grp, variant FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY cost, length, variant) AS r FROM n) WHERE r = 1)
SELECT b.grp, b.variant AS balanced, s.variant AS shortest, c.variant AS cheapest FROM b JOIN s USING (grp) JOIN c USING (grp)"""
)
def role_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced, shortest and cheapest variant of each group."""
    k = F.col("variant")
    v = _economics(spark, sf_dir).withColumns({"grp": k % 50, "coverage": k % 3, "bends": k % 7, "score": F.col("cost") * 28 + F.col("length") * 3_000_000})
    return economics.pick_roles(v, "grp")


@query(role_sql("variant_edges") + PRICED + " SELECT variant, edge, CAST(cost AS DOUBLE) AS cost, cost > 100000000 + 500000 * flow AS skip FROM priced")
def cheaper_to_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N10."""
    return doubles(economics.cheaper_to_skip(economics.price_edges(role(spark, sf_dir, "variant_edges"), dims.pipes(spark))).select("variant", "edge", "cost", "skip"), "cost")


@query(role_sql("variant_edges") + f", e AS (SELECT *, 80 AS has, {DU % 'v.flow'} AS need FROM variant_edges v) SELECT variant, edge, CAST(need AS BIGINT) AS needed, CAST(round(p.rebuild_rate * e.length, 2) AS DOUBLE) AS cost FROM e JOIN {P} p ON p.diameter = e.need WHERE need > has")
def rebuild_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N8."""
    e = role(spark, sf_dir, "variant_edges").withColumn("diameter", F.lit(80))
    return longs(doubles(economics.rebuild_cost(e, dims.pipes(spark)).select("variant", "edge", "needed", "cost"), "cost"), "needed")


# Windows that number islands order equal intervals by a key: the second window could otherwise take the later of them first.
# ---- intervals ----------------------------------------------------------------------------------------------------
@query(
    role_sql("spans")
    + """, m AS (SELECT route, span, s, e, CASE WHEN s <= max(e) OVER (PARTITION BY route ORDER BY s, e, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM spans),
i AS (SELECT *, sum(n) OVER (PARTITION BY route ORDER BY s, e, span ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT route, min(s) AS s, max(e) AS e FROM i GROUP BY route, k"""
)
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    return intervals.merge_intervals(role(spark, sf_dir, "spans"))


@query(
    role_sql("spans")
    + """, c AS (SELECT DISTINCT route, t AS a FROM (SELECT route, s AS t FROM spans UNION ALL SELECT route, e FROM spans)), p AS (SELECT * FROM (SELECT route, a, lead(a) OVER (PARTITION BY route ORDER BY a) AS b FROM c) WHERE b IS NOT NULL)
SELECT p.route, p.a, p.b, count(o.span) AS active FROM p LEFT JOIN spans o ON o.route = p.route AND (p.a + p.b) / 2 BETWEEN o.s AND o.e GROUP BY p.route, p.a, p.b"""
)
def elementary_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans over each elementary piece."""
    s = role(spark, sf_dir, "spans")
    return intervals.covering(intervals.elementary(s), s).groupBy("route", "a", "b").agg(F.count("span").alias("active"))


LENGTHS = ", lens AS (SELECT route, CAST(max(e) - 5 AS BIGINT) AS length FROM spans GROUP BY route)"
SECTIONS = LENGTHS + """, ins AS (SELECT o.route, greatest(s, 0) AS s, least(e, length) AS e, type FROM spans o JOIN lens USING (route) WHERE greatest(s, 0) < least(e, length)),
c AS (SELECT DISTINCT route, t AS a FROM (SELECT route, s AS t FROM ins UNION ALL SELECT route, e FROM ins UNION ALL SELECT route, 0 FROM lens UNION ALL SELECT route, length FROM lens)),
p AS (SELECT * FROM (SELECT route, a, lead(a) OVER (PARTITION BY route ORDER BY a) AS b FROM c) WHERE b IS NOT NULL),
sec AS (SELECT p.route, p.a, p.b, coalesce(string_agg(DISTINCT o.type, '+' ORDER BY o.type), '') AS types FROM p LEFT JOIN ins o ON o.route = p.route AND (p.a + p.b) / 2 BETWEEN o.s AND o.e GROUP BY p.route, p.a, p.b)"""


def _lengths(s: DataFrame) -> DataFrame:
    return s.groupBy("route").agg((F.max("e") - 5).cast("long").alias("length"))


@query(role_sql("spans") + SECTIONS + " SELECT route, a, b, types, CASE WHEN types = '' THEN 'base' ELSE 'special' END AS method FROM sec")
def route_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and special sections."""
    s = role(spark, sf_dir, "spans")
    return intervals.sections(s, _lengths(s)).select("route", "a", "b", "types", "method")


@query(role_sql("spans") + SECTIONS + """, g AS (SELECT *, sum(n) OVER (PARTITION BY route ORDER BY a ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN lag(types) OVER (PARTITION BY route ORDER BY a) = types AND lag(b) OVER (PARTITION BY route ORDER BY a) = a THEN 0 ELSE 1 END AS n FROM sec))
SELECT route, types, min(a) AS a, max(b) AS b FROM g GROUP BY route, types, k""")
def merged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring equal sections."""
    s = role(spark, sf_dir, "spans")
    return intervals.merge_equal(intervals.sections(s, _lengths(s))).select("route", "types", "a", "b")


@query(
    role_sql("spans")
    + LENGTHS
    + """, x AS (SELECT route, s, e FROM spans UNION ALL SELECT route, length, length FROM lens), g AS (SELECT route, s, coalesce(max(e) OVER (PARTITION BY route ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM x)
SELECT g.route, g.a, least(g.s, l.length) AS b FROM g JOIN lens l USING (route) WHERE g.a < least(g.s, l.length)"""
)
def uncovered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complement of the covered intervals."""
    s = role(spark, sf_dir, "spans")
    return intervals.complement(s, _lengths(s))


def _merged_sql(name: str, where: str) -> str:
    return f"{name} AS (SELECT route, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY route ORDER BY s, e, span ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY route ORDER BY s, e, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM spans WHERE {where})) GROUP BY route, k)"


@query(role_sql("spans") + ", " + _merged_sql("l", "span % 2 = 0") + ", " + _merged_sql("r", "span % 2 = 1") + " SELECT l.route, greatest(l.s, r.s) AS s, least(l.e, r.e) AS e FROM l JOIN r USING (route) WHERE greatest(l.s, r.s) <= least(l.e, r.e)")
def domain_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O11."""
    s = role(spark, sf_dir, "spans").select("route", "span", "s", "e")
    return intervals.intersect_domains(s.where("span % 2 = 0").drop("span"), s.where("span % 2 = 1").drop("span"))


@query(role_sql("variant_edges") + " SELECT variant, edge, CAST(sum(length) OVER w - length AS DOUBLE) AS start_station, CAST(sum(length) OVER w AS DOUBLE) AS end_station FROM variant_edges WINDOW w AS (PARTITION BY variant ORDER BY edge ROWS UNBOUNDED PRECEDING)")
def route_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    return doubles(intervals.stations(role(spark, sf_dir, "variant_edges"), "variant", "edge").select("variant", "edge", "start_station", "end_station"), "start_station", "end_station")


PROFILE = ", prof AS (SELECT route, CAST(seq * 100 AS BIGINT) AS station, CAST(1 + x % 7 AS DOUBLE) AS depth FROM vertices)"


def _profile(spark, sf_dir):
    return role(spark, sf_dir, "vertices").select("route", (F.col("seq") * 100).cast("long").alias("station"), (1 + F.col("x") % 7).cast("double").alias("depth"))


@query(
    role_sql("vertices")
    + PROFILE
    + """, q AS (SELECT DISTINCT route, CAST(150 + route % 3 * 100 AS BIGINT) AS q FROM prof), l AS (SELECT *, lead(station) OVER w AS ns, lead(depth) OVER w AS nd, row_number() OVER w AS leg FROM prof WINDOW w AS (PARTITION BY route ORDER BY station))
SELECT route, q, CAST(floor((depth + (nd - depth) * (CAST(q - station AS DOUBLE) / (ns - station))) * 1000 + 0.5) AS BIGINT) AS depth_mm FROM (SELECT *, row_number() OVER (PARTITION BY l.route, q ORDER BY leg) AS r FROM l JOIN q USING (route) WHERE q BETWEEN station AND ns) WHERE r = 1"""
)
def depth_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated depth at stations."""
    p = _profile(spark, sf_dir)
    q = p.select("route", (150 + F.col("route") % 3 * 100).cast("long").alias("q")).distinct()
    return intervals.value_at(p, q).select("route", "q", geometry.half_up(F.col("depth")).alias("depth_mm"))


@query(role_sql("vertices") + PROFILE + " SELECT route, CAST(floor(sum((depth + nd) / 2 * (ns - station)) / sum(ns - station) * 1000 + 0.5) AS BIGINT) AS mean_mm FROM (SELECT *, lead(station) OVER w AS ns, lead(depth) OVER w AS nd FROM prof WINDOW w AS (PARTITION BY route ORDER BY station)) WHERE ns IS NOT NULL GROUP BY route")
def mean_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G13."""
    return intervals.mean_depth(_profile(spark, sf_dir)).select("route", geometry.half_up(F.col("depth")).alias("mean_mm"))


@query(
    role_sql("vertices")
    + PROFILE
    + """, l AS (SELECT *, lead(station) OVER w AS ns, lead(depth) OVER w AS nd FROM prof WINDOW w AS (PARTITION BY route ORDER BY station))
SELECT route, CAST(floor(st * 1000 + 0.5) AS BIGINT) AS station_mm FROM (SELECT route, CAST(station AS DOUBLE) AS st FROM prof UNION SELECT route, station + (ns - station) * (3 - depth) / (nd - depth) FROM l WHERE (depth - 3) * (nd - 3) < 0)"""
)
def cost_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z6."""
    return intervals.cost_breakpoints(_profile(spark, sf_dir)).select("route", geometry.half_up(F.col("station")).alias("station_mm"))
