"""Route and export validation: issue rows from windows, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import bend_distance
from ..functions.geometry import acute_angle, angle_between, compatible_rays, satisfies_least_angle, turn_allowed, turn_tolerance, vertices_to_segments
from .topology import segment_crossings

MAX_CHAMBER_EDGES = 4
LEAST_SECTION_M = 10.0
#: Fields of the output contract.
OUTPUT_FIELDS = {
    "heat_network": ["id", "object_type", "variant_id", "start_node_id", "end_node_id", "flow_tph", "diameter", "length", "laying_method", "cost"],
    "heat_chamber": ["id", "object_type", "variant_id", "diameter", "cost"],
    "technical_node": ["id", "object_type", "variant_id"],
    "variant_summary": ["id", "object_type", "variant_id", "rank", "construction_cost", "chamber_construction_cost", "existing_chamber_tie_in_count", "existing_chamber_tie_in_cost", "unconnected_penalty", "calculated_cost", "new_network_length", "score", "unconnected_oks_ids"],
}
OPTIONAL_FIELDS = {"heat_network": ["depth_start", "depth_end"]}


def turn_issues(vertices: DataFrame, least_turn: float = 60.0) -> DataFrame:
    """Vertices whose turn is neither straight nor in the allowed band."""
    segments = vertices_to_segments(vertices, "route", "seq")
    w = Window.partitionBy("route").orderBy("seq")
    judged = segments.withColumn("before", F.lag("length").over(w))
    return judged.where(F.col("turn").isNotNull() & (F.col("length") > 0) & (F.col("before") > 0) & ~turn_allowed(F.col("turn"), turn_tolerance(F.col("length"), F.col("before")), least_turn)).select("route", "seq", F.lit("ROUTE_TURN").alias("code"))


def bend_spacing_issues(vertices: DataFrame, diameters: DataFrame) -> DataFrame:
    """Neighbouring bends closer than the diameter's least distance: running stations, then a lag over the bends only. A
    repeated vertex is no bend."""
    segments = vertices_to_segments(vertices, "route", "seq")
    w = Window.partitionBy("route").orderBy("seq")
    stationed = segments.withColumns({"station": F.sum("length").over(w) - F.col("length"), "before": F.lag("length").over(w)}).where("turn > 0.5 AND length > 0 AND before > 0")
    spaced = stationed.withColumn("gap", F.col("station") - F.lag("station").over(w)).join(diameters, "route")
    return spaced.where(F.col("gap") < bend_distance(F.col("diameter")) - 1e-7).select("route", "seq", F.lit("BEND_SPACING").alias("code"))


def self_intersections(vertices: DataFrame, cell: float) -> DataFrame:
    """Routes with a pair of segments that meet though they are not neighbours."""
    segments = vertices_to_segments(vertices, "route", "seq").where("length > 0")
    named = segments.select("route", F.col("seq").alias("id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("nx").alias("bx"), F.col("ny").alias("by"))
    return segment_crossings(named, cell, group=["route"]).where(F.abs(F.col("id") - F.col("o_id")) > 1).select("route").distinct()


def degree_issues(edges: DataFrame, existing: DataFrame, chambers: DataFrame) -> DataFrame:
    """CHAMBER_DEGREE: over four directions at a node, existing ones (node, incident) included;
    BRANCH_WITHOUT_CHAMBER: three edges or more at a node that is no chamber (node)."""
    ends = edges.select("variant", F.explode(F.array("up_node", "down_node")).alias("node"))
    degree = ends.groupBy("variant", "node").agg(F.count("*").alias("new")).join(existing, "node", "left").join(chambers.withColumn("chamber", F.lit(True)), "node", "left")
    total = F.col("new") + F.coalesce("incident", F.lit(0))
    codes = F.array_compact(F.array(F.when(total > MAX_CHAMBER_EDGES, "CHAMBER_DEGREE"), F.when((F.col("new") >= 3) & F.col("chamber").isNull(), "BRANCH_WITHOUT_CHAMBER")))
    return degree.select("variant", "node", F.explode(codes).alias("code"))


def ray_issues(rays: DataFrame) -> DataFrame:
    """Chambers with two rays (node, ray, dx, dy) that are neither at a right angle nor opposite. A chamber has four rays
    at most, so its pairs are few; each node's rays are paired inside one array, without a self-join."""
    grouped = rays.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("ray", "dx", "dy"))).alias("r"))
    left = grouped.select("node", "r", F.posexplode("r").alias("i", "a"))
    pairs = left.select("node", "a", F.explode(F.slice("r", F.col("i") + 2, F.size("r"))).alias("b"))
    return pairs.where(~compatible_rays(F.col("a.dx"), F.col("a.dy"), F.col("b.dx"), F.col("b.dy"))).select("node", F.col("a.ray").alias("ray"), F.col("b.ray").alias("other"), F.lit("CHAMBER_RAYS").alias("code"))


def short_sections(edges: DataFrame, chambers: DataFrame, least: float = LEAST_SECTION_M) -> DataFrame:
    """Edges between two chambers below the least length; ``least=0`` switches the rule off."""
    up, down = chambers.select(F.col("node").alias("up_node")), chambers.select(F.col("node").alias("down_node"))
    return edges.join(up, "up_node", "left_semi").join(down, "down_node", "left_semi").where(F.col("length") < least)


def multiple_upstream(edges: DataFrame) -> DataFrame:
    """variant, node: nodes that more than one upstream node feeds."""
    return edges.groupBy("variant", F.col("down_node").alias("node")).agg(F.countDistinct("up_node").alias("n")).where("n > 1").select("variant", "node")


def crossing_angle_issues(crossings: DataFrame) -> DataFrame:
    """Crossings (id, ux, uy, vx, vy, least) below their type's least angle, with the angle in thousandths of a degree."""
    angle = acute_angle(*map(F.col, ("ux", "uy", "vx", "vy")))
    out = crossings.withColumn("angle", angle)
    return out.where(~satisfies_least_angle(F.col("angle"), F.col("least"))).select("id", F.floor(F.col("angle") * 1000 + 0.5).cast("long").alias("angle_milli"))


def road_crossing_issues(crossings: DataFrame) -> DataFrame:
    """Codes of road and tram crossings (id, angle, least, straight, before, after, extension, parallel, clearance):
    NOT_STRAIGHT, ANGLE, EXTENSION_BEFORE, EXTENSION_AFTER, PARALLEL_CLEARANCE."""
    c = F.col
    codes = F.array_compact(F.array(F.when(~c("straight"), "NOT_STRAIGHT"), F.when(~satisfies_least_angle(c("angle"), c("least")), "ANGLE"), F.when(c("before") < c("extension"), "EXTENSION_BEFORE"), F.when(c("after") < c("extension"), "EXTENSION_AFTER"), F.when(c("parallel") < c("clearance"), "PARALLEL_CLEARANCE")))
    return crossings.select("id", F.explode(codes).alias("code"))


def quality(vertices: DataFrame) -> DataFrame:
    """Per route: bends, bends outside 90 to 120 degrees inside, summed deviation from that band in thousandths of a degree."""
    segments = vertices_to_segments(vertices, "route", "seq")
    w = Window.partitionBy("route").orderBy("seq")
    bends = segments.withColumn("before", F.lag("length").over(w)).where("turn > 0.5 AND length > 0 AND before > 0")
    inner = 180 - F.col("turn")
    deviation = F.greatest(F.lit(0.0), 90 - inner, inner - 120)
    found = bends.groupBy("route").agg(F.count("*").alias("bends"), F.count_if(deviation > 0.5).alias("invalid"), F.sum(F.floor(deviation * 1000 + 0.5)).cast("long").alias("deviation_milli"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return segments.select("route").distinct().join(found, "route", "left").select("route", zero("bends"), zero("invalid"), zero("deviation_milli"))


def junction_angles(rays: DataFrame) -> DataFrame:
    """Least angle between any two rays of each node, in degrees: sort by bearing, then neighbours."""
    bearing = F.degrees(F.atan2(F.col("dy").cast("double"), F.col("dx").cast("double")))
    w = Window.partitionBy("node").orderBy("bearing", "ray")
    turned = rays.withColumn("bearing", bearing).withColumns({"next": F.lead("bearing").over(w), "first": F.first("bearing").over(w), "n": F.count("*").over(Window.partitionBy("node"))}).where("n > 1")
    gap = F.coalesce(F.col("next") - F.col("bearing"), F.col("first") + 360 - F.col("bearing"))
    return turned.groupBy("node").agg(F.min(F.least(gap, 360 - gap)).alias("least"))


def contract_issues(features: DataFrame) -> DataFrame:
    """Output features (row, object_type, id, variant_id, fields: array of names, start_node_id, end_node_id): unknown
    types, missing and foreign fields, repeated ids, unresolved nodes, variants without exactly one summary."""
    known = F.create_map(*[x for t, names in OUTPUT_FIELDS.items() for x in (F.lit(t), F.array(*map(F.lit, names)))])
    extra = F.create_map(*[x for t in OUTPUT_FIELDS for x in (F.lit(t), F.array(*[F.lit(n) for n in OUTPUT_FIELDS[t] + OPTIONAL_FIELDS.get(t, [])]))])
    required, allowed = known[F.col("object_type")], extra[F.col("object_type")]
    codes = F.array_compact(F.array(F.when(required.isNull(), "OBJECT_TYPE"), F.when(F.size(F.array_except(required, "fields")) > 0, "MISSING_FIELD"), F.when(F.size(F.array_except("fields", allowed)) > 0, "FOREIGN_FIELD")))
    row = features.select("row", F.explode(codes).alias("code"))
    repeated = features.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("row"))).where("n > 1").select("row", F.lit("REPEATED_ID").alias("code"))
    nodes = features.where("object_type IN ('heat_chamber', 'technical_node')").select(F.col("id").alias("node")).distinct()
    ends = features.where("object_type = 'heat_network'").select("row", F.explode(F.array("start_node_id", "end_node_id")).alias("node"))
    lost = ends.join(nodes, "node", "left_anti").select("row", F.lit("UNRESOLVED_NODE").alias("code")).distinct()
    summary = features.groupBy("variant_id").agg(F.min("row").alias("row"), F.count_if(F.col("object_type") == "variant_summary").alias("n")).where("n <> 1").select("row", F.lit("SUMMARY_COUNT").alias("code"))
    return row.unionByName(repeated).unionByName(lost).unionByName(summary)


def reconcile(parts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Variants whose parts (variant_id, cost) do not add up to the stored construction cost to the kopeck."""
    sums = parts.groupBy("variant_id").agg(F.sum("cost").alias("total"))
    return summaries.join(sums, "variant_id", "left").where(F.coalesce("total", F.lit(0)) != F.col("construction_cost")).select("variant_id")
