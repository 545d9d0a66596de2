"""From priced variants to outcomes and output features, and the rows that a published run gives out."""

from __future__ import annotations

from collections import Counter
from types import SimpleNamespace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import chamber_cost
from .economics import crossing_multiplier, price_edges, variant_economics
from .groups import SMALL, by_size, map_groups
from .lineage import cut
from .topology import CHAMBER_CAPACITY
from .trees import chase, from_ends


def node_degrees(edges: DataFrame) -> DataFrame:
    """variant, node, degree, diameter (the largest that meets the node)."""
    ends = edges.select("variant", F.explode(F.array("up_node", "down_node")).alias("node"), "diameter")
    return ends.groupBy("variant", "node").agg(F.count("*").alias("degree"), F.max("diameter").alias("diameter"))


def evaluate(edges: DataFrame, unconnected: DataFrame, pipes: DataFrame, roots) -> DataFrame:
    """variant, outcome, cost, length, score, rank: variants checked in the order of the plan. SIZING: an edge's flow exceeds the
    catalog. CHAMBERS: a node has more edges than a chamber takes. COVERAGE: a demand is not connected. DUPLICATE: a better variant
    has the same edges. ACCEPTED ones are ranked by score, cost, length and id within their number of edges."""
    priced = price_edges(edges, pipes)
    shape = F.sha2(F.concat_ws(";", F.array_sort(F.collect_list(F.concat_ws(",", "up_node", "down_node", "length")))), 256)
    sized = priced.groupBy("variant").agg(F.bool_or(F.col("diameter").isNull()).alias("oversized"), F.count("*").alias("edges"), shape.alias("shape"))
    crowded = node_degrees(priced).groupBy("variant").agg(F.max("degree").alias("degree"))
    open_demand = unconnected.groupBy("variant").agg(F.max("unconnected").alias("unconnected"))
    costs = variant_economics(edges, unconnected, pipes, roots).select("variant", "cost", "length", "score")
    rows = sized.join(crowded, "variant").join(costs, "variant").join(open_demand, "variant", "left")
    first = F.when(F.col("oversized"), "SIZING").when(F.col("degree") > CHAMBER_CAPACITY, "CHAMBERS").when(F.col("unconnected") > 0, "COVERAGE")
    order = ["cost", "length", "variant"]
    passed = rows.withColumn("outcome", first)
    twin = F.row_number().over(Window.partitionBy("shape", F.col("outcome").isNull()).orderBy(*order))
    judged = passed.withColumn("outcome", F.coalesce("outcome", F.when(twin > 1, "DUPLICATE").otherwise("ACCEPTED")))
    rank = F.row_number().over(Window.partitionBy("edges", "outcome").orderBy("score", *order))
    return judged.select("variant", "edges", "outcome", "cost", "length", "score", F.when(F.col("outcome") == "ACCEPTED", rank).alias("rank"))


def emit(edges: DataFrame, economics: DataFrame, pipes: DataFrame) -> DataFrame:
    """Output features of variants: object_type, id, variant_id, start_node_id, end_node_id, diameter, length, cost, fields. Pipes,
    chambers (three edges or more), technical nodes and one summary a variant; ids are ``variant:source``."""
    priced = price_edges(edges, pipes)
    name = lambda *parts: F.concat_ws(":", F.col("variant").cast("string"), *parts)
    node = lambda c: name(F.concat(F.lit("n"), F.col(c).cast("string")))
    none, text = F.lit(None).cast("decimal(38,2)"), F.lit(None).cast("string")
    pipe = priced.select(F.lit("heat_network").alias("object_type"), name(F.concat(F.lit("e"), F.col("edge").cast("string"))).alias("id"), F.col("variant").alias("variant_id"), node("up_node").alias("start_node_id"), node("down_node").alias("end_node_id"), "diameter", F.col("length").cast("decimal(14,3)").alias("length"), F.col("cost").cast("decimal(38,2)").alias("cost"))
    ends = node_degrees(priced)
    big = F.col("degree") >= 3
    nodes = ends.select(F.when(big, "heat_chamber").otherwise("technical_node").alias("object_type"), node("node").alias("id"), F.col("variant").alias("variant_id"), text.alias("start_node_id"), text.alias("end_node_id"), F.when(big, F.col("diameter")).alias("diameter"), F.lit(None).cast("decimal(14,3)").alias("length"), F.when(big, chamber_cost(F.col("diameter")).cast("decimal(38,2)")).otherwise(none).alias("cost"))
    summary = economics.select(F.lit("variant_summary").alias("object_type"), name(F.lit("summary")).alias("id"), F.col("variant").alias("variant_id"), text.alias("start_node_id"), text.alias("end_node_id"), F.lit(None).cast("int").alias("diameter"), F.col("length").cast("decimal(14,3)").alias("length"), F.col("construction").cast("decimal(38,2)").alias("cost"))
    return pipe.unionByName(nodes).unionByName(summary)


def payload(runs: DataFrame, variants: DataFrame, variant: str | None = None) -> DataFrame:
    """run_id, variant_id, rank, problem: what an export of each run gives out. A run that isn't completed, or whose stored
    parameters are not valid, gives one row that names the problem; ``variant`` picks one variant."""
    low, high = F.col("least_depth"), F.col("greatest_depth")
    bad = F.when(F.col("state") != "completed", "RUN_NOT_COMPLETED").when(~F.coalesce((low >= 0.7) & (low <= 3.0) & (high >= 3.0) & (high <= 50.0), F.lit(False)), "INVALID_PARAMETERS")
    judged = runs.select("run_id", bad.alias("problem"))
    chosen = variants if variant is None else variants.where(F.col("variant_id") == variant)
    given = judged.where("problem IS NULL").join(chosen, "run_id").select("run_id", "variant_id", "rank", "problem")
    return given.unionByName(judged.where("problem IS NOT NULL").select("run_id", F.lit(None).cast(chosen.schema["variant_id"].dataType).alias("variant_id"), F.lit(None).cast(chosen.schema["rank"].dataType).alias("rank"), "problem"))


def comparison(edges: DataFrame, pipes: DataFrame) -> DataFrame:
    """Metrics of each variant beside each other: edges, nodes, chambers, length, longest edge, cost of pipes."""
    priced = price_edges(edges, pipes)
    lines = priced.groupBy("variant").agg(F.count("*").alias("edges"), F.sum("length").alias("length"), F.max("length").alias("longest"), F.sum("cost").alias("pipes"))
    nodes = node_degrees(priced).groupBy("variant").agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") >= 3).alias("chambers"))
    return lines.join(nodes, "variant")


def recheck(stored: DataFrame, pipes: DataFrame) -> DataFrame:
    """variant, edge, code of stored edges (columns of edges, and stored_diameter, stored_cost) that no longer hold: DIAMETER_TOO_SMALL
    for the flow, LENGTH_EXCEEDED by one edge alone, COST_MISMATCH to the kopeck for the stored pipe."""
    catalog = F.broadcast(pipes.select(F.col("diameter").alias("stored_diameter"), "max_flow", "max_length", "rate"))  # the fixed catalog
    row = stored.join(catalog, "stored_diameter", "left").withColumn("due", F.round(F.col("rate") * F.col("length") * crossing_multiplier(F.col("crossing")), 2))
    codes = F.array_compact(F.array(F.when(F.coalesce(F.col("flow") > F.col("max_flow"), F.lit(True)), "DIAMETER_TOO_SMALL"), F.when(F.col("length") > F.col("max_length"), "LENGTH_EXCEEDED"), F.when(F.col("due") != F.col("stored_cost"), "COST_MISMATCH")))
    return row.select("variant", "edge", F.explode(codes).alias("code"))


def graph_integrity(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """network, nodes, edges, roots, leaves, branches, tree: shape of networks (network, up, down). A network is a tree if it has one
    root, every other node one upstream edge, and no cycle. Networks of up to ``small`` edges are each told in a task; in larger
    ones pointers from node to node tell at any depth."""
    lines = cut(edges.select("network", "up", "down"))
    few, many = by_size(lines, "network", small)

    def kernel(table: SimpleNamespace) -> list[tuple]:
        fed, gives, above = Counter(table.down), Counter(table.up), {}
        for up, down in zip(table.up, table.down, strict=True):
            known = above.get(down)
            above[down] = up if known is None else known if up is None else min(known, up)
        nodes = fed.keys() | gives.keys()
        roots = sum(n not in fed for n in nodes)
        tree = roots == 1 and max(fed.values()) <= 1 and len(from_ends(above)) == len(nodes) - 1
        branches = sum(fed[n] + gives[n] >= 3 for n in nodes)
        return [(table.network[0], len(nodes), len(table.down), roots, sum(n not in gives for n in nodes), branches, tree)]

    names = ["network", "nodes", "edges", "roots", "leaves", "branches", "tree"]
    kind = edges.schema["network"].dataType.simpleString()
    found = map_groups(few, "network", [], kernel, f"network {kind}, nodes long, edges long, roots long, leaves long, branches long, tree boolean", names, nulls=True)
    return found if many is None else found.unionByName(large_integrity(many))


def large_integrity(edges: DataFrame) -> DataFrame:
    """``graph_integrity`` of networks of any size, by joins over all edges."""
    key = lambda c: F.struct("network", F.col(c).alias("node"))
    ends = edges.select("network", F.col("up").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select("network", F.col("down").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    degree = ends.groupBy("network", "node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    shape = degree.groupBy("network").agg(F.count("*").alias("nodes"), F.sum("i").alias("edges"), F.count_if(F.col("i") == 0).alias("roots"), F.count_if(F.col("o") == 0).alias("leaves"), F.count_if(F.col("i") + F.col("o") >= 3).alias("branches"), F.max("i").alias("most"))
    up = edges.groupBy("network", "down").agg(F.min("up").alias("up")).select(key("down").alias("node"), key("up").alias("up"))
    reached = chase(up).select("node.network").groupBy("network").agg(F.count("*").alias("reached"))
    found = shape.join(reached, "network", "left")
    tree = (F.col("roots") == 1) & (F.col("most") <= 1) & (F.coalesce("reached", F.lit(0)) == F.col("nodes") - 1)
    return found.select("network", "nodes", "edges", "roots", "leaves", "branches", tree.alias("tree"))
