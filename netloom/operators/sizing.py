"""Flow roll-up, diameters and continuous lengths on forests of pipes.

A forest is a table of nodes with their upstream node; the edge of a node is
the pipe that feeds it. Roll-ups double their reach in every round, over all
trees at once (``trees``).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from ..functions.dims import DIAMETERS, FLOW, LENGTH, MAX_FLOW, MAX_LENGTH, diameter_for
from .groups import SMALL, by_size, map_groups
from .lineage import cut
from .trees import chase, chase_within, from_ends, met_by, subtree_max, subtree_sums


def demand_by_node(demands: DataFrame) -> DataFrame:
    return demands.groupBy("node").agg(F.sum("flow").cast(FLOW).alias("flow"))


def subtree_flow(tree: DataFrame) -> DataFrame:
    """node, flow: the demand of each node's subtree."""
    return subtree_sums(tree, "demand", FLOW).withColumnRenamed("total", "flow")


def root_branch_flows(tree: DataFrame) -> DataFrame:
    """Flow of every branch that leaves a root."""
    roots = tree.where("up IS NULL").select(F.col("node").alias("up"))
    return tree.join(roots, "up", "left_semi").select("node", "up").join(subtree_flow(tree), "node")


def same_flow_components(tree: DataFrame, flows: DataFrame) -> DataFrame:
    """node, head: the top node of the run of edges with equal flow that a node belongs to."""
    rows = tree.count()
    own = tree.select("node", "up").join(met_by(flows, rows), "node")
    above = flows.select(F.col("node").alias("up"), F.col("flow").alias("up_flow"))
    linked = own.join(met_by(above, rows), "up", "left").select("node", F.when(F.col("flow") == F.col("up_flow"), F.col("up")).alias("up"))
    return chase(linked).select("node", F.col("end").alias("head"))


def continuous_length(chain: DataFrame, route: str = "route", order: str = "seq") -> DataFrame:
    """Length since the diameter last changed, along chains of edges (route, seq, diameter, length)."""
    w = Window.partitionBy(route).orderBy(order)
    changed = F.when(F.lag("diameter").over(w) == F.col("diameter"), 0).otherwise(1)
    runs = chain.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w))
    return runs.withColumn("continuous", F.sum("length").over(Window.partitionBy(route, "run").orderBy(order))).drop("changed")


def chamber_diameter(edges: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """node, diameter: the largest diameter that meets a node, among new edges (up_node, down_node, diameter) and
    existing ones (node, diameter)."""
    ends = edges.select(F.explode(F.array("up_node", "down_node")).alias("node"), "diameter")
    if existing is not None:
        ends = ends.unionByName(existing.select("node", "diameter"))
    return ends.groupBy("node").agg(F.max("diameter").alias("diameter"))


def length_limit(diameter: Column) -> Column:
    """Longest run of a pipe; the catalog is folded into one CASE."""
    out = F.when(diameter == DIAMETERS[0], F.lit(MAX_LENGTH[DIAMETERS[0]]))
    for d in DIAMETERS[1:]:
        out = out.when(diameter == d, F.lit(MAX_LENGTH[d]))
    return out


def next_diameter(diameter: Column) -> Column:
    """The pipe after this one; null after the last."""
    out = F.when(diameter == DIAMETERS[0], DIAMETERS[1])
    for d, after in zip(DIAMETERS[1:], DIAMETERS[2:], strict=False):
        out = out.when(diameter == d, after)
    return out


def network_faults(edges: DataFrame, demands: DataFrame, rooted: DataFrame, rows: int = 0) -> DataFrame:
    """network, key, issue: what forbids sizing. ``rooted``: the edges (network, edge) from which a source is reached."""
    key = lambda name: F.col(name).cast("string").alias("key")
    repeated = edges.groupBy("network", "edge").count().where("count > 1").select("network", key("edge"), F.lit("DUPLICATE_EDGE_ID").alias("issue"))
    fed = edges.groupBy("network", "down").count().where("count > 1").select("network", key("down"), F.lit("MULTIPLE_UPSTREAM_EDGES").alias("issue"))
    invalid = demands.where("flow IS NULL OR flow < 0").select("network", key("node"), F.lit("INVALID_DEMAND_FLOW").alias("issue")).distinct()
    lost = edges.join(met_by(rooted, rows), ["network", "edge"], "left_anti").groupBy("network").agg(F.min("edge").alias("edge"))
    return repeated.unionByName(fed).unionByName(invalid).unionByName(lost.select("network", key("edge"), F.lit("NETWORK_CYCLE").alias("issue")))


def size_networks(edges: DataFrame, demands: DataFrame, small: int = SMALL) -> DataFrame:
    """network, edge, flow, diameter, continuous, issue of edges (network, edge, up, down, length) under demands (network, node,
    flow). Networks may be many or one of any size: those of up to ``small`` rows are each sized in a task
    (``size_network``), and larger ones by joins over all of their edges (``size_large``); the rules are the same."""
    none = lambda kind: F.lit(None).cast(kind)
    edge, node = edges.schema["edge"].dataType, edges.schema["down"].dataType
    lines = edges.select("network", F.lit(True).alias("pipe"), "edge", "up", F.col("down").alias("node"), F.col("length").cast(LENGTH).cast(FLOW).alias("amount"))
    rows = cut(lines.unionByName(demands.select("network", F.lit(False).alias("pipe"), none(edge).alias("edge"), none(node).alias("up"), "node", F.col("flow").cast(FLOW).alias("amount"))))
    plain = all(isinstance(rows.schema[c].dataType, IntegralType | StringType) for c in ("edge", "up", "node"))
    few, many = by_size(rows, "network", small) if plain else (rows.limit(0), rows)

    def kernel(table: SimpleNamespace) -> list[tuple]:
        pipes, asked = [], []
        for pipe, e, up, n, amount in zip(table.pipe, table.edge, table.up, table.node, table.grams, strict=True):
            if pipe:
                pipes.append((e, up, n, amount))
            else:
                asked.append((n, amount))
        return [(table.network[0], *row) for row in size_network(pipes, asked)]

    kind = rows.schema["network"].dataType.simpleString()
    whole = few.withColumn("grams", (F.col("amount") * 1000).cast("long")).drop("amount")
    found = map_groups(whole, "network", [], kernel, f"network {kind}, edge string, flow long, diameter int, continuous long, issue string", ["network", "edge", "flow", "diameter", "continuous", "issue"], nulls=True)
    exact = lambda c, kind: (F.col(c).cast("decimal(20,0)") * F.lit("0.001").cast("decimal(4,3)")).cast(kind).alias(c)
    sized = found.select("network", "edge", exact("flow", FLOW), "diameter", exact("continuous", LENGTH), "issue")
    if many is None:
        return sized
    pipes, asked = many.where("pipe"), many.where("NOT pipe")
    large = size_large(pipes.select("network", "edge", "up", F.col("node").alias("down"), F.col("amount").alias("length")), asked.select("network", "node", F.col("amount").alias("flow")))
    return sized.unionByName(large)


FLOWS, RUNS = ([int(limit[d] * 1000) for d in DIAMETERS] for limit in (MAX_FLOW, MAX_LENGTH))


def size_network(pipes: list[tuple], asked: list[tuple]) -> list[tuple]:
    """edge, flow, diameter, continuous, issue of one network of pipes (edge, up, down, length) under demands (node, flow), in
    thousandths, by the rules of ``size_large``."""
    nulls_first = lambda pipe: tuple((v is not None, v) for v in (pipe[0], pipe[1], pipe[3]))
    fed: dict = {}
    for pipe in pipes:
        if pipe[2] not in fed or nulls_first(pipe) < nulls_first(fed[pipe[2]]):
            fed[pipe[2]] = pipe
    order = from_ends({n: pipe[1] for n, pipe in fed.items()})
    text = lambda key: None if key is None else str(key)
    faults = [(e, "DUPLICATE_EDGE_ID") for e, n in Counter(p[0] for p in pipes).items() if n > 1]
    faults += [(d, "MULTIPLE_UPSTREAM_EDGES") for d, n in Counter(p[2] for p in pipes).items() if n > 1]
    faults += [(n, "INVALID_DEMAND_FLOW") for n in {n for n, flow in asked if flow is None or flow < 0}]
    rooted = {fed[n][0] for n in order}
    lost = [p[0] for p in pipes if p[0] is None or p[0] not in rooted]
    if lost:
        faults.append((min((e for e in lost if e is not None), default=None), "NETWORK_CYCLE"))
    if faults:
        return [(text(key), None, None, None, issue) for key, issue in faults]

    flow, distance = dict.fromkeys(order, 0), {}
    for n, units in asked:
        if n in flow:
            flow[n] += units
    for n in reversed(order):
        if fed[n][1] in flow:
            flow[fed[n][1]] += flow[n]
    less = lambda a, b: None if a is None or b is None else a - b
    head, bottom, top, above = {}, {}, {}, {}
    for n in order:
        _, up, _, length = fed[n]
        before = distance.get(up, 0)
        distance[n] = None if before is None or length is None else before + length
        h = head[n] = head[up] if up in flow and flow[up] == flow[n] else n
        if h == n:
            bottom[h], top[h], above[h] = distance[n], less(distance[n], length), head.get(up) if up in flow else None
        elif bottom[h] is None or distance[n] is not None and distance[n] > bottom[h]:
            bottom[h] = distance[n]
    sections = list(top)
    size = {h: bisect_left(FLOWS, flow[h]) for h in sections}
    joined = lambda h: above[h] in size and size[above[h]] == size[h]
    while True:
        far = dict(bottom)
        for h in reversed(sections):
            if joined(h) and far[h] is not None and (far[above[h]] is None or far[h] > far[above[h]]):
                far[above[h]] = far[h]
        long = {h for h in sections if size[h] < len(RUNS) and top[h] is not None and far[h] is not None and far[h] - top[h] > RUNS[size[h]]}
        raised = [h for h in long if size[h] + 1 < len(RUNS)]
        if not raised:
            break
        for h in raised:
            size[h] += 1
    start: dict = {}
    for h in sections:
        start[h] = start[above[h]] if joined(h) else h
    out = []
    for n in order:
        h = head[n]
        diameter = DIAMETERS[size[h]] if size[h] < len(DIAMETERS) else None
        issue = "FLOW_EXCEEDS_CATALOG" if diameter is None else "MAX_CONTINUOUS_LENGTH_EXCEEDED" if n == h and h in long else None
        out.append((text(fed[n][0]), flow[n], diameter, less(distance[n], top[start[h]]), issue))
    return out


def size_large(edges: DataFrame, demands: DataFrame) -> DataFrame:
    """``size_networks`` for networks of any size: every step is a join over all edges.

    Neighbouring edges of equal flow form a section, which has one diameter: the least that carries the flow, is no less
    than what follows, and whose longest run of that diameter keeps to its limit. Sections start from the diameter of
    their flow. Flows never grow downstream, so diameters don't either, and the run below a section, at its present
    diameter, is the farthest end among the sections below that have the same one, less its own start; the distance
    from the source makes that one largest value of a subtree. Where a run is too long its section takes the next
    diameter. A run that is too long under least values stays so, whence nothing is raised in vain, and what
    has the same diameter above is too long as well, so all of them rise together: 18 rounds at most.

    A faulty network gives only its issues (``network_faults``, its key in ``edge``). Beyond the catalog's flow there is no
    diameter and FLOW_EXCEEDS_CATALOG on each edge; where even the last pipe's run is too long the section's first edge has
    MAX_CONTINUOUS_LENGTH_EXCEEDED."""
    at = lambda name: F.struct("network", F.col(name).alias("node"))
    lines = cut(edges.select("network", "edge", "up", "down", F.col("length").cast(LENGTH)))
    rows = lines.count()
    wide = lambda df: met_by(df, rows)
    asked = demands.select("network", "node", F.col("flow").cast(FLOW))
    fed = lines.groupBy("network", "down").agg(F.min(F.struct("edge", "up", "length")).alias("e"))
    tree = fed.select(at("down").alias("node"), F.struct("network", F.col("e.up").alias("node")).alias("up"), F.col("e.edge").alias("edge"), F.col("e.length").alias("length"))
    ends = chase(tree, weight="length").select("node", F.col("total").alias("distance"))
    placed = cut(tree.join(wide(ends), "node"))
    faults = cut(network_faults(lines, asked, placed.select("node.network", "edge"), rows))
    sound = placed.join(faults.select("network").distinct(), placed["node.network"] == faults["network"], "left_anti")
    demand = asked.groupBy(at("node").alias("node")).agg(F.sum("flow").alias("demand"))
    links = cut(sound.join(wide(demand), "node", "left"))
    flows = subtree_sums(links, "demand", FLOW).withColumnRenamed("total", "flow")
    heads = same_flow_components(links, flows)
    own = cut(links.drop("demand").join(wide(flows), "node").join(wide(heads), "node"))

    parts = own.groupBy("head").agg(F.max("flow").alias("flow"), F.max("distance").alias("bottom"))
    first = own.where("node = head").select("head", "up", (F.col("distance") - F.col("length")).alias("top"))
    above = own.select(F.col("node").alias("up"), F.col("head").alias("parent"))
    sections = first.join(wide(above), "up", "left").join(wide(parts), "head").select(F.col("head").alias("node"), F.col("parent").alias("up"), "flow", "top", "bottom", diameter_for(F.col("flow")).alias("diameter"))
    state = cut(sections)
    while True:
        runs = same_diameter(state.where("diameter IS NOT NULL"), rows)
        far = subtree_max(runs, "bottom", "decimal(28,3)").withColumnRenamed("total", "far")
        long = F.coalesce(F.col("far") - F.col("top") > length_limit(F.col("diameter")), F.lit(False))
        measured = cut(state.join(wide(far), "node", "left").withColumn("long", long).drop("far"))
        if measured.where(F.col("long") & next_diameter(F.col("diameter")).isNotNull()).isEmpty():
            break
        raised = F.when(F.col("long"), F.coalesce(next_diameter(F.col("diameter")), F.col("diameter"))).otherwise(F.col("diameter"))
        state = cut(measured.withColumn("diameter", raised).drop("long"))

    starts = chase(same_diameter(measured, rows)).select("node", F.col("end").alias("start"))
    run = starts.join(wide(measured.select(F.col("node").alias("start"), F.col("top").alias("run_top"))), "start").select(F.col("node").alias("head"), "run_top")
    chosen = run.join(wide(measured.select(F.col("node").alias("head"), "diameter", "long")), "head")
    issue = F.when(F.col("diameter").isNull(), "FLOW_EXCEEDS_CATALOG").when(F.col("long") & (F.col("node") == F.col("head")), "MAX_CONTINUOUS_LENGTH_EXCEEDED")
    sized = own.join(wide(chosen), "head").select("node.network", "edge", "flow", "diameter", (F.col("distance") - F.col("run_top")).cast(LENGTH).alias("continuous"), issue.alias("issue"))
    nothing = faults.select("network", F.col("key").alias("edge"), F.lit(None).cast(FLOW).alias("flow"), F.lit(None).cast("int").alias("diameter"), F.lit(None).cast(LENGTH).alias("continuous"), "issue")
    return sized.withColumn("edge", F.col("edge").cast("string")).unionByName(nothing)


def same_diameter(sections: DataFrame, rows: int = 0) -> DataFrame:
    """``sections`` (of a table of ``rows``) with ``up`` only where the section above has the same diameter, or like it none."""
    above = sections.select(F.col("node").alias("up"), F.col("diameter").alias("wider"), F.lit(True).alias("known"))
    linked = sections.join(met_by(above, rows), "up", "left")
    return linked.withColumn("up", F.when(F.col("known") & F.col("diameter").eqNullSafe(F.col("wider")), F.col("up"))).drop("wider", "known")


def networks_by_root(tree: DataFrame, within: str | None = None) -> DataFrame:
    """node, network: the root that each node of a forest (node, up) hangs from; ``within``: a column that no pointer leaves."""
    return (chase_within(tree, within) if within else chase(tree)).select("node", F.col("end").alias("network"))
