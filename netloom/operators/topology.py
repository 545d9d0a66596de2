"""Existing-network topology: upstream links, reachability, incidence, spatial joins, tie-in candidates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, dealt
from ..functions.geometry import boxes_overlap, point_segment_distance, segments_intersect

MAX_CANDIDATES = 12
CHAMBER_SNAP_M = 10.0
CHAMBER_CAPACITY = 4
NODE_TOLERANCE_M = 0.01


def cells(x: Column, y: Column, size: float) -> Column:
    return F.struct(F.floor(x / size).cast("long").alias("cx"), F.floor(y / size).cast("long").alias("cy"))


def box_cells(ax: Column, ay: Column, bx: Column, by: Column, size: float, margin: float = 0.0) -> Column:
    """All grid cells that a segment's box, widened by ``margin``, touches."""
    lo = lambda a, b: F.floor((F.least(a, b) - margin) / size).cast("long")
    hi = lambda a, b: F.floor((F.greatest(a, b) + margin) / size).cast("long")
    return F.flatten(F.transform(F.sequence(lo(ax, bx), hi(ax, bx)), lambda cx: F.transform(F.sequence(lo(ay, by), hi(ay, by)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def line_cells(ax: Column, ay: Column, bx: Column, by: Column, size: float, margin: float = 0.0) -> Column:
    """The grid cells within ``margin`` of a segment, column by column of the grid: their number grows with its length, not with its box."""
    ax, ay, bx, by = (c.cast("double") for c in (ax, ay, bx, by))
    wide = margin + size * 1e-6  # for rounding
    left, right, low, high = F.least(ax, bx), F.greatest(ax, bx), F.least(ay, by), F.greatest(ay, by)
    cell = lambda v: F.floor(v / size).cast("long")
    at = lambda x: F.when(bx == ax, ay).otherwise(ay + (F.greatest(left, F.least(right, x)) - ax) * ((by - ay) / (bx - ax)))

    def column(cx: Column) -> Column:
        y1, y2 = at(cx * size - wide), at((cx + 1) * size + wide)
        first = F.when(bx == ax, low).otherwise(F.greatest(low, F.least(y1, y2)))
        last = F.when(bx == ax, high).otherwise(F.least(high, F.greatest(y1, y2)))
        return F.transform(F.sequence(cell(first - wide), cell(last + wide)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(cell(left - wide), cell(right + wide)), column))


def by_place(points: DataFrame, search: Callable[[DataFrame], DataFrame], point: str = "point_id") -> DataFrame:
    """``search`` of points (point, x, y), done for one point of each place only; its rows are handed to all points there."""
    keyed = points.select(point, "x", "y").distinct()
    first = cut(keyed.groupBy("x", "y").agg(F.min(point).alias(point)))
    found = first.join(search(first), point).drop(point)
    return keyed.join(found, ["x", "y"]).drop("x", "y")


def within_distance(points: DataFrame, others: DataFrame, distance: float, keys: Sequence[str], deal: bool = False) -> DataFrame:
    """Pairs (points, others as o_*) at most ``distance`` apart: grid cells make it an equi-join, then the exact test. ``deal``: cells
    go to a fixed number of tasks, for rows that stand for many pairs."""
    around = F.flatten(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda j: F.struct((F.col("cell.cx") + i).alias("cx"), (F.col("cell.cy") + j).alias("cy")))))
    left = points.withColumn("cell", cells(F.col("x"), F.col("y"), distance)).withColumn("near", F.explode(around)).drop("cell")
    right = others.select(*[F.col(c).alias(f"o_{c}") for c in others.columns]).withColumn("near", cells(F.col("o_x"), F.col("o_y"), distance))
    dx, dy = F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y")
    left = dealt(left, "near") if deal else left
    return left.join(right, "near").drop("near").withColumn("distance2", dx * dx + dy * dy).where(F.col("distance2") <= distance * distance)


#: Ids of one place that go as one list through a join of places.
LIST = 1024


def at_places(df: DataFrame, name: str, out: str) -> DataFrame:
    """x, y, ``out``: the ids of each place, in lists of a bounded length. Ids are dealt within a place, so that no list waits for one task."""
    part = F.pmod(F.xxhash64(name), F.ceil(F.col("n") / LIST)).alias("part")
    counted = df.select(name, "x", "y").join(df.groupBy("x", "y").agg(F.count("*").alias("n")), ["x", "y"])
    return counted.groupBy("x", "y", part).agg(F.collect_list(name).alias(out)).drop("part")


def pairs_within(points: DataFrame, others: DataFrame, distance: float, point: str, other: str) -> DataFrame:
    """point, other, distance2 of all pairs at most ``distance`` apart. Pairs of places are tested, once each, and carry the ids of
    both; ids are paired where the places meet, so that no exchange holds the pairs."""
    met = within_distance(at_places(points, point, "a"), at_places(others, other, "b"), distance, [], deal=True)
    return met.select(F.explode("a").alias(point), F.col("o_b").alias("b"), "distance2").select(point, F.explode("b").alias(other), "distance2")


def segment_crossings(segments: DataFrame, cell: float, id_col: str = "id", group: Sequence[str] = ()) -> DataFrame:
    """Unordered pairs, within each ``group``, of segments (id, ax, ay, bx, by) that meet. A pair is tested in one common cell only: the
    cell that holds the lower corner of the boxes' overlap, so no distinct is needed."""
    own = segments.withColumn("cell", F.explode(box_cells(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), cell)))
    other = own.select(*[F.col(c) if c == "cell" or c in group else F.col(c).alias(f"o_{c}") for c in own.columns])
    pair = own.join(other, ["cell", *group]).where(F.col(id_col) < F.col(f"o_{id_col}"))
    a, b = [F.col(c) for c in ("ax", "ay", "bx", "by")], [F.col(f"o_{c}") for c in ("ax", "ay", "bx", "by")]
    corner = cells(F.greatest(F.least(a[0], a[2]), F.least(b[0], b[2])), F.greatest(F.least(a[1], a[3]), F.least(b[1], b[3])), cell)
    return pair.where(boxes_overlap(*a, *b)).where(F.col("cell") == corner).where(segments_intersect(*a, *b)).select(*group, id_col, f"o_{id_col}")


#: Targets in one grid cell that are still compared one by one; denser places are searched with a smaller radius first.
DENSE = 4096


def first_radius(places: DataFrame, x: str, y: str, k: int, extent: tuple[float, float], total: int) -> float:
    """A search radius that reaches about k of ``total`` places on average, made smaller until no cell of the grid is dense."""
    radius = (max(extent[0], 1) * max(extent[1], 1) * k / max(total, 1)) ** 0.5
    for _ in range(8):
        if (places.groupBy(cells(F.col(x), F.col(y), radius)).count().agg(F.max("count")).first()[0] or 0) <= DENSE:
            break
        radius /= 4
    return radius


def nearest(points: DataFrame, targets: DataFrame, k: int = MAX_CANDIDATES, *, point: str = "point_id", target: str = "chamber_id", carry: Sequence[str] = ()) -> DataFrame:
    """The k nearest targets of every point (ties by target id): point, carried columns, target, distance2, rank.

    Points meet targets in grid cells as wide as the search radius, an equi-join. Who has k targets within the radius
    is done; the others go on with four times the radius, the last time over everything.
    """
    extent = targets.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    spread = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    keys = [point, *carry]
    if not extent[0] or spread[0] is None:
        return points.limit(0).crossJoin(targets.limit(0).select(target)).select(*keys, target, F.lit(0).cast("long").alias("distance2"), F.lit(0).alias("rank"))
    width = max(extent[2], spread[1]) - min(extent[1], spread[0]) + 1
    height = max(extent[4], spread[3]) - min(extent[3], spread[2]) + 1
    radius = first_radius(targets, "x", "y", k, (extent[2] - extent[1], extent[4] - extent[3]), extent[0])
    todo, done = points.select(*dict.fromkeys([*keys, "x", "y"])), []  # what is carried may be a coordinate
    right = targets.select(target, "x", "y")
    rank = F.row_number().over(Window.partitionBy(point).orderBy("distance2", target))
    while True:
        last = radius >= width + height
        pairs = within_distance(todo, right, radius, [point]).select(*keys, F.col(f"o_{target}").alias(target), "distance2")
        if k == 1:
            best = pairs.groupBy(*keys).agg(F.min_by(F.struct(target, "distance2"), F.struct("distance2", target)).alias("b"))
            found = best.select(*keys, f"b.{target}", "b.distance2", F.lit(1).alias("rank"))
        else:  # the rank limit is applied before the exchange, too
            ranked = cut(pairs.withColumn("rank", rank).where(F.col("rank") <= k))
            full = ranked.groupBy(point).agg(F.max("rank").alias("n")).where(F.col("n") >= k).select(point)
            found = ranked if last else ranked.join(full, point, "left_semi")
        found = cut(found)
        done.append(found)
        if last:
            break
        todo = cut(todo.join(found.select(point).distinct(), point, "left_anti"))
        if todo.isEmpty():
            break
        radius *= 4
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def distance_to_segments(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points with their distance to the nearest of ``segments`` (ax, ay, bx, by), searched in grid cells with a radius
    that grows until every point has an answer. Places and segments take part once each, in cells along the segments: about
    one place lies in a cell at first, or as many segments as a place would meet anyway."""
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    d = point_segment_distance(F.col("x"), F.col("y"), *ends)
    lines = cut(segments.select(*ends).where(F.greatest(*ends).isNotNull()).distinct())
    size = lines.agg(F.count("*"), F.min(F.least("ax", "bx")), F.max(F.greatest("ax", "bx")), F.min(F.least("ay", "by")), F.max(F.greatest("ay", "by"))).first()
    places = cut(points.select("x", "y").distinct())
    spread = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if not size[0] or spread[0] is None:
        return points.limit(0).withColumn("distance", F.lit(None).cast("double"))
    reach = 2 * (max(size[2], spread[1]) - min(size[1], spread[0]) + max(size[4], spread[3]) - min(size[3], spread[2])) + 1
    radius = (max(size[2] - size[1], 1) * max(size[4] - size[3], 1) / max(size[0], spread[4])) ** 0.5 + 1
    todo, out = places, None
    while True:
        near = dealt(lines.withColumn("cell", F.explode(line_cells(*ends, radius, radius))), "cell")
        found = todo.withColumn("cell", cells(F.col("x"), F.col("y"), radius)).join(near, "cell").groupBy("x", "y").agg(F.min(d).alias("distance"))
        found = cut(found if radius > reach else found.where(F.col("distance") <= radius))
        out = found if out is None else out.unionByName(found)
        todo = cut(todo.join(found, ["x", "y"], "left_anti"))
        if radius > reach or todo.isEmpty():
            return points.distinct().join(out, ["x", "y"]).select(*points.columns, "distance")
        radius *= 4


def nearest_in_grid(points: DataFrame, targets: DataFrame, reach: float, *, point: str = "point_id", target: str = "chamber_id") -> DataFrame:
    """The nearest target within ``reach`` of every point that has one (ties by id). One point of each place searches among one
    target of each place, at first where about one is to be expected, then four times as far until the reach."""
    places = cut(targets.groupBy("x", "y").agg(F.min(target).alias(target)))
    size = places.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()

    def search(todo: DataFrame) -> DataFrame:
        radius, done = min(reach, first_radius(places, "x", "y", 1, (size[1], size[2]), size[0]) if size[0] and size[1] is not None else reach), None
        while True:
            pairs = within_distance(todo, places, radius, [point])
            best = pairs.groupBy(point).agg(F.min(F.struct("distance2", F.col(f"o_{target}").alias(target))).alias("b"))
            found = cut(best.select(point, f"b.{target}", "b.distance2"))
            done = found if done is None else done.unionByName(found)
            if radius >= reach:
                return done
            todo = cut(todo.join(found, point, "left_anti"))
            radius = min(reach, radius * 4)

    return by_place(points, search, point)


def tie_in_candidates(candidates: DataFrame, k: int = MAX_CANDIDATES) -> DataFrame:
    """Rank candidates (point_id, target_id, target_type, distance, new_chamber, x, y): equal targets at the same
    millimetre count once, then by distance, existing chambers first, then by target."""
    key = F.concat_ws("|", "target_type", "target_id", F.floor(F.col("x") * 1000 + 0.5).cast("long"), F.floor(F.col("y") * 1000 + 0.5).cast("long"))
    order = ["distance", "new_chamber", "target_id"]
    first = F.row_number().over(Window.partitionBy("point_id", "key").orderBy(*order))
    kept = candidates.withColumn("key", key).withColumn("first", first).where("first = 1").drop("first", "key")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("point_id").orderBy(*order))).where(F.col("rank") <= k)


def upstream_issues(links: DataFrame, node: str = "node", up: str = "up") -> DataFrame:
    """UPSTREAM_CYCLE and UPSTREAM_CHAIN_BROKEN of every node, by pointer doubling: log2(depth) joins, whatever the depth.

    A pointer that reaches a root becomes null; one that leaves the table is broken; what still points into the
    table after more doublings than any chain needs goes round in a cycle.
    """
    base = links.select(F.col(node).alias("n"), F.col(up).alias("p"))
    now = base.join(base.select(F.col("n").alias("p"), F.lit(True).alias("known")), "p", "left")
    now = now.select("n", "p", F.when(F.col("p").isNull(), "ok").when(F.col("known").isNull(), "UPSTREAM_CHAIN_BROKEN").otherwise("open").alias("state"))
    rounds = max(1, links.count().bit_length())
    for i in range(rounds):
        there = now.select(F.col("n").alias("p"), F.col("p").alias("pp"), F.col("state").alias("ps"))
        now = now.join(there, "p", "left").select("n", F.when(F.col("state") == "open", F.col("pp")).otherwise(F.col("p")).alias("p"), F.when((F.col("state") == "open") & (F.col("ps") != "open"), F.col("ps")).otherwise(F.col("state")).alias("state"))
        if i % 4 == 3:
            now = cut(now)
    return now.select(F.col("n").alias(node), F.when(F.col("state") == "open", "UPSTREAM_CYCLE").otherwise(F.col("state")).alias("code")).where("code <> 'ok'")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes reachable from ``seeds`` (node) over undirected ``edges`` (a, b): all nodes of the seeds' components, however far."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).unionByName(seeds.select("node")).distinct()
    found = components(edges, nodes)
    return found.join(found.join(seeds.select("node").distinct(), "node", "left_semi").select("component").distinct(), "component", "left_semi").select("node")


def incidence(chambers: DataFrame, segments: DataFrame, cell: float, tolerance: float = NODE_TOLERANCE_M) -> DataFrame:
    """Directions in use at every chamber: a segment that ends there counts one, one that passes counts two. Chambers' places and
    equal segments are tested once each, in the cells along a segment, which are smaller than ``cell`` where chambers are dense."""
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    places = cut(chambers.select("x", "y").distinct())
    size = places.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    if size[1] is not None:
        cell = float(max(min(cell, (max(size[1], 1) * max(size[2], 1) / size[0]) ** 0.5), 4 * tolerance))
    lines = segments.groupBy(*ends).agg(F.count("*").alias("copies"))
    near = dealt(lines.withColumn("cell", F.explode(line_cells(*ends, cell, tolerance))), "cell")
    at = lambda ex, ey: (F.col("x") - F.col(ex)) ** 2 + (F.col("y") - F.col(ey)) ** 2 <= tolerance * tolerance
    starts, stops = at("ax", "ay"), at("bx", "by")
    through = point_segment_distance(*map(F.col, ("x", "y", "ax", "ay", "bx", "by"))) <= tolerance
    n = F.when(starts & stops, 0).when(starts | stops, 1).when(through, 2).otherwise(0)
    counts = places.withColumn("cell", cells(F.col("x"), F.col("y"), cell)).join(near, "cell").groupBy("x", "y").agg(F.sum(n * F.col("copies")).alias("n"))
    return chambers.select("chamber_id", "x", "y").join(counts, ["x", "y"], "left").select("chamber_id", F.coalesce("n", F.lit(0)).cast("long").alias("incident"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component (smallest node) over undirected edges (a, b), isolated nodes included: labels and pointer jumps."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("m")).withColumnRenamed("a", "node")
        low = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("to"))
        new = cut(low.join(jump, "component").select("node", F.col("to").alias("component")))
        if new.join(label.withColumnRenamed("component", "was"), "node").where("component <> was").isEmpty():
            return new
        label = new
