"""Buffers of lines and polygons, their difference from the polygon, and the rings of both.

A buffer is the union of one convex capsule around each side, with round ends of
a given number of segments a quarter circle, and of the polygon itself. Its
boundary is what is left of the capsules' edges once they are cut where they
meet and the pieces inside another capsule or the polygon are gone. Edges and
capsules meet in grid cells of one feature, so every step is an equi-join; area
and length need only the pieces, rings are linked by pointer doubling.
"""

from __future__ import annotations

from math import cos, pi, radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import boxes_overlap
from .lineage import cut
from .polygons import rings_around
from .topology import box_cells, cells, within_distance
from .trees import chase

#: Places closer than this are one; shares of a side closer than SHARE are one.
NEAR = 1e-6
SHARE = 1e-9
EDGE = ["feature_index", "piece", "k"]


def turns(quadrant: int) -> list[tuple[int, bool, float, float]]:
    """Corners of a capsule, counter-clockwise: number, whether it belongs to the end of the side, cosine and sine of its turn from the side."""
    steps = range(2 * quadrant + 1)
    angles = [(True, (k * 90 / quadrant - 90) % 360) for k in steps] + [(False, (k * 90 / quadrant + 90) % 360) for k in steps]
    return [(k, end, round(cos(radians(a)), 15), round(sin(radians(a)), 15)) for k, (end, a) in enumerate(angles)]


def capsules(sides: DataFrame, quadrant: int) -> DataFrame:
    """``sides`` (feature_index, piece, distance, ax, ay, bx, by) with their direction (ux, uy) and ``corners``, counter-clockwise. A side of no length gives a disc; a
    distance that is null or not above zero, or a coordinate that is null, gives no row."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = F.sqrt(dx * dx + dy * dy)
    unit = sides.where("distance > 0").withColumns({"ux": F.when(n == 0, 1.0).otherwise(dx / n), "uy": F.when(n == 0, 0.0).otherwise(dy / n)}).where("ux IS NOT NULL")
    ux, uy, d = F.col("ux"), F.col("uy"), F.col("distance")
    corner = lambda end, c, s: F.struct((F.col("bx" if end else "ax") + d * (ux * c - uy * s)).alias("x"), (F.col("by" if end else "ay") + d * (ux * s + uy * c)).alias("y"))
    return unit.withColumn("corners", F.array(*[corner(end, c, s) for _, end, c, s in turns(quadrant)]))


def edges_of(shapes: DataFrame) -> DataFrame:
    """feature_index, piece, k, ax, ay, bx, by, length: the edges of capsules, those of no length left out."""
    n = F.size("corners")
    at = lambda i: F.element_at("corners", i.cast("int"))
    out = shapes.select("feature_index", "piece", "corners", F.explode(F.sequence(F.lit(1), n)).alias("k"))
    a, b = at(F.col("k")), at(F.col("k") % n + 1)
    out = out.select(*EDGE, a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    return out.withColumn("length", F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)).where(F.col("length") > NEAR)


def cuts(edges: DataFrame, cell: float) -> DataFrame:
    """feature_index, piece, k, stop (t, x, y): where edges of different pieces of a feature meet. Both get the same place."""
    own = edges.withColumn("cell", F.explode(box_cells(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), cell, NEAR)))
    other = own.select(*[F.col(c) if c in ("cell", "feature_index") else F.col(c).alias(f"o_{c}") for c in own.columns])
    a, b = [F.col(c) for c in ("ax", "ay", "bx", "by")], [F.col(f"o_{c}") for c in ("ax", "ay", "bx", "by")]
    wide = [F.least(b[0], b[2]) - NEAR, F.least(b[1], b[3]) - NEAR, F.greatest(b[0], b[2]) + NEAR, F.greatest(b[1], b[3]) + NEAR]
    low = F.greatest(F.least(a[0], a[2]), F.least(b[0], b[2])) - NEAR, F.greatest(F.least(a[1], a[3]), F.least(b[1], b[3])) - NEAR
    pair = own.join(other, ["cell", "feature_index"]).where("piece < o_piece").where(boxes_overlap(*a, *wide)).where(F.col("cell") == cells(*low, cell))
    ux, uy, vx, vy, wx, wy = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1], b[0] - a[0], b[1] - a[1]
    den, size = ux * vy - uy * vx, F.col("length") * F.col("o_length")
    crossing, along = F.abs(den) > SHARE * size, F.abs(wx * uy - wy * ux) <= NEAR * F.col("length")
    pair = pair.select("*", F.when(crossing, (wx * vy - wy * vx) / den).alias("t"), F.when(crossing, (wx * uy - wy * ux) / den).alias("u"), (~crossing & along).alias("along"))
    held = lambda s: s.between(-SHARE, 1 + SHARE)
    stop = lambda t, x, y: F.struct(t.alias("t"), x.alias("x"), y.alias("y"))
    share = lambda x, y, s, n: ((x - s[0]) * (s[2] - s[0]) + (y - s[1]) * (s[3] - s[1])) / (n * n)
    x, y = a[0] + F.col("t") * ux, a[1] + F.col("t") * uy
    met = held(F.col("t")) & held(F.col("u"))
    on_a = F.array(*[stop(share(p, q, a, F.col("length")), p, q) for p, q in (b[:2], b[2:])])
    on_b = F.array(*[stop(share(p, q, b, F.col("o_length")), p, q) for p, q in (a[:2], a[2:])])
    mine = F.when(met, F.array(stop(F.col("t"), x, y))).when(F.col("along"), on_a)
    theirs = F.when(met, F.array(stop(F.col("u"), x, y))).when(F.col("along"), on_b)
    both = F.array(F.struct("piece", "k", mine.alias("stops")), F.struct(F.col("o_piece").alias("piece"), F.col("o_k").alias("k"), theirs.alias("stops")))
    found = pair.where(met | F.col("along")).select("feature_index", F.explode(both).alias("e"))
    return found.select("feature_index", "e.piece", "e.k", F.explode("e.stops").alias("stop")).where(F.col("stop.t").between(SHARE, 1 - SHARE))


def fragments(edges: DataFrame, found: DataFrame) -> DataFrame:
    """feature_index, piece, k, no, ax, ay, bx, by, length: the edges, cut."""
    stop = lambda t, x, y: F.struct(F.lit(t).alias("t"), F.col(x).alias("x"), F.col(y).alias("y"))
    held = edges.join(found.groupBy(*EDGE).agg(F.collect_list("stop").alias("stops")), EDGE, "left")
    inner = F.coalesce("stops", F.array().cast(found.select(F.collect_list("stop").alias("s")).schema["s"].dataType))
    chain = F.array_sort(F.concat(F.array(stop(0.0, "ax", "ay"), stop(1.0, "bx", "by")), inner))
    # a stop no further than NEAR from the last one that counts is that one; the last place is always the edge's end
    empty = F.slice(F.col("chain"), 1, 1)
    far = F.aggregate(F.slice(F.col("chain"), 2, 1 << 30), empty, lambda s, v: F.when((v["t"] - F.element_at(s, -1)["t"]) * F.col("length") > NEAR, F.concat(s, F.array(v))).otherwise(s))
    thin = held.withColumn("chain", chain).withColumn("far", far)
    parts = thin.select(*EDGE, F.posexplode(F.arrays_zip(F.expr("slice(far, 1, size(far) - 1)").alias("a"), F.expr("slice(far, 2, size(far) - 1)").alias("b"))).alias("no", "s"))
    out = parts.select(*EDGE, "no", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    return out.withColumn("length", F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)).where(F.col("length") > 0)


def covered(pieces: DataFrame, shapes: DataFrame, cell: float, quadrant: int) -> DataFrame:
    """Keys of the pieces that lie inside another capsule. Of pieces that run together in one direction the first stays; of opposite ones none."""
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    asked = pieces.select(*EDGE, "no", mx.alias("mx"), my.alias("my"), (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy"))
    asked = asked.withColumn("cell", cells(F.col("mx"), F.col("my"), cell))
    spread = shapes.withColumn("cell", F.explode(box_cells(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), cell, F.col("distance") + NEAR)))
    shape = spread.select("feature_index", "cell", F.col("piece").alias("o_piece"), "ax", "ay", "bx", "by", "distance", "ux", "uy")
    n = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    turned = lambda x, y: (x * F.col("ux") + y * F.col("uy"), F.col("ux") * y - F.col("uy") * x)
    s, h = turned(F.col("mx") - F.col("ax"), F.col("my") - F.col("ay"))
    du, dh = turned(F.col("dx"), F.col("dy"))
    pair = asked.join(shape, ["feature_index", "cell"]).where("piece <> o_piece").select(*EDGE, "no", "o_piece", "distance", s.alias("s"), h.alias("h"), n.alias("n"), du.alias("du"), dh.alias("dh"))
    # beyond an end, both seen from it with the side behind, the chord of the sector that a place lies in is the nearest edge
    end, step = F.when(F.col("s") > F.col("n"), 1.0).otherwise(-1.0), pi / (2 * quadrant)
    e, g = F.when(F.col("s") > F.col("n"), F.col("s") - F.col("n")).otherwise(-F.col("s")), end * F.col("h")
    sector = F.least(F.lit(2 * quadrant - 1), F.greatest(F.lit(0), F.floor((F.atan2(g, e) + pi / 2) / step)))
    middle = (sector + 0.5) * step - pi / 2
    beside = F.col("s").between(0.0, F.col("n"))
    pair = pair.withColumns({"beside": beside, "end": end, "e": e, "g": g, "middle": middle})
    depth = F.when(F.col("beside"), F.col("distance") - F.abs("h")).otherwise(F.col("distance") * cos(step / 2) - F.col("e") * F.cos("middle") - F.col("g") * F.sin("middle"))
    along = F.when(F.col("beside"), F.when(F.col("h") > 0, -F.col("du")).otherwise(F.col("du"))).otherwise(F.col("end") * (F.cos("middle") * F.col("dh") - F.sin("middle") * F.col("du")))
    return pair.where((depth > NEAR) | ((depth >= -NEAR) & ((along < 0) | (F.col("o_piece") < F.col("piece"))))).select(*EDGE, "no").distinct()


def boundary(sides: DataFrame, cell: float, quadrant: int = 8, polygon: DataFrame | None = None) -> DataFrame:
    """feature_index, ax, ay, bx, by, length: the boundary of the buffer of each feature, its inside on the left.

    ``sides``: feature_index, piece (orders the sides of a feature), distance, ax, ay, bx, by. ``polygon``: where the sides are those of valid
    polygons, the same sides as polygons.sides_of gives them; the inside then belongs to the buffer."""
    shapes = cut(capsules(sides, quadrant))
    edges = cut(edges_of(shapes))
    pieces = cut(fragments(edges, cuts(edges, cell)))
    kept = pieces.join(covered(pieces, shapes, cell, quadrant), [*EDGE, "no"], "left_anti")
    if polygon is not None:
        kept = cut(kept.withColumns({"px": (F.col("ax") + F.col("bx")) / 2, "py": (F.col("ay") + F.col("by")) / 2}))
        places = kept.select("feature_index", F.lit(-1).alias("part"), F.lit(-1).alias("ring"), "px", "py").distinct()
        within = rings_around(places, polygon).groupBy("feature_index", "px", "py").agg((F.sum(F.col("inside").cast("int")) % 2).alias("odd")).where("odd = 1").select("feature_index", "px", "py")
        kept = kept.join(within, ["feature_index", "px", "py"], "left_anti")
    return kept.select("feature_index", "ax", "ay", "bx", "by", "length")


def difference(outer: DataFrame, polygon: DataFrame) -> DataFrame:
    """The boundary of a buffer without the polygons that it was made from: their sides, turned round, are added."""
    n = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    turned = polygon.select("feature_index", F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"), n.alias("length"))
    return outer.unionByName(turned)


def oriented(polygon: DataFrame) -> DataFrame:
    """Sides of valid polygons with the inside on their left: shells counter-clockwise, holes clockwise, whatever the input has."""
    ring = ["feature_index", "part", "ring"]
    turn = F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))
    sense = polygon.groupBy(*ring).agg(((turn > 0) != (F.col("ring") == 0)).alias("wrong"))
    pick = lambda a, b: F.when(F.col("wrong"), F.col(b)).otherwise(F.col(a)).alias(a)
    rest = [c for c in polygon.columns if c not in ("ax", "ay", "bx", "by")]
    return polygon.join(sense, ring).select(*rest, pick("ax", "bx"), pick("ay", "by"), pick("bx", "ax"), pick("by", "ay"))


def measures(edges: DataFrame) -> DataFrame:
    """feature_index, area, length of what the directed edges surround."""
    return edges.groupBy("feature_index").agg((F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"), F.sum("length").alias("length"))


def rings(edges: DataFrame) -> DataFrame:
    """feature_index, ring, seq, x, y: the directed edges linked into closed rings, in order; shells run counter-clockwise, holes clockwise.

    An edge goes on with the nearest start within 4 * NEAR of its end, and where several begin there with the one most to the left. As many
    doubling rounds as the longest ring needs give each ring its smallest edge, from which it is counted."""
    named = cut(edges.withColumn("id", F.monotonically_increasing_id()))
    ends = named.select("feature_index", "id", F.col("bx").alias("x"), F.col("by").alias("y"), (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy"))
    starts = named.select("feature_index", "id", F.col("ax").alias("x"), F.col("ay").alias("y"), (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy"))
    pair = within_distance(ends, starts, 4 * NEAR, []).where("feature_index = o_feature_index AND id <> o_id")
    left = F.atan2(F.col("dx") * F.col("o_dy") - F.col("dy") * F.col("o_dx"), F.col("dx") * F.col("o_dx") + F.col("dy") * F.col("o_dy"))
    pick = F.struct(F.round(F.sqrt("distance2") / NEAR).alias("gap"), (-left).alias("turn"), F.col("o_id").alias("next"))
    links = cut(pair.groupBy("id").agg(F.min(pick)["next"].alias("next")))
    now = cut(links.select("id", "next", F.least("id", "next").alias("least")))
    longest = named.groupBy("feature_index").count().agg(F.max("count")).first()[0] or 1
    for _ in range(longest.bit_length()):
        there = now.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("least").alias("lower"))
        now = cut(now.join(there, "next").select("id", F.col("far").alias("next"), F.least("least", "lower").alias("least")))
    ringed = now.select("id", "least").join(links, "id")
    order = chase(ringed.select(F.col("id").alias("node"), F.when(F.col("next") != F.col("least"), F.col("next")).alias("up")))
    placed = named.join(ringed.select("id", "least"), "id").join(order.select(F.col("node").alias("id"), "hops"), "id")
    seq = F.row_number().over(Window.partitionBy("feature_index", "least").orderBy(F.desc("hops")))
    return placed.select("feature_index", F.col("least").alias("ring"), seq.alias("seq"), F.col("ax").alias("x"), F.col("ay").alias("y"))
