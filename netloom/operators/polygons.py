"""Validity of polygons with holes and of multi-polygons.

A feature is an array of parts, each an array of rings (the first its shell, the
others holes), each an array of (x, y). Sides meet in grid cells, so contacts of
rings are found by an equi-join; whether a ring lies in another is told by
counting crossings of a ray among the sides of one horizontal slab. Slabs are
as many as the square root of a feature's sides, so that a tall side is in no
more of them than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import boxes_overlap, orientation
from .lineage import cut
from .topology import box_cells, cells

RING = ["feature_index", "part", "ring"]


def rings_of(polygons: DataFrame) -> DataFrame:
    """feature_index, part, ring, points: one row a ring."""
    parts = polygons.select("feature_index", F.posexplode("parts").alias("part", "rings"))
    return parts.select("feature_index", "part", F.posexplode("rings").alias("ring", "points"))


def sides_of(rings: DataFrame) -> DataFrame:
    """feature_index, part, ring, id, n, ax, ay, bx, by: the sides of closed rings, repeated points left out."""
    fine = F.filter("points", lambda p, i: (i == 0) | (p != F.element_at("points", F.greatest(i, F.lit(1)))))
    named = rings.withColumn("points", fine).withColumn("n", F.size("points") - 1).where("n >= 3")
    at = lambda i, c: F.element_at("points", i)[c]
    sides = named.select(*RING, "n", "points", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("id"))
    return sides.select(*RING, "id", "n", at(F.col("id"), "x").alias("ax"), at(F.col("id"), "y").alias("ay"), at(F.col("id") + 1, "x").alias("bx"), at(F.col("id") + 1, "y").alias("by"))


def contacts(sides: DataFrame, cell: float) -> DataFrame:
    """Pairs of sides of a feature that share a point, once each: both keys (the second with ``o_``), kind (cross, overlap or touch) and,
    of a touch, its place (x, y)."""
    own = sides.withColumn("cell", F.explode(box_cells(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), cell)))
    other = own.select(*[F.col(c) if c in ("cell", "feature_index") else F.col(c).alias(f"o_{c}") for c in own.columns])
    a, b = [F.col(c) for c in ("ax", "ay", "bx", "by")], [F.col(f"o_{c}") for c in ("ax", "ay", "bx", "by")]
    place, o_place = F.struct("part", "ring", "id"), F.struct(F.col("o_part").alias("part"), F.col("o_ring").alias("ring"), F.col("o_id").alias("id"))
    low, high = (F.greatest(F.least(a[0], a[2]), F.least(b[0], b[2])), F.greatest(F.least(a[1], a[3]), F.least(b[1], b[3]))), (F.least(F.greatest(a[0], a[2]), F.greatest(b[0], b[2])), F.least(F.greatest(a[1], a[3]), F.greatest(b[1], b[3])))
    pair = own.join(other, ["cell", "feature_index"]).where(place < o_place).where(boxes_overlap(*a, *b)).where(F.col("cell") == cells(*low, cell))
    o1, o2, o3, o4 = orientation(*a, b[0], b[1]), orientation(*a, b[2], b[3]), orientation(*b, a[0], a[1]), orientation(*b, a[2], a[3])
    flat = (o1 == 0) & (o2 == 0)
    on = lambda o, s, x, y: (o == 0) & (x >= F.least(s[0], s[2])) & (x <= F.greatest(s[0], s[2])) & (y >= F.least(s[1], s[3])) & (y <= F.greatest(s[1], s[3]))
    spot = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    touch = F.when(on(o1, a, b[0], b[1]), spot(b[0], b[1])).when(on(o2, a, b[2], b[3]), spot(b[2], b[3])).when(on(o3, b, a[0], a[1]), spot(a[0], a[1])).when(on(o4, b, a[2], a[3]), spot(a[2], a[3]))
    kind = F.when((o1 * o2 < 0) & (o3 * o4 < 0), "cross").when(flat & ((low[0] < high[0]) | (low[1] < high[1])), "overlap").when(touch.isNotNull(), "touch")
    return pair.select("feature_index", "part", "ring", "id", "n", "o_part", "o_ring", "o_id", kind.alias("kind"), touch.alias("at")).where("kind IS NOT NULL")


def test_places(sides: DataFrame, met: DataFrame) -> DataFrame:
    """feature_index, part, ring, px, py: a place inside every piece of a side between its contacts with other rings."""
    touched = met.where("kind = 'touch' AND (part <> o_part OR ring <> o_ring)")
    mine = touched.select(*RING, "id", "at").unionByName(touched.select("feature_index", F.col("o_part").alias("part"), F.col("o_ring").alias("ring"), F.col("o_id").alias("id"), "at"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    share = lambda p: ((p["x"] - F.col("ax")) * dx + (p["y"] - F.col("ay")) * dy) / (dx * dx + dy * dy)
    held = sides.join(mine.groupBy(*RING, "id").agg(F.collect_set("at").alias("at")), [*RING, "id"], "left")
    stops = F.array_sort(F.array_union(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce(F.transform("at", share), F.array().cast("array<double>"))))
    middles = F.transform(F.slice(stops, 2, 1 << 30), lambda v, i: (v + F.element_at(stops, i + 1)) / 2)
    return held.select(*RING, F.explode(middles).alias("t"), "ax", "ay", dx.alias("dx"), dy.alias("dy")).select(*RING, (F.col("ax") + F.col("t") * F.col("dx")).alias("px"), (F.col("ay") + F.col("t") * F.col("dy")).alias("py"))


def rings_around(places: DataFrame, sides: DataFrame) -> DataFrame:
    """feature_index, part, ring, px, py, o_part, o_ring, inside, edge: which other rings a place is inside of or on, by the crossings of a ray to
    the right; rings without any are left out."""
    frame = sides.groupBy("feature_index").agg(F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1"), F.ceil(F.sqrt(F.count("*").cast("double"))).alias("slabs"))
    slab = lambda y: F.least(F.col("slabs") - 1, F.greatest(F.lit(0), F.floor((y - F.col("y0")) * F.col("slabs") / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0)))))
    cut_sides = sides.join(frame, "feature_index").withColumn("slab", F.explode(F.sequence(F.coalesce(slab(F.least("ay", "by")), F.lit(0)), F.coalesce(slab(F.greatest("ay", "by")), F.lit(0)))))
    walls = cut_sides.select("feature_index", "slab", F.col("part").alias("o_part"), F.col("ring").alias("o_ring"), "ax", "ay", "bx", "by")
    asked = places.join(frame, "feature_index").withColumn("slab", F.coalesce(slab(F.col("py")), F.lit(0))).drop("y0", "y1", "slabs")
    px, py = F.col("px"), F.col("py")
    pair = asked.join(walls, ["feature_index", "slab"]).where("part <> o_part OR ring <> o_ring").where(F.greatest("ax", "bx") >= px)
    spans = (F.col("ay") > py) != (F.col("by") > py)
    right = F.col("ax") + (py - F.col("ay")) * (F.col("bx") - F.col("ax")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)) > px
    on = (orientation(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), px, py) == 0) & (px >= F.least("ax", "bx")) & (py >= F.least("ay", "by")) & (py <= F.greatest("ay", "by"))
    return pair.groupBy(*RING, "px", "py", "o_part", "o_ring").agg((F.sum(F.when(spans & right, 1).otherwise(0)) % 2 == 1).alias("inside"), F.max(on).alias("edge"))


def polygon_issues(polygons: DataFrame, cell: float, largest: tuple[float, float] = (180.0, 90.0)) -> DataFrame:
    """feature_index, code, once each, of polygons (feature_index, parts):

    EMPTY_GEOMETRY no part, or a ring of fewer than four points; INVALID_COORDINATE null, not finite or out of range; OPEN_RING;
    SELF_INTERSECTION a ring meets itself, or rings cross or run along each other; HOLE_OUTSIDE_SHELL, NESTED_HOLES, NESTED_SHELLS
    by where the pieces of their sides lie; DISCONNECTED_INTERIOR two rings of a part touch at more than one place. Rings with one of
    the first three defects take no part in the others; where rings cross, nesting and touches are not judged."""
    rings = cut(rings_of(polygons))
    n = F.size("points")
    finite = lambda p: F.coalesce((F.abs(p["x"]) <= largest[0]) & (F.abs(p["y"]) <= largest[1]) & ~F.isnan(p["x"].cast("double")) & ~F.isnan(p["y"].cast("double")), F.lit(False))
    sound = F.forall("points", finite)
    closed = F.element_at("points", 1) == F.element_at("points", -1)
    codes = F.array_compact(F.array(F.when(F.coalesce(n, F.lit(0)) < 4, "EMPTY_GEOMETRY"), F.when(~sound, "INVALID_COORDINATE"), F.when((n >= 4) & ~closed, "OPEN_RING")))
    plain = rings.select("feature_index", F.explode(codes).alias("code"))
    without = polygons.where(F.coalesce(F.size("parts"), F.lit(0)) < 1).select("feature_index", F.lit("EMPTY_GEOMETRY").alias("code"))

    sides = cut(sides_of(rings.where((n >= 4) & sound & closed)))
    met = cut(contacts(sides, cell))
    own = (F.col("part") == F.col("o_part")) & (F.col("ring") == F.col("o_ring"))
    neighbours = own & ((F.col("o_id") - F.col("id") == 1) | ((F.col("id") == 1) & (F.col("o_id") == F.col("n"))))
    wrong = F.when(own & neighbours, F.col("kind") == "overlap").when(own, F.lit(True)).otherwise(F.col("kind") != "touch")
    crossed = met.where(wrong).select("feature_index").distinct()
    split = met.where(~own & (F.col("part") == F.col("o_part")) & (F.col("kind") == "touch")).groupBy("feature_index", "part", "ring", "o_ring").agg(F.count_distinct("at").alias("places")).where("places > 1").join(crossed, "feature_index", "left_anti")

    places = test_places(sides, met).join(crossed, "feature_index", "left_anti")
    around = cut(rings_around(places, sides))
    spot = [*RING, "px", "py"]
    in_shell = around.where("part = o_part AND ring > 0 AND o_ring = 0 AND (inside OR edge)").select(*spot)
    outside = places.where("ring > 0").join(in_shell, spot, "left_anti")
    strictly = F.col("inside") & ~F.col("edge")
    nested = around.where(strictly & (F.col("part") == F.col("o_part")) & (F.col("ring") > 0) & (F.col("o_ring") > 0))
    covered = around.where("ring = 0 AND part <> o_part").groupBy(*spot, "o_part").agg(F.sum(F.col("inside").cast("int")).alias("around"), F.max("edge").alias("edge")).where("around % 2 = 1 AND NOT edge")
    found = [("SELF_INTERSECTION", crossed), ("DISCONNECTED_INTERIOR", split), ("HOLE_OUTSIDE_SHELL", outside), ("NESTED_HOLES", nested), ("NESTED_SHELLS", covered)]
    out = plain.unionByName(without)
    for code, rows in found:
        out = out.unionByName(rows.select("feature_index", F.lit(code).alias("code")))
    return out.distinct()
