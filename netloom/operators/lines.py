"""Linear referencing and shape of routes: parts between stations, splits, alignment, distance from a reference line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import station_share
from .obstacles import route_segments

#: Nearer than this to an end, in metres, a segment is not split.
END_GUARD_M = 0.01


def sub_lines(vertices: DataFrame, spans: DataFrame) -> DataFrame:
    """route, seq, x1, y1, x2, y2: the pieces of routes between stations (route, s, e), cut inside their first and last segments."""
    met = route_segments(vertices).withColumn("finish", F.col("start") + F.col("length")).join(spans, "route").where("s < finish AND e > start")
    at = lambda t, c: F.col(f"a{c}") + t * (F.col(f"b{c}") - F.col(f"a{c}"))
    low = F.greatest((F.col("s") - F.col("start")) / F.col("length"), F.lit(0.0))
    high = F.least((F.col("e") - F.col("start")) / F.col("length"), F.lit(1.0))
    return met.withColumns({"low": low, "high": high}).select("route", "seq", at(F.col("low"), "x").alias("x1"), at(F.col("low"), "y").alias("y1"), at(F.col("high"), "x").alias("x2"), at(F.col("high"), "y").alias("y2"))


def split_segments(segments: DataFrame, places: DataFrame, guard: float = END_GUARD_M) -> DataFrame:
    """id, part, x1, y1, x2, y2: segments (id, ax .. by) split at the foot of a place (id, px, py) that lies inside; places at
    an end, or none, leave one part."""
    x = F.col
    t = station_share(*map(x, ("px", "py", "ax", "ay", "bx", "by")))
    length = F.hypot(x("bx") - x("ax"), x("by") - x("ay"))
    found = segments.join(places, "id", "left").withColumn("t", F.when(x("px").isNotNull(), t)).withColumn("inside", (x("t") * length > guard) & ((1 - x("t")) * length > guard))
    foot = lambda c: x(f"a{c}") + x("t") * (x(f"b{c}") - x(f"a{c}"))
    piece = lambda part, a, b: F.struct(F.lit(part).alias("part"), a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    a, b, m = (x("ax").cast("double"), x("ay").cast("double")), (x("bx").cast("double"), x("by").cast("double")), (foot("x"), foot("y"))
    return found.select("id", F.explode(F.when(x("inside"), F.array(piece(1, a, m), piece(2, m, b))).otherwise(F.array(piece(1, a, b)))).alias("p")).select("id", "p.*")


def aligned_length(vertices: DataFrame, axis: Column, window: float = 6.0) -> DataFrame:
    """route, aligned, total: length along ``axis`` (degrees) or across it, within ``window`` degrees, and all length."""
    s = route_segments(vertices)
    bearing = F.degrees(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")))
    off = F.abs(F.pmod(bearing - axis + 45, F.lit(90.0)) - 45)
    return s.groupBy("route").agg(F.sum(F.when(off <= window, F.col("length")).otherwise(0.0)).alias("aligned"), F.sum("length").alias("total"))
