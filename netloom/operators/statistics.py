"""Weighted statistics of routes and of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import point_segment_distance


def weighted_quantile(rows: DataFrame, key: str, value: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """First value whose running weight reaches each share of the total."""
    w = Window.partitionBy(key).orderBy(value)
    run = rows.groupBy(key, value).agg(F.sum(weight).alias("w")).withColumns({"run": F.sum("w").over(w), "total": F.sum("w").over(Window.partitionBy(key))})
    return run.groupBy(key).agg(*[F.min(F.when(F.col("run") >= F.col("total") * s, F.col(value))).alias(n) for n, s in shares.items()])


def share_within(rows: DataFrame, key: str, value: str, weight: str, thresholds: dict[str, float]) -> DataFrame:
    """Weight within each threshold and the total, so that ratios can be formed exactly."""
    return rows.groupBy(key).agg(F.sum(weight).alias("total"), *[F.sum(F.when(F.col(value) <= t, F.col(weight)).otherwise(0)).alias(n) for n, t in thresholds.items()])


def latencies(events: DataFrame, key: str, value: str) -> DataFrame:
    return events.groupBy(key).agg(F.min(value).alias("least"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"), F.max(value).alias("greatest"))


def sample_polylines(segments: DataFrame, step: float) -> DataFrame:
    """Midpoints of equal pieces, at most ``step`` long, of each segment (route, seq, ax, ay, bx, by), with their weight."""
    length = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    n = F.greatest(F.lit(1), F.ceil(length / step)).cast("int")
    pieces = segments.withColumns({"length": length, "n": n}).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    t = (F.col("i") - 0.5) / F.col("n")
    return pieces.select("route", "seq", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"), (F.col("length") / F.col("n")).alias("weight"))


def proximity(segments: DataFrame, reference: DataFrame, step: float) -> DataFrame:
    """Distance of every sample of a route to its reference polyline (route, ax, ay, bx, by)."""
    other = reference.select("route", *[F.col(c).alias(f"r_{c}") for c in ("ax", "ay", "bx", "by")])
    d = point_segment_distance(F.col("x"), F.col("y"), *[F.col(f"r_{c}") for c in ("ax", "ay", "bx", "by")])
    return sample_polylines(segments, step).join(other, "route").groupBy("route", "seq", "x", "y", "weight").agg(F.min(d).alias("distance"))


def cycle_count(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes, edges, components and independent cycles (edges - nodes + components) of a graph."""
    from .topology import components

    found = components(edges, nodes)
    totals = found.agg(F.count("*").alias("nodes"), F.countDistinct("component").alias("components"))
    return totals.crossJoin(edges.agg(F.count("*").alias("edges"))).select("nodes", "edges", "components", (F.col("edges") - F.col("nodes") + F.col("components")).alias("cycles"))  # one row each
