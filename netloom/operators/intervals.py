"""Interval algebra along routes: unions, elementary pieces, sections, lookups, stations, depth integrals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(spans: DataFrame, key: str = "route", s: str = "s", e: str = "e") -> DataFrame:
    """Union of overlapping or touching intervals: a new island begins beyond the running largest end."""
    w = Window.partitionBy(key).orderBy(s, e)
    before = F.max(e).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("island", F.sum(F.when(F.col(s) <= before, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "island").agg(F.min(s).alias(s), F.max(e).alias(e)).drop("island")


def elementary(spans: DataFrame, key: str = "route", s: str = "s", e: str = "e") -> DataFrame:
    """Pieces between neighbouring distinct cuts of each route."""
    cuts = spans.select(key, F.explode(F.array(s, e)).alias("a")).distinct()
    return cuts.withColumn("b", F.lead("a").over(Window.partitionBy(key).orderBy("a"))).where("b IS NOT NULL")


def covering(pieces: DataFrame, spans: DataFrame, key: str = "route", s: str = "s", e: str = "e") -> DataFrame:
    """Pieces with the spans over their midpoint (left join): an equi-join on the route with a range condition."""
    mid = (F.col("p.a") + F.col("p.b")) / 2
    own = spans.withColumnRenamed(key, "__key")
    on = (F.col(f"p.{key}") == F.col("o.__key")) & (mid >= F.col(f"o.{s}")) & (mid <= F.col(f"o.{e}"))
    return pieces.alias("p").join(own.alias("o"), on, "left").drop("__key")


def sections(spans: DataFrame, lengths: DataFrame, key: str = "route") -> DataFrame:
    """Base and special sections of routes (route, length): each common part of crossings is a section of its own,
    with the types joined by ``+``."""
    whole = lengths.select(key, F.lit(0).cast("long").alias("s"), F.col("length").alias("e"))
    inside = spans.join(lengths, key).select(key, F.greatest("s", F.lit(0)).alias("s"), F.least("e", "length").alias("e"), "type").where("s < e")
    pieces = elementary(inside.select(key, "s", "e").unionByName(whole), key)
    types = F.array_join(F.array_sort(F.collect_set("type")), "+")
    found = covering(pieces, inside, key).groupBy(key, "a", "b").agg(types.alias("types"))
    return found.select(key, "a", "b", F.when(F.col("types") == "", "base").otherwise("special").alias("method"), "types")


def merge_equal(sections: DataFrame, key: str = "route", value: str = "types") -> DataFrame:
    """Neighbouring sections with equal value become one (run-length)."""
    w = Window.partitionBy(key).orderBy("a")
    new = F.when((F.lag(value).over(w) == F.col(value)) & (F.lag("b").over(w) == F.col("a")), 0).otherwise(1)
    return sections.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy(key, "run", value).agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run")


def complement(spans: DataFrame, lengths: DataFrame, key: str = "route") -> DataFrame:
    """The parts of routes that no span covers."""
    merged = merge_intervals(spans, key)
    w = Window.partitionBy(key).orderBy("s")
    ends = lengths.select(key, F.col("length").alias("s"), F.col("length").alias("e"))
    gaps = merged.unionByName(ends).withColumn("a", F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    return gaps.where("a < s").select(key, "a", F.col("s").alias("b")).join(lengths, key).select(key, "a", F.least("b", "length").alias("b")).where("a < b")


def intersect_domains(left: DataFrame, right: DataFrame, key: str = "route") -> DataFrame:
    """Intersection of two unions of closed whole-number intervals."""
    a, b = merge_intervals(left, key), merge_intervals(right, key).select(key, F.col("s").alias("s2"), F.col("e").alias("e2"))
    return a.join(b, key).select(key, F.greatest("s", "s2").alias("s"), F.least("e", "e2").alias("e")).where("s <= e")


def stations(pieces: DataFrame, key: str = "route", order: str = "seq", length: str = "length") -> DataFrame:
    """Start and end of each piece along its route."""
    w = Window.partitionBy(key).orderBy(order)
    end = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return pieces.withColumn("end_station", end).withColumn("start_station", F.col("end_station") - F.col(length))


def value_at(profile: DataFrame, queries: DataFrame, key: str = "route") -> DataFrame:
    """Linear interpolation of a profile (station, depth) at queried stations (q): one lead, then a range join on the route."""
    w = Window.partitionBy(key).orderBy("station")
    legs = profile.withColumns({"next_station": F.lead("station").over(w), "next_depth": F.lead("depth").over(w), "leg": F.row_number().over(w)}).where("next_station IS NOT NULL")
    hit = queries.join(legs, key).where("q >= station AND q <= next_station")
    first = hit.withColumn("r", F.row_number().over(Window.partitionBy(key, "q").orderBy("leg"))).where("r = 1")
    share = (F.col("q") - F.col("station")) / F.nullif(F.col("next_station") - F.col("station"), F.lit(0))
    return first.select(key, "q", F.coalesce(F.col("depth") + (F.col("next_depth") - F.col("depth")) * share, F.col("depth")).alias("depth"))


def mean_depth(profile: DataFrame, key: str = "route") -> DataFrame:
    """Length-weighted mean of a profile by trapezoids."""
    w = Window.partitionBy(key).orderBy("station")
    legs = profile.withColumns({"ds": F.lead("station").over(w) - F.col("station"), "mean": (F.lead("depth").over(w) + F.col("depth")) / 2})
    return legs.where("ds IS NOT NULL").groupBy(key).agg((F.sum(F.col("mean") * F.col("ds")) / F.nullif(F.sum("ds"), F.lit(0))).alias("depth"))


def cost_breakpoints(profile: DataFrame, key: str = "route", level: float = 3.0) -> DataFrame:
    """Stations of the profile's points and of its crossings of the ordinary depth."""
    w = Window.partitionBy(key).orderBy("station")
    nd, ns = F.lead("depth").over(w), F.lead("station").over(w)
    legs = profile.withColumns({"nd": nd, "ns": ns})
    cross = legs.where((F.col("depth") - level) * (F.col("nd") - level) < 0).select(key, (F.col("station") + (F.col("ns") - F.col("station")) * (level - F.col("depth")) / (F.col("nd") - F.col("depth"))).alias("station"))
    return profile.select(key, F.col("station").cast("double").alias("station")).unionByName(cross).distinct()
