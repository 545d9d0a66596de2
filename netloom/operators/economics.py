"""Costs, scores and ranks of network variants in exact decimals, rounded piece by piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import FLOW, LENGTH, MONEY, PENALTY_FIXED, PENALTY_PER_FLOW, TIE_IN_COST, chamber_cost, diameter_for

CROSSING_MULTIPLIER = {"base": "1.00", "road": "1.60", "tram_tracks": "1.75", "gas_pipeline": "1.25", "power_cable": "1.15", "heat_network": "1.05"}
ARCHIVE_SIZE = 8


def crossing_multiplier(types: Column) -> Column:
    """The largest multiplier among types joined by ``+``; unknown ones count as plain."""
    one = lambda t: F.coalesce(*[F.when(t == k, F.lit(v).cast("decimal(6,3)")) for k, v in CROSSING_MULTIPLIER.items()], F.lit("1.00").cast("decimal(6,3)"))
    return F.array_max(F.transform(F.split(types, r"\+"), one))


def depth_multiplier(depth: Column) -> Column:
    return F.when(depth <= 3, F.lit("1").cast("decimal(8,4)")).otherwise((1 + (depth - 3) * F.lit("0.10").cast("decimal(4,2)")).cast("decimal(8,4)"))


def edge_cost(rate: Column, length: Column, crossing: Column, depth: Column | None = None) -> Column:
    cost = rate.cast("decimal(12,0)") * length.cast(LENGTH) * crossing_multiplier(crossing)
    return F.round(cost if depth is None else cost * depth_multiplier(depth), 2).cast(MONEY)


def unconnected_penalty(flow: Column) -> Column:
    return F.round(F.lit(PENALTY_FIXED).cast("decimal(12,0)") + F.lit(PENALTY_PER_FLOW).cast("decimal(12,0)") * flow.cast(FLOW), 2).cast(MONEY)


def score(cost: Column, length: Column) -> Column:
    """0.7 * cost / 25 million + 0.3 * length / 100, quotients at scale 12, the result at scale 9."""
    a = F.round(cost.cast("decimal(26,2)") / F.lit("25000000").cast("decimal(8,0)"), 12).cast("decimal(30,12)")
    b = F.round(length.cast("decimal(20,3)") / F.lit("100").cast("decimal(3,0)"), 12).cast("decimal(30,12)")
    return F.round((a * F.lit("0.7").cast("decimal(1,1)") + b * F.lit("0.3").cast("decimal(1,1)")).cast("decimal(36,13)"), 9).cast("decimal(38,9)")


def price_edges(edges: DataFrame, pipes: DataFrame) -> DataFrame:
    """Edges with diameter by flow and cost. The pipe catalog has 18 rows, so it is broadcast."""
    sized = edges.withColumn("diameter", diameter_for(F.col("flow")))
    rates = F.broadcast(pipes.select("diameter", "rate", "rebuild_rate"))
    return sized.join(rates, "diameter", "left").withColumn("cost", edge_cost(F.col("rate"), F.col("length"), F.col("crossing")))


def rebuild_cost(edges: DataFrame, pipes: DataFrame) -> DataFrame:
    """Cost of rebuilding edges whose needed diameter is above the existing one; kept apart from calculated costs."""
    needed = edges.withColumn("needed", diameter_for(F.col("flow"))).where(F.col("needed") > F.col("diameter"))
    rates = F.broadcast(pipes.select(F.col("diameter").alias("needed"), "rebuild_rate"))
    return needed.join(rates, "needed").withColumn("cost", F.round(F.col("rebuild_rate") * F.col("length"), 2).cast(MONEY))


def variant_economics(edges: DataFrame, unconnected: DataFrame, pipes: DataFrame, roots: Column) -> DataFrame:
    """One row per variant: pipes, chambers, tie-ins (edges that leave an existing chamber, ``roots``), penalty, cost, length, score.
    Edges are exchanged once, by variant: each counts with its first end, nodes are added up first, then variants."""
    priced = price_edges(edges, pipes).withColumn("tie", roots).repartition("variant")
    end = lambda c, first: F.struct(F.col(c).alias("node"), F.lit(first).alias("first"))
    ends = priced.select("variant", F.explode(F.array(end("up_node", True), end("down_node", False))).alias("e"), "diameter", "cost", "length", "tie")
    own = F.col("e.first")
    nodes = ends.groupBy("variant", F.col("e.node").alias("node")).agg(F.max("diameter").alias("diameter"), F.count("*").alias("degree"), F.sum(F.when(own, F.col("cost"))).alias("pipes"), F.sum(F.when(own, F.col("length"))).alias("length"), F.count_if(own & F.col("tie")).alias("tie_ins"))
    zero = F.lit(0).cast(MONEY)
    chambers = F.coalesce(F.sum(F.when(F.col("degree") >= 3, chamber_cost(F.col("diameter")))).cast(MONEY), zero)
    sums = nodes.groupBy("variant").agg(F.sum("pipes").cast(MONEY).alias("pipes"), F.sum("length").cast(LENGTH).alias("length"), F.sum("tie_ins").alias("tie_ins"), chambers.alias("chambers"))
    penalty = unconnected.groupBy("variant").agg(F.sum(F.when(F.col("unconnected") > 0, unconnected_penalty(F.col("unconnected_flow"))).otherwise(0)).cast(MONEY).alias("penalty"))
    out = sums.join(penalty, "variant", "left").withColumn("penalty", F.coalesce("penalty", zero))
    out = out.withColumn("construction", (F.col("pipes") + F.col("chambers") + F.col("tie_ins") * F.lit(TIE_IN_COST)).cast(MONEY))
    out = out.withColumn("cost", (F.col("construction") + F.col("penalty")).cast(MONEY))
    return out.withColumn("score", score(F.col("cost"), F.col("length")))


def archive(variants: DataFrame, hash_col: str, size: int = ARCHIVE_SIZE, group: str | None = None) -> DataFrame:
    """The best ``size`` variants by score, cost, length, id after keeping the best of each geometry hash."""
    order = ["score", "cost", "length", "variant"]
    keys = [group] if group else []
    best = F.row_number().over(Window.partitionBy(*keys, hash_col).orderBy(*order))
    kept = variants.withColumn("best", best).where("best = 1").drop("best")
    if group:
        return kept.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= size)
    top = kept.orderBy(*order).limit(size)  # a bounded top k, so one task may number it
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def pick_roles(variants: DataFrame, group: str) -> DataFrame:
    """Per group, among the variants with the widest coverage: cheapest, shortest within 10 m, 1.30 times the length and
    1.25 million of the absolute shortest by fewest bends, and balanced by score. One aggregate per role, no sort."""
    widest = variants.withColumn("most", F.max("coverage").over(Window.partitionBy(group))).where("coverage = most")
    w = Window.partitionBy(group)
    least = F.min(F.struct("length", "cost", "variant")).over(w)
    near = (F.col("length") <= F.col("least.length") + 10) & (F.col("length") <= F.col("least.length") * F.lit("1.30").cast("decimal(4,2)")) & (F.col("cost") <= F.col("least.cost") + 1_250_000)
    framed = widest.withColumn("least", least)
    return framed.groupBy(group).agg(
        F.min_by("variant", F.struct("score", "cost", "length", "variant")).alias("balanced"),
        F.min_by("variant", F.when(near, F.struct("bends", "length", "cost", "variant"))).alias("shortest"),
        F.min_by("variant", F.struct("cost", "length", "variant")).alias("cheapest"),
    )


def cheaper_to_skip(spurs: DataFrame) -> DataFrame:
    """Whether the marginal cost of a demand's own spur is above its penalty."""
    return spurs.withColumn("skip", F.col("cost") > unconnected_penalty(F.col("flow")))
