"""Optional: which existing pipes new loads make too small. Kept apart from calculated costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import FLOW, LENGTH, diameter_for
from .trees import subtree_sums


def upstream_loads(tree: DataFrame, loads: DataFrame) -> DataFrame:
    """node, s, e, flow: what new loads put on each existing edge. A tie-in (node, station, flow) loads its own edge up to
    its station; what hangs further down loads the whole edge and comes as one row. Stations count from the upstream end."""
    own = loads.groupBy("node").agg(F.sum("flow").cast(FLOW).alias("own"))
    held = tree.select("node", "up", "length").join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)).cast(FLOW))
    below = held.join(subtree_sums(held, "own", FLOW), "node").select("node", F.lit(0).cast(LENGTH).alias("s"), F.col("length").cast(LENGTH).alias("e"), (F.col("total") - F.col("own")).cast(FLOW).alias("flow")).where("flow <> 0")
    return loads.select("node", F.lit(0).cast(LENGTH).alias("s"), F.col("station").cast(LENGTH).alias("e"), F.col("flow").cast(FLOW)).unionByName(below)


def rebuilt_pieces(tree: DataFrame, loads: DataFrame) -> DataFrame:
    """Pieces of existing edges (node, length, flow, diameter) whose total flow needs a larger diameter than they have."""
    contributions = upstream_loads(tree, loads)
    cuts = contributions.select("node", F.explode(F.array("s", "e")).alias("a")).distinct()
    pieces = cuts.withColumn("b", F.lead("a").over(Window.partitionBy("node").orderBy("a"))).where("b IS NOT NULL")
    over = pieces.join(contributions, "node").where("(a + b) / 2 BETWEEN s AND e").groupBy("node", "a", "b").agg(F.sum("flow").cast(FLOW).alias("added"))
    joined = over.join(tree.select("node", "flow", "diameter"), "node").withColumn("total", (F.col("flow") + F.col("added")).cast(FLOW))
    return joined.withColumn("needed", diameter_for(F.col("total"))).where("needed > diameter")
