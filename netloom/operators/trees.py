"""Forests of any depth and size by pointer doubling: log2(depth) rounds of joins, no recursion and no closure table.

A forest is a table of nodes, each with a pointer to the next node on its way
up, null at the roots. A round doubles the reach of every pointer. Tables stay
as long as the forest, and each round is cut at a checkpoint. What still points
on after as many rounds as the longest possible chain needs lies on or below a
cycle.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import SMALL, by_size, map_groups
from .lineage import cut


#: Rows from which on tables meet by exchanges. Spark goes by the size of files, and written rounds are packed so well that it
#: would send tables of a million rows through the driver, in each round again.
WIDE = 100_000


def rounds(rows: int) -> int:
    """Doublings that take every chain of a table of this many rows to its end."""
    return max(1, rows.bit_length())


def met_by(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be joined in a step over ``rows`` rows: from ``WIDE`` on never broadcast."""
    return df.hint("merge") if rows >= WIDE else df


def chase(links: DataFrame, node: str = "node", up: str = "up", weight: str | None = None) -> DataFrame:
    """node, end, hops: where the pointers of every node lead, and in how many steps; with ``weight`` also ``total``, the sum of the
    weights of the nodes left on the way, the first among them and the end not. ``links`` has one row a node; nodes on or
    below a cycle are left out. A pointer out of the table ends there."""
    base = links.select(F.col(node).alias("node"), F.col(up).alias("next"), (F.col(weight).cast("decimal(28,3)") if weight else F.lit(0)).alias("own"))
    leaves = F.col("next").isNotNull()
    now = cut(base.select("node", F.coalesce("next", "node").alias("end"), leaves.cast("long").alias("hops"), F.when(leaves, F.col("own")).otherwise(0).alias("total"), (~leaves).alias("done")))
    kind, size = now.schema["total"].dataType, now.count()
    for _ in range(rounds(size)):
        if now.where("NOT done").isEmpty():
            break
        there = now.select(F.col("node").alias("end"), F.col("end").alias("far"), F.col("hops").alias("more"), F.col("total").alias("further"), F.col("done").alias("stops"))
        open_rows = now.where("NOT done").join(met_by(there, size), "end", "left")
        moved = open_rows.select("node", F.coalesce("far", "end").alias("end"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), (F.col("total") + F.coalesce("further", F.lit(0))).cast(kind).alias("total"), F.coalesce("stops", F.lit(True)).alias("done"))
        now = cut(now.where("done").unionByName(moved))
    return now.where("done").select("node", "end", "hops", *["total"] * (weight is not None))


def from_ends(up: dict) -> list:
    """The nodes of a small forest (node -> the node above it) in an order in which each comes after the one above; nodes on or below
    a cycle are left out."""
    below: dict = {}
    order = []
    for node, above in up.items():
        if above in up:
            below.setdefault(above, []).append(node)
        else:
            order.append(node)
    for node in order:
        order += below.get(node, ())
    return order


def chase_within(links: DataFrame, within: str, small: int = SMALL) -> DataFrame:
    """node, end, hops of ``chase`` for links (node, up and ``within``, which no pointer leaves; read twice): what has up to ``small``
    nodes is one group of a task, the rest goes by doubling."""
    few, many = by_size(links.select(within, "node", "up"), within, small)

    def kernel(table: SimpleNamespace) -> list[tuple]:
        up = dict(zip(table.node, table.up, strict=True))
        end: dict = {}
        for node in from_ends(up):
            above = up[node]
            end[node] = (node, 0) if above is None else end[above][:1] + (end[above][1] + 1,) if above in up else (above, 1)
        return [(node, *e) for node, e in end.items()]

    kind = links.schema["node"].dataType.simpleString()
    found = map_groups(few, within, [], kernel, f"node {kind}, end {kind}, hops long", ["node", "end", "hops"], nulls=True)
    return found if many is None else found.unionByName(chase(many))


def subtree_sums(forest: DataFrame, value: str, kind: str) -> DataFrame:
    """node, total: the sum of ``value`` over the subtree of each node of ``forest`` (node, up, value)."""
    return subtree(forest, value, kind, F.sum, lambda own, gain: own + F.coalesce(gain, F.lit(0)), F.lit(0))


def subtree_max(forest: DataFrame, value: str, kind: str) -> DataFrame:
    """node, total: the largest ``value`` in the subtree of each node of ``forest`` (node, up, value)."""
    return subtree(forest, value, kind, F.max, F.greatest, F.lit(None))


def subtree(forest: DataFrame, value: str, kind: str, gather: Callable[[str], Column], combine: Callable[[Column, Column], Column], missing: Column) -> DataFrame:
    """node, total: ``value`` gathered over the subtree of each node.

    After k rounds a node holds what its descendants less than 2^k steps below it give, and points 2^k steps up; what
    its descendants at exactly that distance hold is what it lacks. A cycle raises NETWORK_CYCLE."""
    now = cut(forest.select("node", F.col("up").alias("at"), F.coalesce(F.col(value), missing).cast(kind).alias("total")))
    size = now.count()
    for _ in range(rounds(size) + 1):
        climbing = now.where("at IS NOT NULL")
        if climbing.isEmpty():
            return now.select("node", "total")
        gained = climbing.groupBy(F.col("at").alias("node")).agg(gather("total").alias("gain"))
        above = climbing.select(F.col("node").alias("at"), F.col("at").alias("far"))
        # nodes that are done have no pointer, and would all meet in one task
        moved = climbing.select("node", "at").join(met_by(above, size), "at", "left").select("node", "far")
        summed = now.join(met_by(gained, size), "node", "left").select("node", combine(F.col("total"), F.col("gain")).cast(kind).alias("total"))
        now = cut(summed.join(met_by(moved, size), "node", "left").select("node", F.col("far").alias("at"), "total"))
    raise ValueError("NETWORK_CYCLE")
