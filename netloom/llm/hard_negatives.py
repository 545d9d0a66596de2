"""Operator 11, hard negatives by dual-tree search.

Rows are vectors of whole numbers, ``floor(scale * x)``. For each anchor its
positives are the best rows of its label, and for each positive the negatives
are the best rows of other labels whose score lies from ``low`` to ``high``
percent of the positive's.

A partition tree, fitted on at most ``SAMPLE_ROWS`` rows, sends every row to a
cell; cells are dealt into blocks of bounded size, a crowded
cell into several, and anchors into groups in the same way. A task gets one block and one group of anchors. It builds a tree over
each and walks both at once: for a pair of nodes the inner products lie within
``<p, q> +- (|p| r_q + |q| r_p + r_p r_q)`` (centres p, q, radii r), so a node of
candidates is left out for a whole node of anchors when that interval misses
what any of them still wants; leaf pairs are taken best bound first and scored
exactly. A task hands on at most ``top`` rows for each anchor and slot, which a
window merges; the tree decides only what is looked at, never what is found.

Every pair of an anchor group and a block is a task of its own, so blocks meet
the query set in pieces and no task or driver holds more than one of each.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part; shorter vectors are as if filled up with
zeros; components beyond +-2**16 count as that; rows that share an id are
different rows, also as anchors; an anchor without a positive, and a positive
without a negative in its range, give no row; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, sampled, trim

#: Rows that the partition tree is fitted on, about, and its levels at most.
SAMPLE_ROWS, DEPTH = 8192, 12
#: Components that a block, or a group of anchors, holds at most, about; small tables make smaller blocks, down to ``LEAST_ROWS`` rows.
COMPONENTS, LEAST_ROWS = 1 << 21, 2048
LEAF, ANCHOR_LEAF = 256, 64
#: With components within this bound a score times the rows of a block fits a long, for vectors of up to 8,192 components.
LARGEST = 1 << 16
NONE = np.iinfo(np.int64).min


class Tree:
    """Nodes over the rows of a matrix, each a range of ``order``, halved along the coordinate that varies most; ``first`` and ``second`` are children, -1 at leaves."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        lo, hi, first, second, centre, radius = [], [], [], [], [], []
        waiting = [(0, len(x), None, None)] if len(x) else []
        while waiting:
            a, b, side, parent = waiting.pop()
            if side is not None:
                side[parent] = len(lo)
            own = x[self.order[a:b]]
            middle = own.mean(0)
            reach = float(np.sqrt(((own - middle) ** 2).sum(1).max()))
            if b - a > leaf and reach > 0:
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, int(own.var(0).argmax())], half)]
                waiting += [(a + half, b, second, len(lo)), (a, a + half, first, len(lo))]
            for column, value in zip((lo, hi, first, second, centre, radius), (a, b, -1, -1, middle, reach), strict=True):
                column.append(value)
        self.lo, self.hi, self.first, self.second = (np.array(c, int) for c in (lo, hi, first, second))
        self.centre = np.array(centre).reshape(len(lo), x.shape[1])
        self.radius = np.array(radius) * (1 + 1e-9) + 1e-6
        self.norm = np.sqrt((self.centre**2).sum(1)) * (1 + 1e-9)

    def bounds(self, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smallest ``least`` and the largest ``most`` of each node's rows."""
        lo, hi = np.empty(len(self.lo)), np.empty(len(self.lo))
        for i, (a, b) in enumerate(zip(self.lo.tolist(), self.hi.tolist(), strict=True)):
            lo[i], hi[i] = least[self.order[a:b]].min(), most[self.order[a:b]].max()
        return lo, hi


def leaf_pairs(q: Tree, r: Tree, least: np.ndarray, most: np.ndarray) -> list[tuple[int, int, float]]:
    """(anchor leaf, candidate leaf, upper bound), best bound first, of the leaf pairs all of whose ancestors' intervals meet
    what the anchor node wants, ``least`` to ``most``."""
    a, b, out = np.zeros(1, int), np.zeros(1, int), []
    while len(a):
        middle = np.einsum("ij,ij->i", q.centre[a], r.centre[b])
        reach = q.norm[a] * r.radius[b] + r.norm[b] * q.radius[a] + q.radius[a] * r.radius[b]
        reach = reach + 1e-6 + 1e-9 * (np.abs(middle) + reach)
        keep = (middle + reach >= least[a]) & (middle - reach <= most[a])
        a, b, upper = a[keep], b[keep], (middle + reach)[keep]
        last_a, last_b = q.first[a] < 0, r.first[b] < 0
        done = last_a & last_b
        out += zip(a[done].tolist(), b[done].tolist(), upper[done].tolist(), strict=True)
        a, b, of_a = a[~done], b[~done], (last_b | (~last_a & (q.radius[a] >= r.radius[b])))[~done]  # the wider node is opened
        x, y, u, v = a[of_a], b[of_a], a[~of_a], b[~of_a]
        a, b = np.concatenate((q.first[x], q.second[x], u, u)), np.concatenate((y, y, r.first[v], r.second[v]))
    return sorted(out, key=lambda pair: -pair[2])


def search(anchors: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray], top: int) -> tuple[np.ndarray, ...]:
    """(anchor, slot, row, score) of the ``top`` best rows of each slot of each anchor: scores within the slot's whole-number
    bounds ``low`` to ``high`` (anchor, slot), equal ones by ``place``, pairs that ``allowed`` masks in only."""
    places, slots = len(rows), low.shape[1]
    # one number orders score, then place; what a slot starts from lies just below its range
    best = np.repeat((low * places - 1)[:, :, None], top, 2)
    q, r = Tree(anchors, ANCHOR_LEAF), Tree(rows, LEAF)
    for i, j, upper in leaf_pairs(q, r, *q.bounds(low.min(1).astype(float), high.max(1).astype(float))):
        own, others = q.order[q.lo[i] : q.hi[i]], r.order[r.lo[j] : r.hi[j]]
        if (math.floor(upper) + 1) * places < best[own, :, top - 1].min():
            continue
        score = np.rint(anchors[own] @ rows[others].T).astype(np.int64)  # whole numbers below 2**53: exact
        key = np.where(allowed(own, others), score * places + (places - 1 - place[others]), NONE)
        for s in range(slots):
            found = np.where(score <= high[own, s][:, None], key, NONE)
            better = np.flatnonzero(found.max(1) > best[own, s, top - 1])
            both = np.concatenate((best[own[better], s], found[better]), 1)
            best[own[better], s] = -np.sort(-np.partition(both, both.shape[1] - top, 1)[:, -top:], 1)
    anchor, slot, nth = np.nonzero(best >= (low * places)[:, :, None])
    key = best[anchor, slot, nth]
    row_at = np.empty(places, int)
    row_at[place] = np.arange(places)
    return anchor, slot, row_at[places - 1 - key % places], key // places


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of one matrix, filled up with zeros."""
    lists = column.combine_chunks()
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Cells:
    """A partition tree of planes, fitted on a sample: at each node a row goes to the side of the median that its projection lies on."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.plane, self.at = np.zeros((1 << depth, sample.shape[1])), np.zeros(1 << depth)
        parts = {1: sample}
        for node in range(1, 1 << depth):
            own = parts.pop(node)
            if len(own) > 1:
                centred = own - own.mean(0)
                direction = centred[(centred**2).sum(1).argmax()]
                for _ in range(8):  # power steps towards the direction of most variance
                    direction = centred.T @ (centred @ direction)
                    direction = direction / max(float(np.sqrt((direction**2).sum())), 1e-12)
                self.plane[node], self.at[node] = direction, np.median(own @ direction)
            right = own @ self.plane[node] > self.at[node]
            if 2 * node < 1 << depth:
                parts[2 * node], parts[2 * node + 1] = own[~right], own[right]

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), int)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("ij,ij->i", x, self.plane[node]) > self.at[node])
        return node - (1 << self.depth)


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column, scale: float) -> DataFrame:
    """rid, id, label, anchor, vec (array<int>) of the rows that take part."""
    v = F.col(f"`{vector_col}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), F.lit(float(scale)) * x.cast("double")))).cast("int"))
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.when(fine, whole).alias("vec"))
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").withColumn("rid", F.monotonically_increasing_id())


def deal(counts: list[tuple[int, int]], size: int) -> tuple[list[tuple[int, int, int]], int]:
    """((cell, first block, blocks), number of blocks): neighbouring cells share a block as long as they fit, a crowded one takes several."""
    out, block, room = [], -1, 0
    for cell, n in sorted(counts):
        if n > room:
            parts = max(1, math.ceil(n / size))
            out.append((cell, block + 1, parts))
            block, room = block + parts, size - n if parts == 1 else 0
        else:
            out.append((cell, block, 1))
            room -= n
    return out, block + 1


def hard_negatives(
    table: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column, *, scale: float = 256, low: int = 80, high: int = 100, positives: int = 5, negatives: int = 5
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``anchor`` tells which rows are anchors."""
    spark = table.sparkSession
    rows = durable(whole_vectors(table, id_col, vector_col, label, anchor, scale), "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    width = max(1, width or 0)
    if width > 8192:
        raise ValueError("vectors of more than 8,192 components")
    size = min(max(1, COMPONENTS // width), max(LEAST_ROWS, n // 32))
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, n / size)))))
    sample = sampled(rows, min(1.0, SAMPLE_ROWS / max(1, n)), "cells", "rid").select("vec").toArrow().column(0) if depth else None
    cells = Cells(matrix(sample, width), depth) if depth else Cells(np.zeros((0, width)), 0)

    def locate(batches):
        for batch in batches:
            cell = cells.of(matrix(pa.chunked_array([batch.column("vec")]), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=[*batch.schema.names, "cell"])

    placed = durable(rows.mapInArrow(locate, "id long, label long, anchor boolean, vec array<int>, rid long, cell int"), "placed")
    counts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("anchors")).collect()  # at most 2**DEPTH rows
    blocks, n_blocks = deal([(r.cell, r.n) for r in counts], size)
    groups, n_groups = deal([(r.cell, r.anchors) for r in counts if r.anchors], max(1, COMPONENTS // width))

    def dealt(df: DataFrame, cells: list[tuple[int, int, int]], name: str, seed: int) -> DataFrame:
        found = spark.createDataFrame(cells, "cell int, first int, parts int")
        return df.join(F.broadcast(found), "cell").withColumn(name, F.col("first") + F.pmod(F.xxhash64("rid", F.lit(seed)), F.col("parts").cast("long")).cast("int")).drop("cell", "first", "parts")

    each_group = F.explode(F.sequence(F.lit(0), F.lit(max(0, n_groups - 1))))
    each_block = F.explode(F.sequence(F.lit(0), F.lit(max(0, n_blocks - 1))))
    candidates = dealt(placed.drop("anchor"), blocks, "block", 1).withColumn("group", each_group)
    queries = dealt(placed.where("anchor").drop("anchor"), groups, "group", 2).withColumn("block", each_block)

    def meet(left: DataFrame, kernel) -> DataFrame:
        own = left.select(*[F.col(c).alias(c) for c in left.columns])  # both sides come from one table
        return own.groupBy("group", "block").cogroup(candidates.groupBy("group", "block")).applyInArrow(kernel, "anchor long, anchor_id long, slot int, of_id long, of_score long, row long, id long, score long")

    def column(t: pa.Table, name: str) -> np.ndarray:
        return t.column(name).to_numpy()

    def table_of(left, right, a, slot, of_id, of_score, b, score):
        values = (column(left, "rid")[a], column(left, "id")[a], slot.astype(np.int32), of_id, of_score, column(right, "rid")[b], column(right, "id")[b], score)
        return pa.Table.from_arrays([pa.array(v) for v in values], names=["anchor", "anchor_id", "slot", "of_id", "of_score", "row", "id", "score"])

    def ranks(ids: np.ndarray, rid: np.ndarray) -> np.ndarray:
        place = np.empty(len(ids), np.int64)
        place[np.lexsort((rid, ids))] = np.arange(len(ids))
        return place

    def same_label(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y, mine, theirs, me, them, ids = matrix(left.column("vec"), width), matrix(right.column("vec"), width), column(left, "label"), column(right, "label"), column(left, "rid"), column(right, "rid"), column(right, "id")
        found = [tuple(np.zeros(0, np.int64) for _ in range(3))]
        by_mine, by_theirs = np.argsort(mine, kind="stable"), np.argsort(theirs, kind="stable")
        for value in np.intersect1d(mine, theirs).tolist():
            own = by_mine[slice(*(np.searchsorted(mine, value, s, sorter=by_mine) for s in ("left", "right")))]
            others = by_theirs[slice(*(np.searchsorted(theirs, value, s, sorter=by_theirs) for s in ("left", "right")))]
            bound = np.full((len(own), 1), (1 << 61) // len(others))
            a, _, b, score = search(x[own], y[others], -bound, bound, ranks(ids[others], them[others]), lambda i, j, o=own, p=others: me[o[i]][:, None] != them[p[j]][None, :], positives)
            found.append((own[a], others[b], score))
        a, b, score = (np.concatenate(z) for z in zip(*found, strict=True))
        trim()
        nothing = np.zeros(len(a), np.int64)
        return table_of(left, right, a, nothing, nothing, nothing, b, score)

    def other_label(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, theirs = column(left, "label"), column(right, "label")
        found = [tuple(np.zeros(0, np.int64) for _ in range(4))]
        of_id, of_score = np.zeros((left.num_rows, positives), np.int64), np.zeros((left.num_rows, positives), np.int64)
        have = left.column("positives").combine_chunks()
        sizes = have.value_lengths().to_numpy(zero_copy_only=False)
        filled = np.arange(positives) < sizes[:, None]
        of_id[filled], of_score[filled] = (have.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("id", "score"))
        if left.num_rows and right.num_rows:
            least, most = -(-low * of_score // 100), high * of_score // 100
            least[~filled], most[~filled] = 1, 0  # no score lies between
            place = ranks(column(right, "id"), column(right, "rid"))
            found.append(search(matrix(left.column("vec"), width), matrix(right.column("vec"), width), least, most, place, lambda i, j: mine[i][:, None] != theirs[j][None, :], negatives))
        a, slot, b, score = (np.concatenate(z) for z in zip(*found, strict=True))
        trim()
        return table_of(left, right, a, slot, of_id[a, slot], of_score[a, slot], b, score)

    def first(found: DataFrame, top: int) -> DataFrame:
        w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)

    near = durable(first(meet(queries, same_label), positives), "positives")
    chosen = near.groupBy(F.col("anchor").alias("rid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))), lambda s: F.struct(s["id"].alias("id"), s["score"].alias("score"))).alias("positives"))
    with_positives = queries.join(chosen, "rid")
    return first(meet(with_positives, other_label), negatives).select("anchor_id", F.col("of_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("of_score").alias("positive_score"), F.col("score").alias("negative_score"))


ORACLE_SQL = """
WITH known AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM known a JOIN known r ON a.vec_id <> r.vec_id
  WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
