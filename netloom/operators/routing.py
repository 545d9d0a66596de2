"""Routing kernels: shortest admissible routes around boxes, attachment trees, chains of degree-two nodes.

Each problem is a group of rows and is searched in its task with exact integer
coordinates and total tie-breaks, so results do not depend on partitioning.
"""

from __future__ import annotations

import heapq
import math
from itertools import pairwise
from types import SimpleNamespace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import map_groups
from .lineage import cut
from .trees import chase

CORRIDORS_M = (75, 200, 600)
BEND_PENALTY = 1.15
BRANCHES = 4

Point = tuple[int, int]


def blocked(a: Point, b: Point, boxes: list[tuple[int, int, int, int]]) -> bool:
    """Whether a segment passes through the inside of an axis-parallel box; touching its border is allowed."""
    for x1, y1, x2, y2 in boxes:
        if max(a[0], b[0]) <= x1 or min(a[0], b[0]) >= x2 or max(a[1], b[1]) <= y1 or min(a[1], b[1]) >= y2:
            continue
        t0, t1, hit = 0.0, 1.0, True
        for start, step, lo, hi in ((a[0], b[0] - a[0], x1, x2), (a[1], b[1] - a[1], y1, y2)):
            if step == 0:
                hit &= lo < start < hi
                continue
            u, v = sorted(((lo - start) / step, (hi - start) / step))
            t0, t1 = max(t0, u), min(t1, v)
        if hit and t1 - t0 > 1e-12:
            return True
    return False


def turn_degrees(a: Point, b: Point, c: Point) -> float:
    ux, uy, vx, vy = b[0] - a[0], b[1] - a[1], c[0] - b[0], c[1] - b[1]
    return math.degrees(math.atan2(abs(ux * vy - uy * vx), ux * vx + uy * vy))


def shortest_route(start: Point, goal: Point, boxes: list[tuple[int, int, int, int]], least_turn: float = 60.0, margin: int = 0) -> list[Point] | None:
    """A* over the corners of boxes and the two ends. A state is (previous, node), so that turns can be judged: a
    turn is up to half a degree or from ``least_turn`` to 90 degrees. Corridors around the direct line widen until
    one has a route."""
    for corridor in CORRIDORS_M:
        lo = (min(start[0], goal[0]) - corridor, min(start[1], goal[1]) - corridor)
        hi = (max(start[0], goal[0]) + corridor, max(start[1], goal[1]) + corridor)
        near = [b for b in boxes if b[0] <= hi[0] and b[2] >= lo[0] and b[1] <= hi[1] and b[3] >= lo[1]]
        xs = sorted({start[0], goal[0], *(v for b in near for v in (b[0] - margin, b[2] + margin))})
        ys = sorted({start[1], goal[1], *(v for b in near for v in (b[1] - margin, b[3] + margin))})
        nodes = sorted({start, goal, *((x, y) for x in xs for y in ys if lo[0] <= x <= hi[0] and lo[1] <= y <= hi[1])})
        queue = [(math.dist(start, goal), 0.0, start, start)]
        done: set[tuple[Point, Point]] = set()
        came: dict[tuple[Point, Point], tuple[Point, Point]] = {}
        known: dict[tuple[Point, Point], float] = {(start, start): 0.0}
        while queue:
            _, cost, node, before = heapq.heappop(queue)
            if (before, node) in done:
                continue
            done.add((before, node))
            if node == goal:
                path, state = [goal], (before, node)
                while state in came:
                    state = came[state]
                    path.append(state[1])
                return path[::-1]
            for other in nodes:
                if other == node or other == before or blocked(node, other, near):
                    continue
                turn = 0.0 if node == start else turn_degrees(before, node, other)
                if turn > 0.5 and not least_turn - 1e-9 <= turn <= 90 + 1e-9:
                    continue
                price = cost + math.dist(node, other) * (BEND_PENALTY if turn > 0.5 else 1.0)
                state = (node, other)
                if price < known.get(state, math.inf):
                    known[state], came[state] = price, (before, node)
                    heapq.heappush(queue, (price + math.dist(other, goal), price, other, node))
    return None


def route_pairs(pairs: DataFrame, boxes: DataFrame, least_turn: float = 60.0) -> DataFrame:
    """Route of every pair (problem, pair, ax, ay, bx, by) around its problem's boxes (problem, x1, y1, x2, y2): length and
    number of bends; null where there is none."""
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("problem", "pair")}
    whole = lambda *names: [F.col(c).cast("long").alias(n) for c, n in zip(names, ("ax", "ay", "bx", "by"), strict=True)]
    rows = boxes.select("problem", F.lit(0).alias("kind"), F.lit(None).cast(kinds["pair"]).alias("pair"), *whole("x1", "y1", "x2", "y2"))
    rows = rows.unionByName(pairs.select("problem", F.lit(1).alias("kind"), "pair", *whole("ax", "ay", "bx", "by")))

    def kernel(table: SimpleNamespace) -> list[tuple]:
        first = table.kind.index(1) if table.kind[-1] else len(table.kind)
        ends = list(zip(table.ax, table.ay, table.bx, table.by, strict=True))
        found = []
        for pair, (ax, ay, bx, by) in zip(table.pair[first:], ends[first:], strict=True):
            path = shortest_route((ax, ay), (bx, by), ends[:first], least_turn)
            length = sum(math.dist(a, b) for a, b in pairwise(path)) if path else None
            found.append((table.problem[0], pair, length, len(path) - 2 if path else None))
        return found

    schema = f"problem {kinds['problem']}, pair {kinds['pair']}, length double, bends int"
    return map_groups(rows, "problem", ["kind", "pair", "ax", "ay", "bx", "by"], kernel, schema, ["problem", "pair", "length", "bends"], nulls=True)


def attach_terminals(edges: list[tuple[str, str, int]], root: str, terminals: list[str], capacity: int = BRANCHES) -> list[tuple[str, str]]:
    """Greedy tree: again and again the terminal nearest to the tree joins it by a shortest path; a node takes at
    most ``capacity`` edges."""
    near: dict[str, list[tuple[str, int]]] = {}
    for a, b, w in sorted(edges):
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    degree: dict[str, int] = {}
    tree, used, left = {root}, [], set(terminals) - {root}
    while left:
        best = {n: (0, n, None) for n in tree if degree.get(n, 0) < capacity}
        queue = [(0, n) for n in sorted(best)]
        back: dict[str, str] = {}
        dist = {n: 0 for n in best}
        found = None
        while queue:
            d, n = heapq.heappop(queue)
            if d > dist.get(n, math.inf):
                continue
            if n in left:
                found = n
                break
            for m, w in near.get(n, ()):
                if m not in tree and d + w < dist.get(m, math.inf):
                    dist[m], back[m] = d + w, n
                    heapq.heappush(queue, (d + w, m))
        if found is None:
            break
        n = found
        while n in back:
            used.append((back[n], n))
            degree[n], degree[back[n]] = degree.get(n, 0) + 1, degree.get(back[n], 0) + 1
            tree.add(n)
            left.discard(n)
            n = back[n]
    return used


def closure_tree(edges: list[tuple[str, str, int]], terminals: list[str]) -> list[tuple[str, str]]:
    """Union of the shortest paths along a minimum spanning tree of the terminals' metric closure."""
    near: dict[str, list[tuple[str, int]]] = {}
    for a, b, w in sorted(edges):
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    paths, pairs = {}, []
    for t in sorted(terminals):
        dist, back, queue = {t: 0}, {}, [(0, t)]
        while queue:
            d, n = heapq.heappop(queue)
            if d > dist[n]:
                continue
            for m, w in near.get(n, ()):
                if d + w < dist.get(m, math.inf):
                    dist[m], back[m] = d + w, n
                    heapq.heappush(queue, (d + w, m))
        paths[t] = back
        pairs += [(dist[u], t, u) for u in terminals if u > t and u in dist]
    group = {t: t for t in terminals}

    def top(t: str) -> str:
        while group[t] != t:
            t = group[t]
        return t

    out: set[tuple[str, str]] = set()
    for _, a, b in sorted(pairs):
        if top(a) != top(b):
            group[top(b)] = top(a)
            n = b
            while n != a:
                out.add(tuple(sorted((paths[a][n], n))))
                n = paths[a][n]
    return sorted(out)


def corridor_trees(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """Tree edges of every problem: edges (problem, a, b, w), terminals (problem, node, is_root)."""
    kind = edges.schema["problem"].dataType.simpleString()
    rows = edges.select("problem", "a", "b", F.col("w").cast("long").alias("w"), F.lit(None).cast("boolean").alias("is_root"))
    rows = rows.unionByName(terminals.select("problem", F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("long").alias("w"), "is_root"))

    def kernel(table: SimpleNamespace) -> list[tuple]:
        lines, nodes, roots = [], [], []
        for a, b, w, root in zip(table.a, table.b, table.w, table.is_root, strict=True):
            if b is not None:
                lines.append((a, b, int(w)))
            else:
                nodes.append(a)
                roots += [a] if root else []
        return [(table.problem[0], a, b) for a, b in attach_terminals(lines, min(roots), nodes)] if roots else []

    return map_groups(rows, "problem", ["a", "b"], kernel, f"problem {kind}, up string, down string", ["problem", "up", "down"])


def collapse_chains(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Chains of edges (up, down, length, flow, diameter) through nodes with one edge in, one out, equal flow and
    diameter, unless the node is in ``keep`` (node): first and last node, summed length, edges. Every edge points to the
    edge before it in its chain, and the pointers are chased to the chain's first edge, whatever its length."""
    degree = edges.select(F.col("up").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("down").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    plain = degree.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).where("i = 1 AND o = 1").select("node").join(keep, "node", "left_anti")
    before = edges.select(F.col("down").alias("up"), F.struct("up", "down").alias("previous"), F.col("flow").alias("f"), F.col("diameter").alias("d"))
    through = before.join(plain.withColumnRenamed("node", "up"), "up", "left_semi")
    linked = cut(edges.join(through, "up", "left").select(F.struct("up", "down").alias("node"), F.when((F.col("flow") == F.col("f")) & (F.col("diameter") == F.col("d")), F.col("previous")).alias("previous"), "length"))
    inner = linked.where("previous IS NOT NULL")
    ends = chase(linked.select("node", "previous").distinct(), up="previous").where("hops > 0")
    chains = inner.join(ends, "node").groupBy("end").agg(F.sum("length").alias("more"), F.count("*").alias("n"), F.max_by("node.down", "hops").alias("last"))
    heads = linked.where("previous IS NULL")
    return heads.join(chains, heads["node"] == chains["end"], "left").select(F.col("node.up").alias("first"), F.coalesce("last", F.col("node.down")).alias("last"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), (1 + F.coalesce("n", F.lit(0))).alias("edges"))


def axis_shifts(vertices: DataFrame, longest: float) -> DataFrame:
    """Removable side steps of routes: two right-angle turns in opposite senses with a short leg between."""
    w = Window.partitionBy("route").orderBy("seq")
    p = [F.struct(F.lead("x", i).over(w).alias("x"), F.lead("y", i).over(w).alias("y")) for i in range(4)]
    cross = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])
    dot = lambda a, b, c: (b["x"] - a["x"]) * (c["x"] - b["x"]) + (b["y"] - a["y"]) * (c["y"] - b["y"])
    rows = vertices.select("route", "seq", *[c.alias(f"p{i}") for i, c in enumerate(p)]).where(F.col("p3.x").isNotNull())
    a, b, c, d = (F.col(f"p{i}") for i in range(4))
    leg = (c["x"] - b["x"]) ** 2 + (c["y"] - b["y"]) ** 2
    return rows.where((dot(a, b, c) == 0) & (dot(b, c, d) == 0) & (cross(a, b, c) * cross(b, c, d) < 0) & (leg <= longest * longest)).select("route", "seq")
