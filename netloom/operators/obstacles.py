"""Routes against obstacles, from geometry: what a route meets, where it runs inside or too near, how it crosses roads.

Routes are vertex tables (route, seq, x, y), obstacles closed rings (obstacle,
kind, ring: array of x, y) and utilities line pieces (utility, cx, cy, dx, dy).
Routes of up to ``SMALL`` rows meet what is around their home in a task (``homes``).
The segments of larger ones meet edges in grid cells, an equi-join in which a pair is tested
in one common cell only; exact predicates and stations are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import acute_angle, boxes_overlap, point_segment_distance, ring_contains, satisfies_least_angle, segments_intersect, straddle, vertices_to_segments
from . import homes
from .depth import FLOORS, PLATEAU_M, crossing_plateaus, depth_floors
from .groups import by_size
from .intervals import merge_intervals
from .lineage import cut, dealt
from .topology import box_cells, cells

FORBIDDEN = ["park", "social_area", "prohibited_site", "water", "railway", "oks"]
A, C = ("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy")


def constraint_type(object_type: Column, restriction_type: Column) -> Column:
    """What a feature is to a new route: buildings, the existing network, or the restriction that it names; null for others."""
    return F.when(object_type.isin("oks_future", "oks_existing"), "oks").when(object_type == "heat_network", "heat_network").when(object_type == "restriction", restriction_type)


def route_segments(vertices: DataFrame) -> DataFrame:
    """route, seq, ax, ay, bx, by, start (station of a), length; segments without length are left out."""
    s = vertices_to_segments(vertices, "route", "seq").where("length > 0")
    station = F.sum("length").over(Window.partitionBy("route").orderBy("seq")) - F.col("length")
    return s.select("route", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("nx").alias("bx"), F.col("ny").alias("by"), station.alias("start"), "length")


def ring_edges(obstacles: DataFrame) -> DataFrame:
    """obstacle, kind, edge, cx, cy, dx, dy of each side of the rings."""
    at = lambda i, c: F.element_at("ring", i)[c]
    e = F.col("edge")
    return obstacles.withColumn("edge", F.explode(F.sequence(F.lit(1), F.size("ring") - 1))).select("obstacle", "kind", "edge", at(e, "x").alias("cx"), at(e, "y").alias("cy"), at(e + 1, "x").alias("dx"), at(e + 1, "y").alias("dy"))


def pairs_in_reach(segments: DataFrame, lines: DataFrame, cell: float, reach: float = 0.0) -> DataFrame:
    """Pairs of segments (ax .. by) and lines (cx .. dy) whose boxes come within ``reach``, each once."""
    a, c = [F.col(n) for n in A], [F.col(n) for n in C]
    left = dealt(segments.withColumn("cell", F.explode(box_cells(*a, cell, reach))), "cell")
    right = lines.withColumn("cell", F.explode(box_cells(*c, cell)))
    lower = cells(F.greatest(F.least(a[0], a[2]) - reach, F.least(c[0], c[2])), F.greatest(F.least(a[1], a[3]) - reach, F.least(c[1], c[3])), cell)
    grown = [F.least(a[0], a[2]) - reach, F.least(a[1], a[3]) - reach, F.greatest(a[0], a[2]) + reach, F.greatest(a[1], a[3]) + reach]
    return left.join(right, "cell").where(boxes_overlap(*grown, *c)).where(F.col("cell") == lower).drop("cell")


def crossings(segments: DataFrame, lines: DataFrame, cell: float) -> DataFrame:
    """Pairs that share a point, with ``t``, its share of the segment (null for parallel ones)."""
    a, c = [F.col(n) for n in A], [F.col(n) for n in C]
    ux, uy, vx, vy = a[2] - a[0], a[3] - a[1], c[2] - c[0], c[3] - c[1]
    t = ((c[0] - a[0]) * vy - (c[1] - a[1]) * vx) / F.nullif((ux * vy - uy * vx).cast("double"), F.lit(0.0))
    # the boxes of these pairs overlap, so what is left of ``segments_intersect`` is that neither lies on one side of the other
    return pairs_in_reach(segments, lines, cell).where(straddle(*a, *c)).withColumn("t", t)


def points_in_rings(points: DataFrame, obstacles: DataFrame, cell: float, *keys: str) -> DataFrame:
    """Keys of points (x, y) with each obstacle that contains them."""
    met = points_and_boxes(points, obstacles, cell)
    return met[0].join(met[1], "cell").where(IN_BOX).where(ring_contains(F.col("x"), F.col("y"), F.col("ring"))).select(*keys, "obstacle", "kind")


#: Whether a point is in the box of a ring, which spares most points the walk round it.
IN_BOX = "x >= box_x1 AND x <= box_x2 AND y >= box_y1 AND y <= box_y2"


def points_and_boxes(points: DataFrame, obstacles: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """Points by cell, and obstacles with their boxes in each cell that these touch."""
    side = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    boxed = obstacles.withColumns({"box_x1": side(F.array_min, "x"), "box_y1": side(F.array_min, "y"), "box_x2": side(F.array_max, "x"), "box_y2": side(F.array_max, "y")})
    boxes = boxed.withColumn("cell", F.explode(box_cells(*[F.col(f"box_{c}") for c in ("x1", "y1", "x2", "y2")], cell)))
    return dealt(points.withColumn("cell", cells(F.col("x"), F.col("y"), cell)), "cell"), boxes


def split_by_size(df: DataFrame, key: str, near: Callable[[DataFrame], DataFrame], far: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``near`` of the rows whose ``key`` has up to ``SMALL`` rows, which meet what is around them in a task, ``far`` of the others, by joins in cells."""
    few, many = by_size(df, key)
    return near(few) if many is None else near(few).unionByName(far(many))


def kind_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def routes_on_obstacles(vertices: DataFrame, obstacles: DataFrame, cell: float) -> DataFrame:
    """route, obstacle, kind: what routes touch, cross or lie in."""
    rings = homes.ring_rows(obstacles, members=F.struct("obstacle", "kind"))

    def kernel(s: SimpleNamespace, index: SimpleNamespace) -> list:
        r, j = homes.touched(s, index, (s.ax != s.bx) | (s.ay != s.by))
        r, m = homes.members_of(r, j, index)
        m = pa.array(m)
        return [s.route.take(pa.array(r)), *[f.take(m) for f in index.units.flatten()]]

    def near(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("route").orderBy("seq")
        nx, ny = F.lead("x").over(w), F.lead("y").over(w)
        goes = nx.isNotNull() & ny.isNotNull()
        steps = rows.select("route", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.when(goes, nx).otherwise(F.col("x")).alias("bx"), F.when(goes, ny).otherwise(F.col("y")).alias("by"))
        return homes.at_homes(steps, rings, ["seq"], cell, 0.0, homes.prepare_rings, kernel, f"route {kind_of(vertices, 'route')}, obstacle {kind_of(obstacles, 'obstacle')}, kind {kind_of(obstacles, 'kind')}")

    return split_by_size(vertices, "route", near, lambda rows: _routes_on_obstacles(rows, obstacles, cell))


def _routes_on_obstacles(vertices: DataFrame, obstacles: DataFrame, cell: float) -> DataFrame:
    met = crossings(route_segments(vertices), ring_edges(obstacles), cell).select("route", "obstacle", "kind")
    return met.unionByName(points_in_rings(vertices, obstacles, cell, "route")).distinct()


def terminal_blockers(terminals: DataFrame, obstacles: DataFrame, cell: float) -> DataFrame:
    """terminal, blockers: the forbidden areas around terminals (terminal, own, x, y), their own building left out. Terminals at
    one place share one search, areas of one ring one test; a place's list meets its terminals, whose rows are not grouped."""
    shapes = obstacles.where(F.col("kind").isin(FORBIDDEN)).groupBy("ring").agg(F.collect_list("obstacle").alias("obstacle"), F.first("kind").alias("kind"))
    met = points_in_rings(terminals.select("x", "y").distinct(), shapes, cell, "x", "y")
    around = cut(met.groupBy("x", "y").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("obstacle")))).alias("around")))
    rows = cut(terminals.select("terminal", "own", "x", "y").distinct())
    several = rows.groupBy("terminal").count().where("count > 1").select("terminal")
    others = F.coalesce(F.array_remove("around", F.col("own")), F.col("around"))
    found = lambda df: df.join(around, ["x", "y"]).select("terminal", others.alias("blockers")).where("size(blockers) > 0")
    one, many = found(rows.join(several, "terminal", "left_anti")), found(rows.join(several, "terminal", "left_semi"))
    return one.unionByName(many.groupBy("terminal").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("blockers")))).alias("blockers")))


def blocked_lines(lines: DataFrame, obstacles: DataFrame, cell: float) -> DataFrame:
    """The lines (line, ax, ay, bx, by) on which anything lies. Semi-joins end a line's search at the first thing met, and
    only lines that begin outside of all areas are tested against sides. Equal rings are tested once."""
    obstacles = obstacles.groupBy("ring").agg(F.first("obstacle").alias("obstacle"), F.first("kind").alias("kind"))
    ends = lines.select("*", F.col("ax").alias("x"), F.col("ay").alias("y"))
    points, boxes = points_and_boxes(ends, obstacles, cell)
    p, b = points.alias("p"), boxes.alias("b")
    starts = cut(p.join(b, (F.col("p.cell") == F.col("b.cell")) & F.expr(IN_BOX) & ring_contains(F.col("x"), F.col("y"), F.col("ring")), "left_semi").select("line"))
    a, c = [F.col(n) for n in A], [F.col(n) for n in C]
    left = dealt(lines.join(starts, "line", "left_anti").withColumn("cell", F.explode(box_cells(*a, cell))), "cell").alias("p")
    right = ring_edges(obstacles).withColumn("cell", F.explode(box_cells(*c, cell))).alias("b")
    met = left.join(right, (F.col("p.cell") == F.col("b.cell")) & segments_intersect(*a, *c), "left_semi").select("line").distinct()
    return starts.unionByName(met)


def line_blockers(lines: DataFrame, obstacles: DataFrame, cell: float) -> DataFrame:
    """line, blockers: sorted ``kind:obstacle`` of everything on the straight lines (line, ax, ay, bx, by)."""
    rings = homes.ring_rows(obstacles, members=F.concat_ws(":", "kind", "obstacle"))

    def prepare(table: pa.Table) -> SimpleNamespace:
        index = homes.prepare_rings(table)
        names = index.units.to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)  # code points sort like bytes of UTF-8
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        index.code, index.units = rank[index.code], index.units.take(pa.array(order, pa.int64()))
        return index

    def kernel(s: SimpleNamespace, index: SimpleNamespace) -> list:
        r, m = homes.members_of(*homes.touched(s, index), index)
        count = np.bincount(r, minlength=len(s.heads))
        some = np.flatnonzero(count)
        offsets = np.concatenate([[0], np.cumsum(count[some])]).astype(np.int32)
        return [s.route.take(pa.array(some)), pa.ListArray.from_arrays(pa.array(offsets), index.units.take(pa.array(m)))]

    def near(rows: DataFrame) -> DataFrame:
        own = rows.select(F.col("line").alias("route"), *A)
        return homes.at_homes(own, rings, list(A), cell, 0.0, prepare, kernel, f"line {kind_of(lines, 'line')}, blockers array<string>")

    return split_by_size(lines, "line", near, lambda rows: _line_blockers(rows, obstacles, cell))


def _line_blockers(lines: DataFrame, obstacles: DataFrame, cell: float) -> DataFrame:
    met = crossings(lines, ring_edges(obstacles), cell).select("line", "obstacle", "kind")
    ends = lines.select("line", F.col("ax").alias("x"), F.col("ay").alias("y"))
    both = met.unionByName(points_in_rings(ends, obstacles, cell, "line"))
    return both.groupBy("line").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "obstacle"))).alias("blockers"))


def assess_crossings(vertices: DataFrame, obstacles: DataFrame, rules: DataFrame, cell: float) -> DataFrame:
    """route, obstacle, code for crossings of roads and tracks. ``rules``: kind, min_angle, extension, horizontal.

    NOT_STRAIGHT: entry and exit lie on different segments. ANGLE: a side is crossed below the least angle.
    EXTENSION_BEFORE, EXTENSION_AFTER: the route bends or ends too soon before the entry or after the exit.
    PARALLEL_CLEARANCE: another segment of the route comes nearer than the clearance without crossing."""
    reach = float(rules.agg(F.max("horizontal")).first()[0] or 0)  # a row for each kind of the fixed catalog
    limits = ["min_angle", "extension", "horizontal"]
    ruled = obstacles.join(F.broadcast(rules.select("kind", *[F.col(c).cast("double").alias(c) for c in limits])), "kind")
    shapes = homes.ring_rows(ruled, "kind", *limits)

    def prepare(table: pa.Table) -> SimpleNamespace:
        index = homes.prepare_rings(table)
        for name in limits:
            setattr(index, name, table[name].to_numpy())
        return index

    schema = f"route {kind_of(vertices, 'route')}, obstacle {kind_of(obstacles, 'obstacle')}, code string"
    near = lambda rows: homes.at_homes(route_segments(rows), shapes, ["seq"], cell, reach, prepare, judged_crossings, schema)
    return split_by_size(vertices, "route", near, lambda rows: _assess_crossings(rows, obstacles, rules, cell, reach))


CODES = ["NOT_STRAIGHT", "ANGLE", "EXTENSION_BEFORE", "EXTENSION_AFTER", "PARALLEL_CLEARANCE"]


def judged_crossings(s: SimpleNamespace, index: SimpleNamespace) -> list:
    """route, obstacle, code of whole routes at home; ``assess_crossings`` has the rules."""
    i, j = homes.near_pairs(s, index)
    p, _, ends = homes.met_sides(s, index, i, j)
    t = homes.shares(*ends)
    proper = ~np.isnan(t)
    p, t, (ax, ay, bx, by, cx, cy, dx, dy) = p[proper], t[proper], [e[proper] for e in ends]
    k = i[p]
    ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
    angle = np.degrees(np.arctan2(np.abs(ux * vy - uy * vx), ux * vx + uy * vy))
    angle, station, key = np.minimum(angle, 180 - angle), s.start[k] + t * s.length[k], s.r[k] * index.size + j[p]
    order = np.lexsort((s.seq[k], station, key))
    k, station, angle, key = k[order], station[order], angle[order], key[order]
    entry = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    exit_ = np.append(entry[1:], len(key)) - 1 if len(key) else entry
    r, j = np.divmod(key[entry], index.size)
    first, last, least = s.seq[k[entry]], s.seq[k[exit_]], index.min_angle[j]
    sharp = np.minimum.reduceat(angle, entry) if len(key) else angle
    found = [
        first != last,
        sharp + np.where(least >= 89.9, 0.1, 1e-7) < least,
        station[entry] - s.start[k[entry]] < index.extension[j],
        s.start[k[exit_]] + s.length[k[exit_]] - station[exit_] < index.extension[j],
    ]
    # the other segments of a route that crosses: those before its entry and after its exit
    ends_at = np.append(s.heads[1:], len(s.r))
    g, other = homes.spread(s.heads[r], ends_at[r] - s.heads[r])
    beside = (s.seq[other] < first[g]) | (s.seq[other] > last[g])
    g, other = g[beside], other[beside]
    wide = index.horizontal[j[g]]
    around = homes.overlap(s.ax[other], s.ay[other], s.bx[other], s.by[other], index.x1[j[g]] - wide, index.y1[j[g]] - wide, index.x2[j[g]] + wide, index.y2[j[g]] + wide)
    g, other = g[around], other[around]
    q, k, side = homes.side_pairs(other, j[g], index)
    ends = [s.ax[k], s.ay[k], s.bx[k], s.by[k], index.cx[side], index.cy[side], index.dx[side], index.dy[side]]
    a, c = ends[:4], ends[4:]
    gap = np.minimum.reduce([point_distance(*a[:2], *c), point_distance(*a[2:], *c), point_distance(*c[:2], *a), point_distance(*c[2:], *a)])
    close = (gap < index.horizontal[j[g[q]]]) & ~(homes.overlap(*ends) & homes.straddle(*ends))
    found.append(np.bincount(g[q[close]], minlength=len(entry)) > 0)
    at, code = np.nonzero(np.array(found, bool).reshape(len(CODES), -1).T)
    p, m = homes.spread(index.first_member[j[at]], index.member_count[j[at]])
    return [s.route.take(pa.array(r[at][p])), index.units.take(pa.array(index.code[m])), pa.array(CODES).take(pa.array(code[p]))]


def point_distance(px, py, ax, ay, bx, by) -> np.ndarray:
    """``geometry.point_segment_distance`` of arrays; segments have a length."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / np.where(square == 0, np.nan, square)
    t = np.where(square == 0, 0.0, np.maximum(0.0, np.minimum(1.0, t)))
    x, y = ax + t * dx - px, ay + t * dy - py
    return np.sqrt(x * x + y * y)


def _assess_crossings(vertices: DataFrame, obstacles: DataFrame, rules: DataFrame, cell: float, reach: float) -> DataFrame:
    segments, edges = route_segments(vertices), ring_edges(obstacles.join(F.broadcast(rules.select("kind")), "kind", "left_semi"))
    a, c = [F.col(n) for n in A], [F.col(n) for n in C]
    hits = crossings(segments, edges, cell).where("t IS NOT NULL").withColumns({"station": F.col("start") + F.col("t") * F.col("length"), "angle": acute_angle(a[2] - a[0], a[3] - a[1], c[2] - c[0], c[3] - c[1])})
    order = F.struct("station", "seq")
    found = hits.groupBy("route", "obstacle", "kind").agg(F.min(F.struct(order.alias("o"), "start")).alias("entry"), F.max(F.struct(order.alias("o"), (F.col("start") + F.col("length")).alias("end"))).alias("exit"), F.min("angle").alias("angle")).join(F.broadcast(rules), "kind")
    first, last = F.col("entry.o.seq"), F.col("exit.o.seq")
    codes = F.array_compact(
        F.array(
            F.when(first != last, "NOT_STRAIGHT"),
            F.when(~satisfies_least_angle(F.col("angle"), F.col("min_angle").cast("double")), "ANGLE"),
            F.when(F.col("entry.o.station") - F.col("entry.start") < F.col("extension").cast("double"), "EXTENSION_BEFORE"),
            F.when(F.col("exit.end") - F.col("exit.o.station") < F.col("extension").cast("double"), "EXTENSION_AFTER"),
        )
    )
    gap = F.least(point_segment_distance(a[0], a[1], *c), point_segment_distance(a[2], a[3], *c), point_segment_distance(c[0], c[1], *a), point_segment_distance(c[2], c[3], *a))
    near = pairs_in_reach(segments, edges, cell, reach).where(~segments_intersect(*a, *c)).withColumn("gap", gap).groupBy("route", "obstacle", "seq").agg(F.min("gap").alias("gap"))
    beside = near.join(found.select("route", "obstacle", first.alias("first"), last.alias("last"), "horizontal"), ["route", "obstacle"]).where("(seq < first OR seq > last) AND gap < CAST(horizontal AS DOUBLE)")
    return found.select("route", "obstacle", F.explode(codes).alias("code")).unionByName(beside.select("route", "obstacle", F.lit("PARALLEL_CLEARANCE").alias("code")).distinct())


def near_intervals(vertices: DataFrame, lines: DataFrame, clearance: float, cell: float) -> DataFrame:
    """route, utility, s, e: stations, in whole millimetres, between which a route is within ``clearance`` of a utility's axis, merged."""

    def kernel(s: SimpleNamespace, index: SimpleNamespace) -> list:
        i, j = homes.near_pairs(s, index, clearance)
        low, high = capsule_shares(s, index, i, j, float(clearance))
        held = low < 3.0
        i, j, low, high = i[held], j[held], low[held], high[held]
        key = s.r[i] * len(index.units) + index.code[j]
        order = np.argsort(key, kind="stable")
        key, i = key[order], i[order]
        begin, end = (homes.millimetres(s.start[i] + v[order] * s.length[i]) for v in (low, high))
        again = np.zeros(len(key), bool)
        again[1:] = key[1:] == key[:-1]
        again[:-1] |= again[1:]
        merged = homes.islands(key[again], begin[again], end[again])
        key, begin, end = (np.concatenate([own[~again], more]) for own, more in zip((key, begin, end), merged, strict=True))
        r, code = np.divmod(key, len(index.units))
        return [s.route.take(pa.array(r)), index.units.take(pa.array(code)), begin, end]

    axes = homes.line_rows(lines.where("cx <> dx OR cy <> dy"), "utility")
    schema = f"route {kind_of(vertices, 'route')}, utility {kind_of(lines, 'utility')}, s long, e long"
    near = lambda rows: homes.at_homes(route_segments(rows), axes, ["seq"], cell, float(clearance), homes.prepare_lines, kernel, schema)
    return split_by_size(vertices, "route", near, lambda rows: _near_intervals(rows, lines, clearance, cell))


def capsule_shares(s: SimpleNamespace, index: SimpleNamespace, i: np.ndarray, j: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """From where to where, as shares of a segment, it is within ``reach`` of a line, by the steps of ``_near_intervals``; 3 and -3 if nowhere."""
    ax, ay, cx, cy, dx, dy = s.ax[i], s.ay[i], index.cx[j], index.cy[j], index.dx[j], index.dy[j]
    ux, uy, vx, vy, wx, wy = s.bx[i] - ax, s.by[i] - ay, dx - cx, dy - cy, ax - cx, ay - cy
    square, n = ux * ux + uy * uy, np.sqrt(vx * vx + vy * vy)
    low, high = np.full(len(i), 3.0), np.full(len(i), -3.0)

    def take(a: np.ndarray, b: np.ndarray) -> None:
        np.maximum(a, 0.0, out=a)
        np.minimum(b, 1.0, out=b)
        none = a >= b
        a[none], b[none] = 3.0, -3.0
        np.minimum(low, a, out=low)
        np.maximum(high, b, out=high)

    for zx, zy in ((wx, wy), (ax - dx, ay - dy)):
        p, q = (ux * zx + uy * zy) / square, (zx * zx + zy * zy - reach * reach) / square
        rest = p * p - q
        reached = p * p >= q
        d = np.sqrt(np.maximum(rest, 0.0))
        take(np.where(reached, -p - d, 2.0), np.where(reached, -p + d, -1.0))
    lows, highs = [], []
    for f0, f1, least, most in (((wx * vx + wy * vy) / n, (ux * vx + uy * vy) / n, 0.0, n), ((wx * vy - wy * vx) / n, (ux * vy - uy * vx) / n, -reach, reach)):
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = (least - f0) / f1, (most - f0) / f1
        low_f, high_f = np.minimum(a, b), np.maximum(a, b)
        level = np.flatnonzero(f1 == 0)
        if len(level):
            within = (f0[level] >= least) & (f0[level] <= (most[level] if isinstance(most, np.ndarray) else most))
            low_f[level], high_f[level] = np.where(within, 0.0, 2.0), np.where(within, 1.0, -1.0)
        lows.append(low_f)
        highs.append(high_f)
    take(np.maximum(*lows), np.minimum(*highs))
    return low, high


def _near_intervals(vertices: DataFrame, lines: DataFrame, clearance: float, cell: float) -> DataFrame:
    """The points around a line piece form a capsule, which is convex, so a segment is inside it on one range of t: that
    of the two end circles and the strip between, taken together. Each range is a pair of columns, empty if its end
    is before its start; the steps are columns of their own, so that no expression is written out again and again."""
    x, r, zero = F.col, F.lit(float(clearance)), F.lit(0.0)
    met = pairs_in_reach(route_segments(vertices), lines.where("cx <> dx OR cy <> dy"), cell, clearance)
    vectors = met.select("route", "utility", "start", "length", *[(x(a) - x(b)).cast("double").alias(n) for n, a, b in (("ux", "bx", "ax"), ("uy", "by", "ay"), ("vx", "dx", "cx"), ("vy", "dy", "cy"), ("wx", "ax", "cx"), ("wy", "ay", "cy"), ("zx", "ax", "dx"), ("zy", "ay", "dy"))])
    square = x("ux") * x("ux") + x("uy") * x("uy")
    terms = vectors.withColumns(
        {"n": F.sqrt(x("vx") * x("vx") + x("vy") * x("vy"))}
        | {f"p{k}": (x("ux") * x(f"{k}x") + x("uy") * x(f"{k}y")) / square for k in "wz"}
        | {f"q{k}": (x(f"{k}x") * x(f"{k}x") + x(f"{k}y") * x(f"{k}y") - r * r) / square for k in "wz"}
    )
    linear = terms.withColumns({"a0": (x("wx") * x("vx") + x("wy") * x("vy")) / x("n"), "a1": (x("ux") * x("vx") + x("uy") * x("vy")) / x("n"), "b0": (x("wx") * x("vy") - x("wy") * x("vx")) / x("n"), "b1": (x("ux") * x("vy") - x("uy") * x("vx")) / x("n")})
    for k in "wz":
        d = F.sqrt(F.greatest(x(f"p{k}") * x(f"p{k}") - x(f"q{k}"), zero))
        reached = x(f"p{k}") * x(f"p{k}") >= x(f"q{k}")
        linear = linear.withColumns({f"low_{k}": F.when(reached, -x(f"p{k}") - d).otherwise(2.0), f"high_{k}": F.when(reached, -x(f"p{k}") + d).otherwise(-1.0)})
    for name, f0, f1, low, high in (("along", x("a0"), x("a1"), zero, x("n")), ("across", x("b0"), x("b1"), -r, r)):
        within, ends = (f0 >= low) & (f0 <= high), [(v - f0) / F.nullif(f1, zero) for v in (low, high)]
        linear = linear.withColumns({f"{name}_0": F.when(f1 == 0, F.when(within, zero).otherwise(2.0)).otherwise(F.least(*ends)), f"{name}_1": F.when(f1 == 0, F.when(within, F.lit(1.0)).otherwise(-1.0)).otherwise(F.greatest(*ends))})
    linear = linear.withColumns({"low_s": F.greatest("along_0", "across_0"), "high_s": F.least("along_1", "across_1")})
    clipped = linear.select("route", "utility", "start", "length", *[c for k in "wzs" for c in (F.greatest(x(f"low_{k}"), zero).alias(f"low_{k}"), F.least(x(f"high_{k}"), F.lit(1.0)).alias(f"high_{k}"))])
    inside = lambda end, k: F.when(x(f"low_{k}") < x(f"high_{k}"), x(f"{end}_{k}"))
    ends = clipped.withColumns({"low": F.least(*[inside("low", k) for k in "wzs"]), "high": F.greatest(*[inside("high", k) for k in "wzs"])})
    # a plain filter would be pushed down into the join with all steps written out (over 64 KB of code)
    held = ends.select("route", "utility", "start", "length", F.explode(F.array(F.when(x("low").isNotNull(), F.struct("low", "high")))).alias("v")).where("v IS NOT NULL").select("route", "utility", "start", "length", "v.low", "v.high")
    mm = lambda t: F.floor((x("start") + t * x("length")) * 1000 + 0.5).cast("long")
    spans = held.select(F.struct("route", "utility").alias("k"), mm(x("low")).alias("s"), mm(x("high")).alias("e"))
    return merge_intervals(spans, "k").select("k.route", "k.utility", "s", "e")


def clearance_violations(near: DataFrame, allowed: DataFrame) -> DataFrame:
    """route, utility, s, e: what of the near stretches lies outside the allowed ones (same columns). A stretch shorter than
    a millimetre, with s = e, counts like others; it is allowed where a closed allowed stretch holds it."""
    key = F.struct("route", "utility").alias("k")
    free = merge_intervals(allowed.select(key, "s", "e"), "k").select("k", F.col("s").alias("fs"), F.col("e").alias("fe"))
    own = cut(near.select(key, "s", "e"))
    cutting = own.join(free, "k", "left").where("fs IS NULL OR (fs < e AND fe > s) OR (s = e AND fs <= s AND fe >= s)")
    untouched = own.join(cutting.select("k", "s", "e").distinct(), ["k", "s", "e"], "left_anti").withColumns({"fs": F.lit(None).cast("long"), "fe": F.lit(None).cast("long")})
    w = Window.partitionBy("k", "s", "e").orderBy("fs")
    held = cutting.unionByName(untouched).withColumns({"from": F.coalesce(F.max("fe").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("s")), "last": F.row_number().over(Window.partitionBy("k", "s", "e").orderBy(F.desc("fs")))})
    gaps = held.select("k", F.greatest("from", "s").alias("s"), F.coalesce("fs", "e").alias("e"), F.col("fs").isNull().alias("whole")).where("whole OR s < e").drop("whole")
    tails = held.where("last = 1 AND fe IS NOT NULL").select("k", F.greatest("fe", "s").alias("s"), "e")
    return gaps.unionByName(tails.where("s < e")).select("k.route", "k.utility", "s", "e")


def outside_stretches(near: DataFrame, *allowed: tuple[Column, Column]) -> DataFrame:
    """``clearance_violations`` where each near stretch has its own allowed ones as pairs of columns, in order, apart from each other and null
    where there is none: row by row, so nothing is joined."""
    s, e = F.col("s"), F.col("e")
    none = F.lit(None).cast("long")
    there = [lo.isNotNull() & hi.isNotNull() for lo, hi in allowed]
    after, parts, kept = s, [], s == e
    for (lo, hi), known in zip(allowed, there, strict=True):
        before = F.when(known, F.greatest(s, F.least(e, lo))).otherwise(none)
        parts.append(F.when(known & (after < before), F.struct(after.alias("s"), before.alias("e"))))
        after = F.when(known, F.greatest(after, F.least(e, hi))).otherwise(after)
        kept = kept & ~(known & (lo <= s) & (hi >= s))
    parts.append(F.when((after < e) | kept, F.struct(after.alias("s"), e.alias("e"))))
    return near.select("route", "utility", F.explode(F.array(*parts)).alias("v")).where("v IS NOT NULL").select("route", "utility", "v.s", "v.e")


def utility_plateaus(vertices: DataFrame, lines: DataFrame, cell: float) -> DataFrame:
    """route, s, e: level stretches around the places where routes cross utilities."""

    def kernel(s: SimpleNamespace, index: SimpleNamespace) -> list:
        i, _, t = homes.crossed(s, index)
        station = s.start[i] + t * s.length[i]
        r, begin, end = homes.islands(s.r[i], np.maximum(0.0, station - PLATEAU_M), np.minimum(s.total[i], station + PLATEAU_M))
        return [s.route.take(pa.array(r)), begin, end]

    def near(rows: DataFrame) -> DataFrame:
        segments = route_segments(rows).withColumn("total", F.sum("length").over(Window.partitionBy("route")))
        return homes.at_homes(segments, homes.line_rows(lines), ["seq"], cell, 0.0, homes.prepare_lines, kernel, f"route {kind_of(vertices, 'route')}, s double, e double")

    return split_by_size(vertices, "route", near, lambda rows: _utility_plateaus(rows, lines, cell))


def _utility_plateaus(vertices: DataFrame, lines: DataFrame, cell: float) -> DataFrame:
    segments = route_segments(vertices)
    total = segments.groupBy("route").agg(F.sum("length").alias("total"))
    hits = crossings(segments, lines, cell).where("t IS NOT NULL").select("route", (F.col("start") + F.col("t") * F.col("length")).alias("station")).distinct()
    return crossing_plateaus(hits.join(total, "route").withColumnRenamed("total", "length"))


def inside_intervals(vertices: DataFrame, obstacles: DataFrame, cell: float) -> DataFrame:
    """route, obstacle, type, s, e: stretches of segments inside areas, in whole millimetres. A segment is cut where it meets sides; each piece lies in or out as its middle does."""
    segments = route_segments(vertices)
    hits = crossings(segments, ring_edges(obstacles), cell).select("route", "seq", "obstacle", "t")
    ends = segments.select("route", "seq", F.col("ax").alias("x"), F.col("ay").alias("y"))
    started = points_in_rings(ends, obstacles, cell, "route", "seq").select("route", "seq", "obstacle")
    pairs = hits.select("route", "seq", "obstacle").unionByName(started).distinct()
    cuts = hits.where("t IS NOT NULL").unionByName(pairs.withColumn("t", F.explode(F.array(F.lit(0.0), F.lit(1.0))))).distinct()
    pieces = cuts.withColumn("u", F.lead("t").over(Window.partitionBy("route", "seq", "obstacle").orderBy("t"))).where("u IS NOT NULL")
    placed = pieces.join(segments, ["route", "seq"]).join(obstacles.select("obstacle", F.col("kind").alias("type"), "ring"), "obstacle")
    mid = (F.col("t") + F.col("u")) / 2
    held = placed.where(ring_contains(F.col("ax") + mid * (F.col("bx") - F.col("ax")), F.col("ay") + mid * (F.col("by") - F.col("ay")), F.col("ring")))
    mm = lambda t: F.floor((F.col("start") + F.col(t) * F.col("length")) * 1000 + 0.5).cast("long")
    return held.select("route", "obstacle", "type", mm("t").alias("s"), mm("u").alias("e"))


def floors_from_areas(vertices: DataFrame, obstacles: DataFrame, cell: float) -> DataFrame:
    """route, floor, s, e: where routes run inside roads and tracks, with the least depth there."""
    levels = sorted(set(FLOORS.values()))
    floor = F.lit(None).cast("double")
    for kind, least in FLOORS.items():
        floor = F.when(F.col("kind") == kind, least).otherwise(floor)
    rings = homes.ring_rows(obstacles.withColumn("floor", floor).where("floor IS NOT NULL"), "floor", members=F.lit(0)).withColumn("members", F.array(F.lit(0)))

    def prepare(table: pa.Table) -> SimpleNamespace:
        index = homes.prepare_rings(table)
        index.floor = np.searchsorted(levels, table["floor"].to_numpy())
        return index

    def kernel(s: SimpleNamespace, index: SimpleNamespace) -> list:
        i, j = homes.near_pairs(s, index)
        p, _, ends = homes.met_sides(s, index, i, j)
        t = homes.shares(*ends)
        at = np.flatnonzero(homes.in_box(s.ax[i], s.ay[i], j, index))
        met = np.zeros(len(i), bool)
        met[p] = True
        met[at[homes.inside(s.ax[i[at]], s.ay[i[at]], j[at], index)]] = True
        pairs, proper = np.flatnonzero(met), ~np.isnan(t)
        p, t = np.concatenate([p[proper], pairs, pairs]), np.concatenate([t[proper], np.zeros(len(pairs)), np.ones(len(pairs))])
        order = np.lexsort((t, p))
        p, t = p[order], t[order]
        piece = np.flatnonzero((p[1:] == p[:-1]) & (t[1:] != t[:-1]))
        p, t, u = p[piece], t[piece], t[piece + 1]
        k, mid = i[p], (t + u) / 2
        held = homes.inside(s.ax[k] + mid * (s.bx[k] - s.ax[k]), s.ay[k] + mid * (s.by[k] - s.ay[k]), j[p], index)
        p, k, t, u = p[held], k[held], t[held], u[held]
        key, begin, end = homes.islands(s.r[k] * len(levels) + index.floor[j[p]], *[homes.millimetres(s.start[k] + v * s.length[k]) for v in (t, u)])
        r, level = np.divmod(key, len(levels))
        return [s.route.take(pa.array(r)), np.array(levels)[level], begin, end]

    schema = f"route {kind_of(vertices, 'route')}, floor double, s long, e long"
    near = lambda rows: homes.at_homes(route_segments(rows), rings, ["seq"], cell, 0.0, prepare, kernel, schema)
    return split_by_size(vertices, "route", near, lambda rows: _floors_from_areas(rows, obstacles, cell))


def _floors_from_areas(vertices: DataFrame, obstacles: DataFrame, cell: float) -> DataFrame:
    return depth_floors(inside_intervals(vertices, obstacles.where(F.col("kind").isin(*FLOORS)), cell))
