"""Small exact optimisation problems, one per group: arborescences with diameters, discrete choices, matchings.

Every problem is a group of rows and is solved in its task by branch and bound
with integer costs. A search that runs out of its node budget says UNKNOWN,
never INFEASIBLE.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from types import SimpleNamespace

from pyspark.sql import DataFrame

from .groups import map_groups

NODE_BUDGET = 200_000


@dataclass
class Problem:
    """Terminals with demand, allowed roots, arcs (id, from, to, fixed cost), diameter choices (arc -> [(capacity, cost)])
    and conflicts (sets of arcs of which one must be left out)."""

    demand: dict[str, int]
    roots: list[str]
    arcs: list[tuple[str, str, str, int]]
    choices: dict[str, list[tuple[int, int]]]
    conflicts: list[frozenset[str]] = field(default_factory=list)


def solve(problem: Problem, budget: int = NODE_BUDGET) -> tuple[str, int | None, list[str]]:
    """(OPTIMAL, INFEASIBLE or UNKNOWN; cost; arcs) of the cheapest forest from the roots that serves every terminal."""
    into: dict[str, list[tuple[str, str, str, int]]] = {}
    for arc in sorted(problem.arcs):
        into.setdefault(arc[2], []).append(arc)
    roots = set(problem.roots)
    total = sum(problem.demand.values())
    best: list = [None, []]
    spent = 0

    def cost_of(parent: dict[str, tuple[str, str, str, int]]) -> int | None:
        flow: dict[str, int] = {}
        for node, units in problem.demand.items():
            at, steps = node, 0
            while at in parent:
                arc = parent[at]
                flow[arc[0]] = flow.get(arc[0], 0) + units
                at, steps = arc[1], steps + 1
                if steps > len(parent):
                    return None
        cost = 0
        for arc in parent.values():
            units = flow.get(arc[0], 0)
            fitting = [c for capacity, c in problem.choices.get(arc[0], [(total, 0)]) if capacity >= units]
            if not fitting:
                return None
            cost += arc[3] + min(fitting)
        return cost

    least = {a[0]: a[3] + min((c for _, c in problem.choices.get(a[0], [(0, 0)])), default=0) for a in problem.arcs}

    def branch(open_nodes: list[str], parent: dict[str, tuple[str, str, str, int]], bound: int) -> bool:
        nonlocal spent
        spent += 1
        if spent > budget:
            return False
        if best[0] is not None and bound >= best[0]:
            return True
        chosen = {a[0] for a in parent.values()}
        if any(c <= chosen for c in problem.conflicts):
            return True
        if not open_nodes:
            cost = cost_of(parent)
            if cost is not None and (best[0] is None or cost < best[0]):
                best[0], best[1] = cost, sorted(chosen)
            return True
        node, rest = open_nodes[0], open_nodes[1:]
        for arc in into.get(node, ()):
            at, loop = arc[1], False
            while at in parent:
                at = parent[at][1]
                loop |= at == node
            if loop or at == node:
                continue
            more = rest if arc[1] in roots or arc[1] in parent or arc[1] in rest else [arc[1], *rest]
            if not branch(more, parent | {node: arc}, bound + least[arc[0]]):
                return False
        return True

    wanted = sorted(n for n in problem.demand if n not in roots)
    done = branch(wanted, {}, 0)
    if not done:
        return "UNKNOWN", best[0], best[1]
    return ("OPTIMAL", best[0], best[1]) if best[0] is not None else ("INFEASIBLE", None, [])


def solve_networks(arcs: DataFrame, terminals: DataFrame, roots: DataFrame) -> DataFrame:
    """problem, status, cost, arcs: arcs (problem, arc, up, down, capacity, cost; a row per diameter), terminals
    (problem, node, units), roots (problem, node)."""
    from pyspark.sql import functions as F

    null = lambda kind: F.lit(None).cast(kind)
    rows = arcs.select("problem", F.lit("arc").alias("kind"), "arc", "up", F.col("down").alias("node"), F.col("capacity").cast("long").alias("units"), F.col("cost").cast("long").alias("cost"))
    rows = rows.unionByName(terminals.select("problem", F.lit("terminal").alias("kind"), null("string").alias("arc"), null("string").alias("up"), "node", F.col("units").cast("long").alias("units"), null("long").alias("cost")))
    rows = rows.unionByName(roots.select("problem", F.lit("root").alias("kind"), null("string").alias("arc"), null("string").alias("up"), "node", null("long").alias("units"), null("long").alias("cost")))

    def kernel(table: SimpleNamespace) -> list[tuple]:
        choices: dict[str, list[tuple[int, int]]] = {}
        lines: dict[str, tuple[str, str, str, int]] = {}
        demand: dict[str, int] = {}
        starts: list[str] = []
        for row_kind, arc, up, node, units, cost in zip(table.kind, table.arc, table.up, table.node, table.units, table.cost, strict=True):
            if row_kind == "arc":
                lines.setdefault(arc, (arc, up, node, 0))
                choices.setdefault(arc, []).append((int(units), int(cost)))
            elif row_kind == "terminal":
                demand[node] = demand.get(node, 0) + int(units)
            else:
                starts.append(node)
        status, cost, chosen = solve(Problem(demand, starts, list(lines.values()), choices))
        return [(table.problem[0], status, cost, ",".join(chosen))]

    kind = arcs.schema["problem"].dataType.simpleString()
    return map_groups(rows, "problem", ["kind", "arc", "units", "cost", "node"], kernel, f"problem {kind}, status string, cost long, arcs string", ["problem", "status", "cost", "arcs"])


def refine(problem: Problem, check, rounds: int = 128) -> tuple[str, int | None, list[str]]:
    """Solve, check the proposal exactly, add the conflict that the check returns, and solve again."""
    for _ in range(rounds):
        status, cost, arcs = solve(problem)
        if status != "OPTIMAL":
            return status, cost, arcs
        conflict = check(arcs)
        if not conflict:
            return status, cost, arcs
        if not set(conflict) <= set(arcs):
            raise ValueError("a conflict must exclude the proposal that it explains")
        problem.conflicts.append(frozenset(conflict))
    return "UNKNOWN", None, []


def discrete_choice(options: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One option per slot with the least total cost and no conflicting pair, for every problem: options (problem, slot,
    option, cost), conflicts (problem, option, other)."""
    from pyspark.sql import functions as F

    kinds = {c: options.schema[c].dataType.simpleString() for c in ("problem", "slot", "option", "cost")}
    null = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    rows = options.select("problem", F.lit(0).alias("kind"), "slot", "option", F.lit(None).cast(kinds["option"]).alias("other"), "cost")
    rows = rows.unionByName(conflicts.select("problem", F.lit(1).alias("kind"), null("slot"), "option", "other", null("cost")))

    def kernel(table: SimpleNamespace) -> list[tuple]:
        slots: dict = {}
        bad: set[frozenset] = set()
        for row_kind, slot, option, other, cost in zip(table.kind, table.slot, table.option, table.other, table.cost, strict=True):
            if row_kind:
                bad.add(frozenset((option, other)))
            else:
                slots.setdefault(slot, []).append((int(cost), option))
        ordered = [sorted(slots[s]) for s in sorted(slots)]
        floor = [0]
        for s in reversed(ordered):
            floor.append(floor[-1] + s[0][0])
        floor.reverse()
        best: list = [None, []]

        def walk(i: int, cost: int, chosen: list) -> None:
            if best[0] is not None and cost + floor[i] >= best[0]:
                return
            if i == len(ordered):
                best[0], best[1] = cost, list(chosen)
                return
            for c, option in ordered[i]:
                if not any(frozenset((option, o)) in bad for o in chosen):
                    walk(i + 1, cost + c, [*chosen, option])

        walk(0, 0, [])
        return [(table.problem[0], best[0], ",".join(str(int(o)) if isinstance(o, float) else str(o) for o in sorted(best[1])))]

    return map_groups(rows, "problem", ["kind", "slot", "option"], kernel, f"problem {kinds['problem']}, cost long, options string", ["problem", "cost", "options"])


def root_matching(edges: DataFrame, capacity: int = 4) -> DataFrame:
    """Largest assignment of demands to roots with ``capacity`` places each (augmenting paths), for every problem:
    edges (problem, demand, root)."""
    kinds = {c: edges.schema[c].dataType.simpleString() for c in ("problem", "demand", "root")}

    def kernel(table: SimpleNamespace) -> list[tuple]:
        roots: dict = {}
        for d, r in zip(table.demand, table.root, strict=True):
            roots.setdefault(d, []).append(r)
        held: dict = {}

        def place(d, seen: set) -> bool:
            for r in roots[d]:
                if r in seen:
                    continue
                seen.add(r)
                own = held.setdefault(r, [])
                if len(own) < capacity:
                    own.append(d)
                    return True
                for i, other in enumerate(own):
                    if place(other, seen):
                        own[i] = d
                        return True
            return False

        for d in roots:
            place(d, set())
        return [(table.problem[0], d, r) for r, own in held.items() for d in own]

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return map_groups(edges.select("problem", "demand", "root").distinct(), "problem", ["demand", "root"], kernel, schema, ["problem", "demand", "root"])
