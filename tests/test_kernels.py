"""Kernels against exhaustive search on small random cases."""

import itertools
import random

from netloom.operators import routing, solve

def test_network_solver_against_all_subsets():
    rng = random.Random(5)
    for _ in range(60):
        nodes = ["r", "a", "b", "c"][: rng.randint(2, 4)]
        arcs = [(f"x{i}", *rng.sample(nodes, 2), rng.randint(1, 9)) for i in range(rng.randint(1, 6))]
        demand = {n: rng.randint(1, 3) for n in nodes[1:] if rng.random() < 0.7}
        choices = {a[0]: [(2, 1), (9, 5)] for a in arcs}
        best = None
        for k in range(len(arcs) + 1):
            for subset in itertools.combinations(arcs, k):
                into = {}
                if any(into.setdefault(a[2], a) is not a for a in subset) or "r" in into:
                    continue
                flow, ok = {}, True
                used = {"r"} | {a[1] for a in subset} | {a[2] for a in subset}
                for n in used - {"r"}:
                    ok &= n in into
                for n, units in demand.items():
                    at, steps = n, 0
                    while ok and at != "r":
                        if at not in into or steps > len(subset):
                            ok = False
                            break
                        flow[into[at][0]] = flow.get(into[at][0], 0) + units
                        at, steps = into[at][1], steps + 1
                if not ok:
                    continue
                for n in used - {"r"}:
                    at, steps = n, 0
                    while ok and at != "r":
                        at, steps = into[at][1], steps + 1
                        ok &= steps <= len(subset)
                if not ok:
                    continue
                price = [min((c for cap, c in choices[a[0]] if cap >= flow.get(a[0], 0)), default=None) for a in subset]
                if None in price:
                    continue
                cost = sum(a[3] for a in subset) + sum(price)
                best = cost if best is None else min(best, cost)
        status, cost, _ = solve.solve(solve.Problem(demand, ["r"], arcs, choices))
        assert (status, cost) == (("OPTIMAL", best) if best is not None else ("INFEASIBLE", None))


def test_search_without_budget_is_unknown():
    assert solve.solve(solve.Problem({"a": 1}, ["r"], [("x", "r", "a", 1)], {}), budget=1)[0] == "UNKNOWN"


def test_cuts():
    p = solve.Problem({"a": 1}, ["r"], [("x", "r", "a", 1), ("y", "r", "a", 2)], {})
    assert solve.refine(p, lambda arcs: ["x"] if "x" in arcs else [])[2] == ["y"]


def test_route_around_a_box():
    path = routing.shortest_route((0, 0), (100, 0), [(40, -10, 60, 10)], least_turn=0.0)
    assert path[0] == (0, 0) and path[-1] == (100, 0) and not any(routing.blocked(a, b, [(40, -10, 60, 10)]) for a, b in itertools.pairwise(path))
    assert routing.shortest_route((0, 0), (100, 0), []) == [(0, 0), (100, 0)]


def test_trees():
    edges = [("r", "m", 2), ("m", "a", 1), ("m", "b", 1), ("r", "a", 9)]
    assert sorted(routing.attach_terminals(edges, "r", ["r", "a", "b"])) == [("m", "a"), ("m", "b"), ("r", "m")]
    assert routing.closure_tree(edges, ["r", "a", "b"]) == [("a", "m"), ("b", "m"), ("m", "r")]
