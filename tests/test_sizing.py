"""Sizing of many networks at once: small ones against exhaustive search, one large one against a plain walk."""

import itertools
import random
from collections import defaultdict
from decimal import Decimal

from netloom.functions.dims import DIAMETERS, MAX_FLOW, MAX_LENGTH
from netloom.operators.sizing import size_networks

D = Decimal
SMALL, FOLLOWING = DIAMETERS[:2]


def sized(spark, cases):
    """{case: {edge: row}} of {case: (edges (id, up, down, length), demand)}."""
    edges = [(k, e, u, d, D(str(n))) for k, (lines, _) in cases.items() for e, u, d, n in lines]
    demand = [(k, n, None if f is None else D(str(f))) for k, (_, own) in cases.items() for n, f in own.items()]
    a = spark.createDataFrame(edges, "network string, edge string, up string, down string, length decimal(14,3)")
    b = spark.createDataFrame(demand, "network string, node string, flow decimal(18,3)")
    out = defaultdict(dict)
    for r in size_networks(a, b).collect():
        out[r.network][r.edge if r.flow is not None else (r.issue, r.edge)] = r
    return out


def share(d, part):
    """A flow that ``part`` of a pipe's capacity carries, to the gram."""
    return (MAX_FLOW[d] * D(str(part))).quantize(D("0.001"))


def random_case(rng, n, lengths, flows):
    parent = [None] + [rng.randrange(i) for i in range(1, n)]
    edges = [(f"e{i}", "plant" if parent[i] is None else f"n{parent[i]}", f"n{i}", rng.choice(lengths)) for i in range(n)]
    return parent, (edges, {f"n{i}": rng.choice(flows) for i in range(n)})


def test_literal_and_random_networks(spark):
    taps = [share(50, 0.9), share(80, 0.5), share(100, 0.5)]
    half, limit = MAX_LENGTH[SMALL] * D("0.6"), MAX_LENGTH[SMALL]
    cases = {
        "taps": ([("m1", "plant", "p", 7), ("m2", "p", "q", 7), ("m3", "q", "r", 7)], {"p": taps[0], "q": taps[1], "r": taps[2]}),
        "run": ([("near", "plant", "bend", half), ("far", "bend", "house", half)], {"house": share(SMALL, 0.8)}),
        "fork": ([("main", "plant", "fork", limit), ("twig", "fork", "hut", limit), ("limb", "fork", "hall", 3)], {"hut": share(SMALL, 0.7), "hall": share(SMALL, 0.7)}),
        "exact": ([("e", "plant", "house", limit)], {"house": share(SMALL, 1)}),
        "above": ([("e", "plant", "house", limit + D("0.001"))], {"house": share(SMALL, 1)}),
        "ring": ([("a", "p", "q", 4), ("b", "q", "p", 4), ("c", "s", "q", 4)], {"q": 2}),
        "twice": ([("a", "p", "q", 4), ("a", "q", "r", 4)], {"q": -2, "r": None}),
        "below ring": ([("a", "p", "q", 4), ("b", "q", "p", 4), ("c", "q", "s", 4), ("d", "t", "u", 4)], {"s": 1}),
        "too much": ([("a", "p", "q", 4), ("b", "q", "r", 4)], {"q": MAX_FLOW[1400], "r": 1}),
        "too long": ([("a", "p", "q", 11000), ("b", "q", "r", 11000)], {"r": 1}),
        "two sources": ([("a", "p", "q", 4), ("b", "s", "r", 4)], {"q": 1, "r": 20, "elsewhere": 5}),
        "no demand": ([("a", "p", "q", 100), ("b", "q", "r", 100), ("c", "q", "s", 50)], {}),
    }
    rng = random.Random(20261128)
    lengths = [D(1)] + [MAX_LENGTH[d] * D(f) for d in DIAMETERS[:3] for f in ("0.5", "1")] + [MAX_LENGTH[FOLLOWING] + D("0.001")]
    flows = [D(0)] + [share(d, f) for d in (*DIAMETERS[:4], DIAMETERS[-2]) for f in ("0.5", "1")]
    parents = {}
    for k in range(150):
        parents[f"r{k}"], cases[f"r{k}"] = random_case(rng, rng.randint(1, 4), lengths, flows)
    out = sized(spark, cases)

    took = lambda k, *edges: [out[k][e].diameter for e in edges]
    sums = [sum(taps), sum(taps[1:]), taps[2]]
    assert [out["taps"][e].flow for e in ("m1", "m2", "m3")] == sums
    assert took("taps", "m1", "m2", "m3") == [min(d for d in DIAMETERS if MAX_FLOW[d] >= f) for f in sums]
    assert took("run", "near", "far") == [FOLLOWING] * 2 and out["run"]["far"].continuous == 2 * half
    assert out["fork"]["twig"].continuous == limit == out["fork"]["main"].continuous and out["fork"]["main"].diameter > SMALL
    assert took("exact", "e") == [SMALL] and took("above", "e") == [FOLLOWING]
    assert set(out["ring"]) == {("MULTIPLE_UPSTREAM_EDGES", "q"), ("NETWORK_CYCLE", "a")}
    assert set(out["twice"]) == {("DUPLICATE_EDGE_ID", "a"), ("INVALID_DEMAND_FLOW", "q"), ("INVALID_DEMAND_FLOW", "r")}
    assert set(out["below ring"]) == {("NETWORK_CYCLE", "a")}
    assert [(out["too much"][e].diameter, out["too much"][e].issue) for e in "ab"] == [(None, "FLOW_EXCEEDS_CATALOG"), (50, None)]
    assert [(out["too long"][e].diameter, out["too long"][e].issue) for e in "ab"] == [(1400, "MAX_CONTINUOUS_LENGTH_EXCEEDED"), (1400, None)]
    assert took("two sources", "a", "b") == [50, 100] and took("no demand", "a", "b", "c") == [65] * 3

    compared = 0
    for k, parent in parents.items():
        edges, n, rows = cases[k][0], len(parent), out[k]
        flow = [rows[f"e{i}"].flow for i in range(n)]
        if any(r.issue for r in rows.values()):
            continue
        few = sorted({*DIAMETERS[:6], *DIAMETERS[-3:], *(rows[f"e{i}"].diameter for i in range(n))})
        good = []
        for choice in itertools.product(DIAMETERS if n < 3 else few, repeat=n):
            if any(MAX_FLOW[d] < flow[i] for i, d in enumerate(choice)):
                continue
            if any(p is not None and (choice[p] < choice[i] or flow[p] == flow[i] and choice[p] != choice[i]) for i, p in enumerate(parent)):
                continue
            run = []
            for i, p in enumerate(parent):
                run.append(D(str(edges[i][3])) + (run[p] if p is not None and choice[p] == choice[i] else 0))
            if all(r <= MAX_LENGTH[d] for r, d in zip(run, choice, strict=True)):
                good.append(choice)
        if good:
            compared += 1
            assert [rows[f"e{i}"].diameter for i in range(n)] == [min(c[i] for c in good) for i in range(n)]
    assert compared > 60


def test_one_large_network(spark):
    """A comb 3,000 edges deep and a bush: every constraint holds, and no section could be one pipe smaller."""
    rng = random.Random(7)
    n = 6000
    parent = [None] + [i - 1 if i < 3000 else rng.randrange(i) for i in range(1, n)]
    edges = [(f"e{i}", "plant" if p is None else f"n{p}", f"n{i}", D(rng.randrange(1, 3000)).scaleb(-3)) for i, p in enumerate(parent)]
    demand = {f"n{i}": D(rng.randrange(4)) / 4 for i in range(n) if rng.random() < 0.5}
    rows = sized(spark, {"one": (edges, demand)})["one"]
    children = defaultdict(list)
    for i, p in enumerate(parent):
        children[p].append(i)
    flow = [demand.get(f"n{i}", D(0)) for i in range(n)]
    for i in range(n - 1, 0, -1):
        flow[parent[i]] += flow[i]
    head = []
    for i, p in enumerate(parent):
        head.append(head[p] if p is not None and flow[p] == flow[i] else i)
    members = defaultdict(list)
    for i, h in enumerate(head):
        members[h].append(i)
    got = [rows[f"e{i}"].diameter for i in range(n)]
    assert [rows[f"e{i}"].flow for i in range(n)] == flow and None not in got

    def longest(h, d):
        """The longest run of ``d`` from the head of a section that takes it."""
        best, deepest = {None: D(0)}, D(0)
        stack = [(h, D(0))]
        while stack:
            i, before = stack.pop()
            here = before + edges[i][3]
            deepest = max(deepest, here)
            stack += [(c, here) for c in children[i] if head[c] == h or got[c] == d]
        return deepest

    for h, own in members.items():
        d = got[h]
        assert all(got[i] == d for i in own) and MAX_FLOW[d] >= flow[h] and longest(h, d) <= MAX_LENGTH[d]
        least = max([got[c] for i in own for c in children[i] if head[c] != h], default=0)
        assert d >= least
        if d > least and d != DIAMETERS[0]:
            smaller = DIAMETERS[DIAMETERS.index(d) - 1]
            assert smaller < least or MAX_FLOW[smaller] < flow[h] or longest(h, smaller) > MAX_LENGTH[smaller]
    run = []
    for i, p in enumerate(parent):
        run.append(edges[i][3] + (run[p] if p is not None and got[p] == got[i] else 0))
    assert [rows[f"e{i}"].continuous for i in range(n)] == run
