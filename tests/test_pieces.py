"""Export pieces: extensions, common parts, depth steps, sums."""

from decimal import Decimal

from netloom.functions import dims
from netloom.operators import pieces


def test_one_route(spark):
    routes = spark.createDataFrame([("r", 100_000, 50), ("plain", 7_000, 80)], "route string, length long, diameter int")
    crossings = spark.createDataFrame([("r", 10_000, 20_000, "road", "a", 88), ("r", 21_000, 30_000, "gas_pipeline", "b", 61), ("r", 99_000, 99_500, "road", "c", 90)], "route string, s long, e long, type string, id string, angle int")
    profile = spark.createDataFrame([("r", 0, 2000), ("r", 40_000, 4000), ("r", 100_000, 4000)], "route string, station long, depth long")
    found = pieces.route_pieces(routes, crossings, profile, dims.pipes(spark)).collect()
    got = [(r.a, r.b, r.types, r.ids, r.angle, r.depth_start, r.depth_end) for r in sorted(found, key=lambda r: (r.route, r.a)) if r.route == "r"]
    assert got == [
        (0, 7_000, "base", "", None, 2000, 2350), (7_000, 19_000, "road", "a", 88, 2350, 2950), (19_000, 20_000, "gas_pipeline+road", "a+b", 61, 2950, 3000), (20_000, 23_000, "gas_pipeline+road", "a+b", 61, 3000, 3150),
        (23_000, 32_000, "gas_pipeline", "b", 61, 3150, 3600), (32_000, 40_000, "base", "", None, 3600, 4000), (40_000, 96_000, "base", "", None, 4000, 4000), (96_000, 100_000, "road", "c", 90, 4000, 4000),
    ]
    rate, cost = Decimal(74023), {(r.route, r.a): r.cost for r in found}
    assert cost["r", 0] == rate * 7 and cost["r", 20_000] == (rate * 3 * Decimal("1.60") * Decimal("1.0075")).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP")
    assert cost["plain", 0] == Decimal(83530) * 7 and len(cost) == 9

    named = spark.createDataFrame([("r", 1, 100_000, 4, 5), ("plain", 1, 7_000, 5, 6)], "route string, variant int, length long, up_node int, down_node int")
    features = pieces.piece_features(pieces.route_pieces(routes, crossings, profile, dims.pipes(spark)), named)
    rows = features.collect()
    nodes = {r.id for r in rows if r.object_type == "technical_node"} | {"1:n4", "1:n5", "1:n6"}
    pipes = [r for r in rows if r.object_type == "heat_network"]
    assert len(nodes) == 10 and {r.start_node for r in pipes} | {r.end_node for r in pipes} == nodes and len({r.id for r in pipes}) == 9
    total = sum(cost.values())
    summary = spark.createDataFrame([(1, Decimal(3), Decimal(5), total + 8)], "variant int, chambers decimal(12,2), tie_in_cost decimal(12,2), construction decimal(20,2)")
    assert pieces.unreconciled(features, summary).collect() == []
    off = spark.createDataFrame([(1, Decimal(3), Decimal(5), total + 7)], summary.schema)
    assert [r.declared - r.pieces for r in pieces.unreconciled(features, off).collect()] == [-1]
