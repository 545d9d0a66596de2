"""Pieces of small routes, laid out within a task, against those by joins."""

import random

from netloom.functions import dims
from netloom.operators import pieces


def test_both_ways(spark, monkeypatch):
    rng = random.Random(4)
    routes, crossings, profile = [], [], []
    for r in range(80):
        length = rng.choice([0, 5_000, 60_000, 61_234])
        routes.append((r, length, rng.choice([50, 100, 1400, None])))
        for i in range(rng.randrange(5)):
            s = rng.randrange(0, 60_000, 500)
            crossings.append((r, s, s + rng.choice([0, 700, 9_000, 30_000]), rng.choice(["road", "gas_pipeline", "tram_tracks", "other"]), f"x{i}", rng.randrange(91)))
        for at in sorted(rng.sample([-500, 0, 10_000, 30_001, length, 70_000], rng.randrange(5))):
            profile.append((r, at, rng.choice([2000, 2999, 3000, 3500, 5501])))
    profile = list({(r, at): (r, at, d) for r, at, d in profile}.values())  # one depth a station
    crossings.append((999, 0, 10, "road", "lost", 5))
    tables = (
        spark.createDataFrame(routes, "route long, length long, diameter int"),
        spark.createDataFrame(crossings, "route long, s long, e long, type string, id string, angle long"),
        spark.createDataFrame(profile, "route long, station long, depth int"),
    )
    rows = lambda **how: sorted(map(str, pieces.route_pieces(*tables, dims.pipes(spark), **how).collect()))
    found = rows()
    assert found == rows(small=0) == rows(small=5) and len(found) > 200

    def never(*_):
        raise AssertionError("joins for small routes")

    monkeypatch.setattr(pieces, "laid_by_joins", never)
    assert found == rows()
