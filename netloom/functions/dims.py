"""Engineering catalogs as small fixed DataFrames (18 pipes, 11 constraint types)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Diameter mm, flow limit t/h, continuous length limit m, new RUB/m, reconstruction RUB/m,
#: outer m, gap m, pair width m, envelope height m.
PIPES = """
50 3.5 181 74023 96180 .125 .150 .400 .125
65 8.3 245 78631 109989 .140 .150 .430 .140
80 13.2 327 83530 117582 .160 .150 .470 .160
100 22.3 419 89748 133694 .180 .150 .510 .180
125 40.2 554 97275 148030 .225 .150 .600 .225
150 65.1 696 105507 152295 .250 .150 .650 .250
200 152.3 1042 120275 181766 .315 .250 .880 .315
250 274.9 1379 135323 202030 .400 .250 1.050 .400
300 437.4 1718 150022 228707 .450 .250 1.150 .450
400 943.1 2477 190299 271317 .560 .250 1.370 .560
500 1663.4 3245 224137 333884 .710 .250 1.670 .710
600 2627.7 4037 264790 372703 .800 .250 1.850 .800
700 3735.1 4775 324298 439571 .900 .250 2.050 .900
800 5296.8 5644 325996 489918 1.000 .250 2.250 1.000
900 7165.0 6518 327693 553607 1.100 .250 2.450 1.100
1000 9391.8 7419 418777 606679 1.200 .250 2.650 1.200
1200 15012.8 9288 428074 825692 1.425 .250 3.100 1.425
1400 22501.9 11276 683417 978584 1.600 .250 3.450 1.600
"""
#: Type, forbidden, horizontal clearance m, vertical clearance m, least angle, extension m, least top depth m,
#: cost multiplier, geometry kind.
CONSTRAINTS = """
park 1 1.0 - - - - 1.00 polygon
social_area 1 1.0 - - - - 1.00 polygon
prohibited_site 1 1.0 - - - - 1.00 polygon
water 1 1.0 - - - - 1.00 polygon
railway 1 1.0 - - - - 1.00 polygon
oks 1 5.0 - - - - 1.00 polygon
road 0 1.5 - 90 3.0 1.0 1.60 polygon
tram_tracks 0 1.5 - 45 3.0 1.2 1.75 polygon
gas_pipeline 0 2.0 0.2 60 2.0 - 1.25 line
power_cable 0 2.0 0.5 60 2.0 - 1.15 line
heat_network 0 1.0 0.5 90 2.0 - 1.05 line
"""
OBJECT_TYPES = ["source", "heat_network", "heat_chamber", "oks_future", "oks_connection_point", "oks_existing", "restriction"]
GEOMETRY_OF = {
    "source": ["Point"], "heat_network": ["LineString"], "heat_chamber": ["Point"], "oks_future": ["Polygon", "MultiPolygon"],
    "oks_connection_point": ["Point"], "oks_existing": ["Polygon", "MultiPolygon"], "restriction": ["Polygon", "MultiPolygon", "LineString", "MultiLineString"],
}
LENGTH, FLOW, MONEY = "decimal(14,3)", "decimal(18,3)", "decimal(38,2)"
CHAMBER_STEPS = ((200, 3_000_000), (500, 5_000_000), (1000, 8_000_000), (1400, 12_000_000))
TIE_IN_COST, PENALTY_FIXED, PENALTY_PER_FLOW = 5_000_000, 100_000_000, 500_000
PIPE_ROWS = [r.split() for r in PIPES.strip().splitlines()]
DIAMETERS = [int(r[0]) for r in PIPE_ROWS]
MAX_FLOW = {int(r[0]): Decimal(r[1]) for r in PIPE_ROWS}
MAX_LENGTH = {int(r[0]): Decimal(r[2]) for r in PIPE_ROWS}


def pipes(spark: SparkSession) -> DataFrame:
    rows = [(int(r[0]), *[Decimal(v) for v in r[1:]]) for r in PIPE_ROWS]
    return spark.createDataFrame(rows, f"diameter int, max_flow {FLOW}, max_length {LENGTH}, rate decimal(12,0), rebuild_rate decimal(12,0), outer_m decimal(6,3), gap_m decimal(6,3), pair_width decimal(6,3), height decimal(6,3)")


def constraints(spark: SparkSession) -> DataFrame:
    d = lambda v: None if v == "-" else Decimal(v)
    rows = [(r[0], r[1] == "1", *map(d, r[2:8]), r[8]) for r in (x.split() for x in CONSTRAINTS.strip().splitlines())]
    return spark.createDataFrame(rows, "type string, forbidden boolean, horizontal decimal(6,3), vertical decimal(6,3), min_angle decimal(6,3), extension decimal(6,3), min_depth decimal(6,3), multiplier decimal(6,3), kind string")


def pipes_sql() -> str:
    """The pipe catalog as a DuckDB VALUES list, for the SQL checks."""
    rows = ", ".join(f"({r[0]}, CAST({r[1]} AS DECIMAL(18,3)), CAST({r[2]} AS DECIMAL(14,3)), {r[3]}, {r[4]})" for r in PIPE_ROWS)
    return f"(SELECT * FROM (VALUES {rows}) AS p(diameter, max_flow, max_length, rate, rebuild_rate))"


def constraints_sql() -> str:
    rows = ", ".join(f"('{r[0]}', {r[1]}, CAST({r[7]} AS DECIMAL(6,3)))" for r in (x.split() for x in CONSTRAINTS.strip().splitlines()))
    return f"(SELECT * FROM (VALUES {rows}) AS c(type, forbidden, multiplier))"


def diameter_for(flow: Column) -> Column:
    """Smallest diameter whose limit takes the flow; null beyond the catalog. The catalog is folded into one CASE, so no join is needed."""
    out = F.when(flow <= F.lit(MAX_FLOW[DIAMETERS[0]]), DIAMETERS[0])
    for d in DIAMETERS[1:]:
        out = out.when(flow <= F.lit(MAX_FLOW[d]), d)
    return out


def chamber_cost(diameter: Column) -> Column:
    out = F.when(diameter <= CHAMBER_STEPS[0][0], CHAMBER_STEPS[0][1])
    for d, cost in CHAMBER_STEPS[1:]:
        out = out.when(diameter <= d, cost)
    return out.cast("long")


def bend_distance(diameter: Column) -> Column:
    """Least distance of a bend from a chamber: 2 to 6 m by diameter."""
    return F.when(diameter <= 150, 2).when(diameter <= 300, 3).when(diameter <= 600, 4).when(diameter <= 900, 5).otherwise(6)


def building_clearance(diameter: Column) -> Column:
    return F.when(diameter < 500, 5.0).when(diameter < 900, 7.0).otherwise(9.0)
