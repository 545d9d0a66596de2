"""Export pieces: several event layers of a route laid over each other on one axis.

Stations are whole millimetres. Cuts of all layers, once each, make the pieces;
an interval that holds pieces i to j gives j - i + 1 rows by their numbers, so an
overlay costs what it returns and never compares all intervals of a route.
"""

from __future__ import annotations

from itertools import pairwise
from math import floor
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.dims import MONEY
from .economics import crossing_multiplier
from .groups import SMALL, by_size, map_groups
from .lineage import cut

#: Metres by which the special method goes on beyond a crossing.
EXTENSION_M = {"road": 3, "tram_tracks": 3, "gas_pipeline": 2, "power_cable": 2, "heat_network": 2}
ORDINARY_MM = 3000


def extended(crossings: DataFrame, routes: DataFrame, key: str = "route") -> DataFrame:
    """Crossings (route, s, e, type, ...) with their extension on both sides, within the route (route, length)."""
    more = F.coalesce(*[F.when(F.col("type") == t, F.lit(m * 1000)) for t, m in EXTENSION_M.items()], F.lit(0))
    wide = crossings.join(routes.select(key, "length"), key).withColumns({"s": F.greatest(F.lit(0).cast("long"), F.col("s") - more), "e": F.least(F.col("length"), F.col("e") + more)})
    return wide.where("s < e").drop("length")


def profile_legs(profile: DataFrame, key: str = "route") -> DataFrame:
    """route, s, e, ds, de: neighbouring points of depth profiles (route, station, depth), split where they pass the ordinary depth."""
    w = Window.partitionBy(key).orderBy("station")
    legs = profile.select(key, F.col("station").alias("s"), F.lead("station").over(w).alias("e"), F.col("depth").alias("ds"), F.lead("depth").over(w).alias("de")).where("e > s")
    share = (F.lit(ORDINARY_MM) - F.col("ds")) / (F.col("de") - F.col("ds"))
    passing = F.when((F.col("ds") - ORDINARY_MM) * (F.col("de") - ORDINARY_MM) < 0, F.floor(F.col("s") + (F.col("e") - F.col("s")) * share + 0.5).cast("long"))
    split = legs.withColumn("at", F.when((passing > F.col("s")) & (passing < F.col("e")), passing))
    leg = lambda s, e, ds, de: F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"), ds.cast("long").alias("ds"), de.cast("long").alias("de"))
    level = F.lit(ORDINARY_MM)
    parts = F.when(F.col("at").isNull(), F.array(leg(F.col("s"), F.col("e"), F.col("ds"), F.col("de")))).otherwise(F.array(leg(F.col("s"), F.col("at"), F.col("ds"), level), leg(F.col("at"), F.col("e"), level, F.col("de"))))
    return split.select(key, F.explode(parts).alias("p")).select(key, "p.*")


def numbered_cuts(layers: list[DataFrame], key: str = "route") -> DataFrame:
    """route, i, a, b: the pieces between neighbouring cuts of all layers (route, s, e), numbered from 1 along the route."""
    ends = layers[0].select(key, "s", "e")
    for layer in layers[1:]:
        ends = ends.unionByName(layer.select(key, "s", "e"))
    w = Window.partitionBy(key).orderBy("a")
    cuts = ends.select(key, F.explode(F.array(F.col("s").cast("long"), F.col("e").cast("long"))).alias("a")).distinct()
    return cuts.withColumn("i", F.row_number().over(w)).withColumn("b", F.lead("a").over(w))


def over_pieces(layer: DataFrame, cuts: DataFrame, key: str = "route") -> DataFrame:
    """Rows of a layer (route, s, e, ...) once for every piece that they hold, with its number ``i``."""
    first = cuts.select(key, F.col("a").alias("s"), F.col("i").alias("first"))
    last = cuts.select(key, F.col("a").alias("e"), F.col("i").alias("last"))
    held = layer.where("s < e").join(first, [key, "s"]).join(last, [key, "e"])
    return held.withColumn("i", F.explode(F.sequence(F.col("first"), F.col("last") - 1))).drop("first", "last")


def piece_cost(rate: Column, length_mm: Column, types: Column, depth_sum: Column) -> Column:
    """Roubles and kopecks of a piece: rate by metre, largest multiplier of its types, and a tenth more for each metre of mean depth
    beyond the ordinary one; ``depth_sum`` is that of both ends."""
    factor = (F.lit(20_000) + F.greatest(F.lit(0), depth_sum - 2 * ORDINARY_MM)).cast("decimal(6,0)")
    exact = rate.cast("decimal(7,0)") * length_mm.cast("decimal(8,0)") * crossing_multiplier(types).cast("decimal(4,2)") * factor * F.lit("0.00000005").cast("decimal(9,8)")
    return F.round(exact, 2).cast(MONEY)


def route_pieces(routes: DataFrame, crossings: DataFrame, profile: DataFrame, rates: DataFrame, key: str = "route", small: int = SMALL) -> DataFrame:
    """route, i, a, b, method (base or special), types joined by +, ids joined by +, angle (the least), diameter, depth_start, depth_end, cost:
    the pieces of routes (route, length, diameter) by crossings (route, s, e, type, id, angle), with their extensions, and depth
    profiles (route, station, depth); a route without a profile lies at the ordinary depth. Every common part of crossings
    is a piece of its own. Routes of up to ``small`` rows are each laid out in a task (``lay_out``), larger ones by joins
    (``laid_by_joins``)."""
    none = lambda kind="long": F.lit(None).cast(kind)
    angle = crossings.schema["angle"].dataType.simpleString()
    plain = all(isinstance(df.schema[c].dataType, IntegralType) for df, names in ((routes, ("length", "diameter")), (crossings, ("s", "e", "angle")), (profile, ("station", "depth"))) for c in names)
    if plain:
        long = lambda c, name: F.col(c).cast("long").alias(name)
        layer = lambda kind, s, e, *rest: [key, F.lit(kind).alias("kind"), long(s, "s"), long(e, "e"), *rest]
        empty = [none("string").alias("type"), none("string").alias("id"), none(angle).alias("angle")]
        rows = routes.select(*layer(0, "length", "diameter", *empty)).unionByName(profile.select(*layer(1, "station", "depth", *empty)))
        rows = cut(rows.unionByName(crossings.select(*layer(2, "s", "e", "type", F.col("id").cast("string").alias("id"), "angle"))))
        few, many = by_size(rows, key, small)
        kind = rows.schema[key].dataType.simpleString()

        def kernel(table: SimpleNamespace) -> list[tuple]:
            return [(getattr(table, key)[0], *piece) for piece in lay_out(table.kind, table.s, table.e, table.type, table.id, table.angle)]

        names = [key, "i", "a", "b", "diameter", "types", "ids", "angle", "depth_start", "depth_end"]
        own = map_groups(few, key, ["kind", "s", "e"], kernel, f"{key} {kind}, i int, a long, b long, diameter {routes.schema['diameter'].dataType.simpleString()}, types string, ids string, angle {angle}, depth_start long, depth_end long", names)
        if many is not None:
            of = lambda df: df.join(many.select(key).distinct(), key, "left_semi")
            own = own.unionByName(laid_by_joins(of(routes), of(crossings), of(profile), key).select(*names))
    else:
        own = laid_by_joins(routes, crossings, profile, key)
    level = F.lit(ORDINARY_MM).cast("long")
    types = F.coalesce("types", F.lit("base"))
    priced = own.join(F.broadcast(rates.select("diameter", "rate")), "diameter", "left")  # the pipe catalog
    return priced.select(
        key, "i", "a", "b", F.when(F.col("types").isNull(), "base").otherwise("special").alias("method"), types.alias("types"), F.coalesce("ids", F.lit("")).alias("ids"), "angle", "diameter",
        F.coalesce("depth_start", level).alias("depth_start"), F.coalesce("depth_end", level).alias("depth_end"),
        piece_cost(F.col("rate"), F.col("b") - F.col("a"), types, F.coalesce(F.col("depth_start") + F.col("depth_end"), 2 * level)).alias("cost"),
    )


def lay_out(kinds: list[int], starts: list, stops: list, types: list, ids: list, angles: list) -> list[tuple]:
    """i, a, b, diameter, types, ids, angle, depth_start, depth_end of the pieces of one route, by the rules of ``laid_by_joins``: one row of
    kind 0 (length, diameter), points of kind 1 (station, depth) in order, crossings of kind 2."""
    if kinds[0] or starts[0] is None or starts[0] <= 0:
        return []
    length, diameter = starts[0], stops[0]
    points = [(s, d) for kind, s, d in zip(kinds, starts, stops, strict=True) if kind == 1]
    legs = []
    for (s, ds), (e, de) in pairwise(points):
        if s is None or e is None or e <= s:
            continue
        at = None
        if ds is not None and de is not None and (ds - ORDINARY_MM) * (de - ORDINARY_MM) < 0:
            at = floor(s + (e - s) * ((ORDINARY_MM - ds) / (de - ds)) + 0.5)
        if at is not None and s < at < e:
            legs += [(s, at, ds, ORDINARY_MM), (at, e, ORDINARY_MM, de)]
        else:
            legs.append((s, e, ds, de))
    special = []
    for kind, s, e, name, number, angle in zip(kinds, starts, stops, types, ids, angles, strict=True):
        if kind == 2:
            more = EXTENSION_M.get(name, 0) * 1000
            s, e = 0 if s is None else max(0, s - more), length if e is None else min(length, e + more)
            if s < e:
                special.append((s, e, name, number, angle))
    cuts = sorted({0, length, *(at for part in (*legs, *special) for at in part[:2])})
    place = {at: i for i, at in enumerate(cuts)}
    held: list[list] = [[] for _ in cuts]
    for s, e, *row in special:
        for i in range(place[s], place[e]):
            held[i].append(row)
    deep: list = [(None, None)] * len(cuts)
    for s, e, ds, de in legs:
        for i in range(place[s], place[e]):
            if ds is not None and de is not None:
                deep[i] = tuple(floor(ds + (de - ds) * ((at - s) / (e - s)) + 0.5) for at in cuts[i : i + 2])
    out = []
    for i in range(place[0], place[length]):
        named = (None, None, None)
        if held[i]:
            joined = ["+".join(sorted({row[c] for row in held[i]} - {None})) for c in (0, 1)]
            named = (*joined, min((row[2] for row in held[i] if row[2] is not None), default=None))
        out.append((i + 1, cuts[i], cuts[i + 1], diameter, *named, *deep[i]))
    return out


def laid_by_joins(routes: DataFrame, crossings: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """The pieces of ``route_pieces`` before they are priced, for routes of any size."""
    special, legs = cut(extended(crossings, routes, key)), cut(profile_legs(profile, key))
    whole = routes.select(key, F.lit(0).cast("long").alias("s"), F.col("length").alias("e"))
    cuts = cut(numbered_cuts([whole, special, legs], key))  # read by every layer
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "+")
    named = over_pieces(special, cuts, key).groupBy(key, "i").agg(joined("type").alias("types"), joined(F.col("id").cast("string")).alias("ids"), F.min("angle").alias("angle"))
    deep = over_pieces(legs, cuts, key).join(cuts, [key, "i"])
    at = lambda p: F.floor(F.col("ds") + (F.col("de") - F.col("ds")) * ((F.col(p) - F.col("s")) / (F.col("e") - F.col("s"))) + 0.5).cast("long")
    depths = deep.select(key, "i", at("a").alias("depth_start"), at("b").alias("depth_end"))
    return over_pieces(whole, cuts, key).select(key, "i").join(cuts, [key, "i"]).join(routes.select(key, "diameter"), key).join(named, [key, "i"], "left").join(depths, [key, "i"], "left")


def piece_features(pieces: DataFrame, routes: DataFrame, key: str = "route") -> DataFrame:
    """object_type, id, variant, start_node, end_node, length_mm, cost: the pieces as pipes between nodes, and a technical node at each
    inner cut; ``routes`` (route, variant, length, up_node, down_node)."""
    node = lambda at: F.concat_ws(":", F.col("variant").cast("string"), F.col(key).cast("string"), at.cast("string"))
    end = lambda c: F.concat_ws(":", F.col("variant").cast("string"), F.concat(F.lit("n"), F.col(c).cast("string")))
    all_of = pieces.join(routes.select(key, "variant", "length", "up_node", "down_node"), key)
    start = F.when(F.col("a") == 0, end("up_node")).otherwise(node(F.col("a")))
    stop = F.when(F.col("b") == F.col("length"), end("down_node")).otherwise(node(F.col("b")))
    none = F.lit(None).cast("string")
    pipes = all_of.select(F.lit("heat_network").alias("object_type"), F.concat_ws(":", node(F.lit("p")), F.col("i").cast("string")).alias("id"), "variant", start.alias("start_node"), stop.alias("end_node"), (F.col("b") - F.col("a")).alias("length_mm"), "cost")
    inner = all_of.where("b < length").select(F.lit("technical_node").alias("object_type"), node(F.col("b")).alias("id"), "variant", none.alias("start_node"), none.alias("end_node"), F.lit(None).cast("long").alias("length_mm"), F.lit(None).cast(MONEY).alias("cost"))
    return pipes.unionByName(inner)


def unreconciled(features: DataFrame, summaries: DataFrame) -> DataFrame:
    """variant, pieces, declared: variants whose pieces, chambers and tie-ins (``summaries``: variant, chambers, tie_in_cost, construction)
    don't add up to the construction cost that is declared, to the kopeck."""
    pipes = features.where("object_type = 'heat_network'").groupBy("variant").agg(F.sum("cost").cast(MONEY).alias("pipes"))
    total = (F.coalesce("pipes", F.lit(0).cast(MONEY)) + F.col("chambers") + F.col("tie_in_cost")).cast(MONEY)
    both = summaries.join(pipes, "variant", "left").select("variant", total.alias("pieces"), F.col("construction").cast(MONEY).alias("declared"))
    return both.where(F.col("pieces") != F.col("declared"))
