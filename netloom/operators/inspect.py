"""Input inspection: every check is one SELECT of issue rows, all united.

Features carry feature_index, feature_id, object_type, geometry_type, flow,
diameter, reference. Only the checks across rows (duplicates, references,
coverage) need an exchange; the others are one narrow pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import DIAMETERS, GEOMETRY_OF, OBJECT_TYPES

ERROR_CAP = 1000
NETWORK_TYPES = ["source", "heat_network", "heat_chamber"]


def blank(text: Column) -> Column:
    """True for null and for text of characters up to the space only."""
    return F.coalesce(F.regexp_replace(text, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "") == "", F.lit(True))


def issues(features: DataFrame) -> DataFrame:
    """code, severity, feature_index, feature_id of all findings. Properties are checked only for known types."""
    known = features.where(F.col("object_type").isin(OBJECT_TYPES))
    allowed = reduce(lambda c, t: c.when(F.col("object_type") == t, F.col("geometry_type").isin(GEOMETRY_OF[t])), OBJECT_TYPES[1:], F.when(F.col("object_type") == OBJECT_TYPES[0], F.col("geometry_type").isin(GEOMETRY_OF[OBJECT_TYPES[0]])))
    is_type = lambda *t: F.col("object_type").isin(*t)
    bad_flow = F.col("flow").isNull() | (F.col("flow") <= 0)
    bad_diameter = F.col("diameter").isNull() | ~F.col("diameter").isin(DIAMETERS)
    row_checks = [
        ("MISSING_FIELD", "error", features, blank(F.col("feature_id"))),
        ("UNSUPPORTED_OBJECT_TYPE", "error", features, ~is_type(*OBJECT_TYPES)),
        ("INVALID_GEOMETRY_TYPE", "error", known, ~allowed),
        ("INVALID_NUMBER", "error", known, is_type("oks_future") & bad_flow),
        ("INVALID_DIAMETER", "error", known, (is_type("heat_network") & bad_diameter) | (is_type("heat_chamber") & F.col("diameter").isNotNull() & bad_diameter)),
        ("MISSING_EXISTING_NETWORK_VALUE", "warning", known, is_type("heat_network") & bad_flow),
        ("MISSING_EXISTING_NETWORK_LINK", "warning", known, is_type("heat_network", "heat_chamber") & blank(F.col("reference"))),
        ("MISSING_CHAMBER_DIAMETER", "warning", known, is_type("heat_chamber") & F.col("diameter").isNull()),
    ]
    # one scan for all row checks: each row lists the checks that it fails
    found = F.array_compact(F.array(*[F.when(F.col("__known") | F.lit(source is features), F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))) for code, severity, source, test in row_checks]))
    single = features.withColumn("__known", is_type(*OBJECT_TYPES)).select(F.explode(found).alias("i"), "feature_index", "feature_id").select("i.code", "i.severity", "feature_index", "feature_id")

    named = known.where(~blank(F.col("feature_id")))
    order = F.row_number().over(Window.partitionBy("feature_id").orderBy("feature_index"))
    duplicate = named.withColumn("n", order).where("n > 1").select(F.lit("DUPLICATE_FEATURE_ID").alias("code"), F.lit("error").alias("severity"), "feature_index", "feature_id")
    types = named.groupBy(F.col("feature_id").alias("reference")).agg(F.min_by("object_type", "feature_index").alias("actual"))
    wanted = F.when(is_type("oks_connection_point"), F.array(F.lit("oks_future"))).when(is_type("heat_network", "heat_chamber"), F.array(*map(F.lit, NETWORK_TYPES)))
    pointing = named.withColumn("wanted", wanted).where(F.col("wanted").isNotNull() & ~blank(F.col("reference"))).join(types, "reference", "left")
    code = F.when(F.col("actual").isNull(), "UNKNOWN_REFERENCE").when(~F.array_contains("wanted", F.col("actual")), "INVALID_REFERENCE_TYPE")
    references = pointing.select(code.alias("code"), F.lit("error").alias("severity"), "feature_index", "feature_id").where("code IS NOT NULL")
    linked = named.where(is_type("oks_connection_point") & ~blank(F.col("reference"))).select(F.col("reference").alias("feature_id")).distinct()
    lonely = named.where(is_type("oks_future")).select("feature_id").distinct().join(linked, "feature_id", "left_anti").select(F.lit("MISSING_OKS_CONNECTION_POINT").alias("code"), F.lit("error").alias("severity"), F.lit(-1).cast("long").alias("feature_index"), "feature_id")
    return single.unionByName(duplicate).unionByName(references).unionByName(lonely)


def counts_by_type(features: DataFrame) -> DataFrame:
    """Features of every known type, zero where there are none."""
    spark = features.sparkSession
    types = spark.createDataFrame([(t,) for t in OBJECT_TYPES], "object_type string")
    return types.join(features.groupBy("object_type").agg(F.count("*").alias("n")), "object_type", "left").select("object_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def first_errors(found: DataFrame, cap: int = ERROR_CAP) -> DataFrame:
    """The first ``cap`` errors in a total order: the report's own limit, a bounded top k."""
    return found.where("severity = 'error'").orderBy("feature_index", "code", "feature_id").limit(cap)


def profile(features: DataFrame) -> DataFrame:
    """extended_input if any future building is there, else baseline_input."""
    return features.agg(F.when(F.bool_or(F.col("object_type") == "oks_future"), "extended_input").otherwise("baseline_input").alias("profile"))


def demands(features: DataFrame) -> DataFrame:
    """Flow of every connection point: its own, else the first that its building gives; ``missing`` where neither has one."""
    buildings = features.where("object_type = 'oks_future'").groupBy(F.col("feature_id").alias("reference")).agg(F.min_by("flow", F.when(F.col("flow").isNotNull(), F.col("feature_index"))).alias("building_flow"))
    points = features.where("object_type = 'oks_connection_point'").join(buildings, "reference", "left")
    flow = F.coalesce("flow", "building_flow")
    return points.select("feature_index", "feature_id", flow.alias("flow"), flow.isNull().alias("missing"))


def run_parameters(least_depth: float, greatest_depth: float) -> None:
    if not 0.7 <= least_depth <= 3.0 <= greatest_depth <= 50.0:
        raise ValueError("depths must satisfy 0.7 <= least <= 3.0 <= greatest <= 50")


def parameter_issues(runs: DataFrame) -> DataFrame:
    """run_id, code of stored parameters (least_depth, greatest_depth) that no run may have; an unset pair is a default one."""
    low, high = F.col("least_depth"), F.col("greatest_depth")
    codes = F.array_compact(F.array(F.when(low.isNull() != high.isNull(), "PARAMETER_PAIR"), F.when((low < 0.7) | (low > 3.0), "LEAST_DEPTH"), F.when((high < 3.0) | (high > 50.0), "GREATEST_DEPTH")))
    return runs.select("run_id", F.explode(codes).alias("code"))


INTEGRAL = r"^(BIGINT|DECIMAL\([0-9]+,0\))$"
NUMERIC = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*)$"


def property_issues(features: DataFrame) -> DataFrame:
    """feature_index, code: JSON types of the properties (text): an id is text or a whole number, a flow a positive number, a
    diameter a whole number of the catalog; broken text is one finding."""
    v = F.try_parse_json("properties")
    typed = features.select("feature_index", v.alias("v"))
    for name in ("id", "flow_tph", "diameter"):
        typed = typed.withColumn(f"t_{name}", F.schema_of_variant(F.variant_get("v", f"$.{name}", "variant")))
    text = F.try_variant_get("v", "$.id", "string")
    number = F.try_variant_get("v", "$.flow_tph", "double")
    whole = F.try_variant_get("v", "$.diameter", "int")
    there = lambda c: F.col(c).isNotNull() & (F.col(c) != "VOID")
    codes = F.array_compact(
        F.array(
            F.when(F.col("v").isNull(), "INVALID_PROPERTIES"),
            F.when(F.col("v").isNotNull() & (~there("t_id") | blank(text)), "MISSING_FIELD"),
            F.when(there("t_id") & ~blank(text) & (F.col("t_id") != "STRING") & ~F.col("t_id").rlike(INTEGRAL), "INVALID_ID"),
            F.when(there("t_flow_tph") & ~(F.col("t_flow_tph").rlike(NUMERIC) & F.coalesce(number > 0, F.lit(False))), "INVALID_NUMBER"),
            F.when(there("t_diameter") & ~(F.col("t_diameter").rlike(INTEGRAL) & F.coalesce(whole.isin(DIAMETERS), F.lit(False))), "INVALID_DIAMETER"),
        )
    )
    return typed.select("feature_index", F.explode(codes).alias("code"))


def geometry_issues(polygons: DataFrame, cell: float) -> DataFrame:
    """feature_index, code of polygons given as a ring of (lon, lat): EMPTY_GEOMETRY below four places, INVALID_COORDINATE out of
    range or not finite, OPEN_RING, SELF_INTERSECTION of sides that are not neighbours."""
    from .topology import segment_crossings

    ring = F.col("ring")
    n = F.size(ring)
    finite = lambda p: p["lon"].isNotNull() & p["lat"].isNotNull() & ~F.isnan(p["lon"]) & ~F.isnan(p["lat"]) & (F.abs(p["lon"]) <= 180) & (F.abs(p["lat"]) <= 90)
    closed = F.element_at(ring, 1) == F.element_at(ring, -1)
    codes = F.array_compact(F.array(F.when(F.coalesce(n, F.lit(0)) < 4, "EMPTY_GEOMETRY"), F.when(~F.forall(ring, finite), "INVALID_COORDINATE"), F.when((n >= 4) & ~closed, "OPEN_RING")))
    plain = polygons.select("feature_index", F.explode(codes).alias("code"))
    sides = polygons.where((n >= 4) & F.forall(ring, finite)).select("feature_index", "ring", n.alias("n"), F.explode(F.sequence(F.lit(1), n - 1)).alias("id"))
    at = lambda i, c: F.element_at("ring", i)[c]
    segments = sides.select("feature_index", "id", "n", at(F.col("id"), "lon").alias("ax"), at(F.col("id"), "lat").alias("ay"), at(F.col("id") + 1, "lon").alias("bx"), at(F.col("id") + 1, "lat").alias("by"))
    met = segment_crossings(segments.drop("n"), cell, group=["feature_index"]).join(segments.select("feature_index", "n").distinct(), "feature_index")
    apart = (F.col("o_id") - F.col("id") > 1) & ~((F.col("id") == 1) & (F.col("o_id") == F.col("n") - 1))
    return plain.unionByName(met.where(apart).select("feature_index", F.lit("SELF_INTERSECTION").alias("code")).distinct())


def first_of_each(issues: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Issues without repetitions: of equal ``keys`` the one that comes first."""
    return issues.groupBy(*keys).agg(F.min(order).alias(order))


def lost_members(old: DataFrame, new: DataFrame, group: str, member: str) -> DataFrame:
    """Members that a new set of each group no longer has: an extension is additive if there are none."""
    return old.select(group, member).distinct().join(new.select(group, member).distinct(), [group, member], "left_anti")
