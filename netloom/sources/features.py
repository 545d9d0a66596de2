"""Reading, storing and publishing geographic features.

A stored feature table has one row per feature: import_id, feature_id,
object_type, attributes (JSON text), geometry type, coordinates in metres and a
bounding box. It is partitioned by import and object type, so typed scans prune
files, and box predicates on minx .. maxy reach Parquet's row-group statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import utm_forward

CORE_TYPES = ["source", "heat_network", "heat_chamber", "oks_future", "oks_connection_point"]
WINDOW_MARGIN_M = 610
MAP_LIMIT = 10_000
PAGE_DEFAULT, PAGE_MOST = 1000, 10_000
FEATURE = "type string, geometry struct<type:string,coordinates:string>, properties string"
BOX = ["minx", "miny", "maxx", "maxy"]


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON FeatureCollections with their position. Coordinates and properties stay JSON text, because
    their depth and types differ by feature; ``load`` types them."""
    schema = f"type string, features array<struct<{FEATURE.replace(' string', ':string').replace('geometry ', 'geometry:')}>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    rooted = whole.select(F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(F.raise_error(F.lit("INVALID_COLLECTION_TYPE"))).alias("features"))
    return rooted.select(F.posexplode("features").alias("feature_index", "f")).select("feature_index", "f.*")


def input_digest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of raw input files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def flat_coordinates(coordinates: Column) -> Column:
    """All numbers of a coordinates text, in order: longitude and latitude alternate at any nesting depth."""
    return F.transform(F.regexp_extract_all(coordinates, F.lit(r"-?\d+\.?\d*(?:[eE][-+]?\d+)?"), F.lit(0)), lambda v: v.cast("double"))


def load(features: DataFrame, import_id: str, zone: int = 37) -> DataFrame:
    """Typed, projected feature rows ready to be stored."""
    numbers = flat_coordinates(F.col("geometry.coordinates"))
    points = F.transform(F.sequence(F.lit(1), (F.size("__n") / 2).cast("int")), lambda i: F.struct(F.element_at("__n", (2 * i - 1).cast("int")).alias("lon"), F.element_at("__n", (2 * i).cast("int")).alias("lat")))

    def metric(p: Column) -> Column:
        x, y = utm_forward(p["lon"], p["lat"], zone)
        return F.struct(x.alias("x"), y.alias("y"))

    prop = lambda name: F.get_json_object("properties", f"$.{name}")
    out = features.withColumn("__n", numbers).withColumn("points", F.transform(points, metric)).drop("__n")
    edge = lambda f, c: f(F.transform("points", lambda p: p[c]))
    return out.select(
        F.lit(import_id).alias("import_id"), "feature_index", prop("id").alias("feature_id"), prop("object_type").alias("object_type"), F.col("properties").alias("attributes"), F.col("geometry.type").alias("geometry_type"), "points",
        edge(F.array_min, "x").alias("minx"), edge(F.array_min, "y").alias("miny"), edge(F.array_max, "x").alias("maxx"), edge(F.array_max, "y").alias("maxy"),
        prop("diameter").cast("int").alias("diameter"), prop("flow_tph").cast("decimal(18,3)").alias("flow"), F.coalesce(prop("oks_id"), prop("upstream_object_id")).alias("reference"),
    )


def store(features: DataFrame, path: str) -> None:
    """Append to the feature table; sorting by box inside files keeps row-group ranges narrow for window scans."""
    features.repartition("import_id", "object_type").sortWithinPartitions("minx", "miny").write.mode("append").partitionBy("import_id", "object_type").parquet(path)


def new_imports(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Imports whose (contract_version, sha256) the registry doesn't hold yet; of equal candidates the first id wins."""
    first = candidates.withColumn("n", F.row_number().over(Window.partitionBy("contract_version", "sha256").orderBy("import_id"))).where("n = 1").drop("n")
    return first.join(registry, ["contract_version", "sha256"], "left_anti")


def page(features: DataFrame, cursor: str | int | None, size: int = PAGE_DEFAULT, key: str = "feature_id") -> DataFrame:
    """The next page after a key: a pushed filter and a bounded top k."""
    if not 1 <= size <= PAGE_MOST:
        raise ValueError("page size")
    rows = features if cursor is None else features.where(F.col(key) > cursor)
    return rows.orderBy(key).limit(size)


def typed(features: DataFrame, types: list[str] = CORE_TYPES) -> DataFrame:
    return features.where(F.col("object_type").isin(types))


def in_window(features: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    return features.where((F.col("maxx") >= minx) & (F.col("minx") <= maxx) & (F.col("maxy") >= miny) & (F.col("miny") <= maxy))


def by_ids(features: DataFrame, ids: DataFrame, key: str = "feature_id") -> DataFrame:
    return features.join(ids.select(key), key, "left_semi")


def routing_window(features: DataFrame, anchors: DataFrame, margin: float = WINDOW_MARGIN_M) -> DataFrame:
    """Core features and everything that meets the anchors' box widened by the margin, once each; rows of one id that differ raise
    CONFLICTING_FEATURE. The box is one aggregated row of four numbers; put into the filter as values it is pushed to the scan."""
    box = anchors.agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
    if box[0] is None:
        return typed(features)
    near = in_window(features, box[0] - margin, box[1] - margin, box[2] + margin, box[3] + margin)
    return once(typed(features).unionByName(near))


def once(features: DataFrame, key: str = "feature_id") -> DataFrame:
    """One row of each key; CONFLICTING_FEATURE if two rows of a key are not equal."""
    row = F.struct(*features.columns)
    both = features.groupBy(key).agg(F.min(row).alias("low"), F.max(row).alias("high"))
    conflict = F.raise_error(F.concat(F.lit("CONFLICTING_FEATURE "), F.col(key).cast("string")))
    return both.select(F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(conflict).alias("row")).select("row.*")


def map_view(features: DataFrame, rings: DataFrame, minx: float, miny: float, maxx: float, maxy: float, limit: int = MAP_LIMIT) -> DataFrame:
    """Features and derived building rings of a viewport in id order, at most ``limit``, with a flag whether more exist."""
    both = in_window(features, minx, miny, maxx, maxy).unionByName(in_window(rings, minx, miny, maxx, maxy), allowMissingColumns=True)
    top = both.orderBy("feature_id", "layer").limit(limit + 1)  # a bounded top k, numbered by one task
    numbered = top.withColumn("n", F.row_number().over(Window.orderBy("feature_id", "layer")))
    return numbered.withColumn("truncated", F.max(F.col("n") > limit).over(Window.partitionBy())).where(F.col("n") <= limit)


def building_rings(features: DataFrame, distance: float = 5.0) -> DataFrame:
    """Boxes ``distance`` metres around buildings, as a layer of the map."""
    grown = {c: F.col(c) + (-distance if c.startswith("min") else distance) for c in BOX}
    return features.where("object_type IN ('oks_existing', 'oks_future')").withColumns(grown).withColumn("layer", F.lit("ring"))


def multiply(features: DataFrame, copies: int, step: float) -> DataFrame:
    """Shifted copies with scoped ids, for scale tests: one generator, no join."""
    spread = features.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    moved = {c: F.col(c) + F.col("copy") * step for c in BOX if c.endswith("x")}
    return spread.withColumns(moved | {"feature_id": F.concat_ws(":", F.col("copy").cast("string"), "feature_id")}).drop("copy")


def curate(features: DataFrame, properties: str = "properties") -> DataFrame:
    """Reference features as they are kept: a map of properties without colours and without empty values; the origin stays."""
    empty = lambda v: F.coalesce(F.regexp_replace(v, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "") == "", F.lit(True))
    return features.withColumn(properties, F.map_filter(properties, lambda k, v: ~F.lower(k).contains("color") & ~empty(v)))


def in_memory(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A feature table from rows that a caller holds, with the columns of a stored one: every scan above reads it as well."""
    return spark.createDataFrame(rows, schema)


def to_geojson(rows: DataFrame, geometry: str = "geometry", properties: str = "properties") -> DataFrame:
    """One GeoJSON feature text per row."""
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(geometry).alias("geometry"), F.col(properties).alias("properties"))).alias("value"))


def export(rows: DataFrame, path: str, problems: DataFrame) -> None:
    """Write features as text lines, unless the contract check found anything: nothing is written before it passes."""
    if bad := problems.take(5):
        raise ValueError(f"the output contract is violated: {bad}")
    to_geojson(rows).write.mode("overwrite").text(path)
