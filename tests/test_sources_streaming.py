import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netloom.functions.geometry import utm_forward
from netloom.operators import topology
from netloom.sources import features
from netloom.streaming import jobs


@pytest.fixture
def city(tmp_path):
    rows = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [39.0, 55.0]}, "properties": {"id": "s", "object_type": "source"}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[39.0, 55.0], [39.01, 55.0]]}, "properties": {"id": "n", "object_type": "heat_network", "diameter": 50, "flow_tph": 3.5, "upstream_object_id": "s"}},
    ]
    path = tmp_path / "city.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": rows}))
    return str(path)


def test_geojson_round_trip(spark, city, tmp_path):
    loaded = features.load(features.read_geojson(spark, city), "i1")
    features.store(loaded, str(tmp_path / "t"))
    stored = {r.feature_id: r for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert abs(stored["s"].minx - 500_000) < 1e-3 and len(stored["n"].points) == 2 and stored["n"].diameter == 50 and stored["n"].reference == "s"
    assert 630 < stored["n"].maxx - stored["n"].minx < 650
    assert len(features.input_digest(spark, city).first().sha256) == 64


def test_wrong_collection_type(spark, tmp_path):
    path = tmp_path / "x.geojson"
    path.write_text('{"type": "Feature", "features": []}')
    with pytest.raises(Exception, match="INVALID_COLLECTION_TYPE"):
        features.read_geojson(spark, str(path)).collect()


def test_utm_equator_scale(spark):
    x, y = utm_forward(F.lit(39.0), F.lit(0.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x - 500_000) < 1e-6 and abs(r.y) < 1e-6


def test_source_in_memory(spark):
    """Scans read rows that a caller holds as they read stored ones; an empty one has the same columns."""
    schema = "feature_id string, object_type string, minx double, maxx double, miny double, maxy double"
    rows = [{"feature_id": f"f{i}", "object_type": ("source", "restriction")[i % 2], "minx": i * 10.0, "maxx": i * 10.0 + 5, "miny": 0.0, "maxy": 5.0} for i in range(6)]
    held = features.in_memory(spark, rows, schema)
    assert [r.feature_id for r in features.typed(held).orderBy("feature_id").collect()] == ["f0", "f2", "f4"]
    assert {r.feature_id for r in features.in_window(held, 12, 0, 33, 1).collect()} == {"f1", "f2", "f3"}
    assert [r.feature_id for r in features.page(held, "f3", 2).collect()] == ["f4", "f5"]
    assert features.in_memory(spark, [], schema).columns == held.columns


def test_export_checks_first(spark, tmp_path):
    rows = spark.createDataFrame([("g", "p")], "geometry string, properties string")
    with pytest.raises(ValueError, match="contract"):
        features.export(rows, str(tmp_path / "o"), spark.createDataFrame([("X",)], "code string"))
    assert not (tmp_path / "o").exists()


def test_nearest_equals_all_pairs(spark):
    """Even, crowded and far points; ties; fewer targets than asked for; none."""
    p = spark.range(60).select(F.col("id").alias("point_id"), (F.col("id") * 7919 % 1000 + F.when(F.col("id") == 7, 90_000).otherwise(0)).alias("x"), (F.col("id") * 104729 % 1000).alias("y"))
    t = spark.range(45).select(F.col("id").alias("chamber_id"), F.when(F.col("id") < 20, 500).otherwise(F.col("id") * 15485863 % 1000).alias("x"), F.when(F.col("id") < 20, 500).otherwise(F.col("id") * 32452843 % 1000).alias("y"))
    points, targets = p.collect(), t.collect()
    for k in (1, 3, 50):
        want = sorted((a.point_id, c, d, r + 1) for a in points for r, (d, c) in enumerate(sorted(((a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.chamber_id) for b in targets)[:k]))
        assert sorted(map(tuple, topology.nearest(p, t, k).collect())) == want
    assert topology.nearest(p, t.limit(0), 2).collect() == topology.nearest(p.limit(0), t, 2).collect() == []
    seg = t.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("y").alias("bx"), F.col("x").alias("by"))
    ends = [tuple(r) for r in seg.collect()]

    def distance(x, y, ax, ay, bx, by):
        n = (bx - ax) ** 2 + (by - ay) ** 2
        u = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0
        return ((x - ax - u * (bx - ax)) ** 2 + (y - ay - u * (by - ay)) ** 2) ** 0.5

    got = {r.point_id: r.distance for r in topology.distance_to_segments(p, seg).collect()}
    assert got == pytest.approx({a.point_id: min(distance(a.x, a.y, *e) for e in ends) for a in points})


LEASE = "event_id long, ts timestamp, job_id long, kind string"


def follow_once(spark, folder, lease_ms):
    """What is there now, then stop: the state stays in the checkpoint."""
    stream = spark.readStream.schema(LEASE).parquet(f"{folder}/in")
    q = jobs.follow(stream, lease_ms).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/c").option("path", f"{folder}/out").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return {(r.job_id, r.state, r.attempt) for r in spark.read.schema(jobs.OUTPUT).parquet(f"{folder}/out").collect()}


def test_lease_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    t = datetime(2026, 1, 1)
    rows = [(1, t, 7, "queued"), (2, t + timedelta(seconds=1), 7, "claimed"), (3, t + timedelta(seconds=2), 7, "completed"), (4, t, 8, "queued"), (5, t + timedelta(seconds=5), 8, "cancel"), (6, t, 9, "queued"), (7, t, 9, "claimed")]
    spark.createDataFrame(rows, LEASE).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = {(7, "queued", 0), (7, "running", 1), (7, "completed", 1), (8, "queued", 0), (8, "cancelled", 0), (9, "queued", 0), (9, "running", 1)}
    assert follow_once(spark, tmp_path, 1500) == seen
    time.sleep(2)  # job 9 gives no sign of life, so its lease runs out; then it is claimed again
    spark.createDataFrame([(8, t, 10, "queued")], LEASE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen |= {(10, "queued", 0), (9, "queued", 1)}
    assert follow_once(spark, tmp_path, 1500) == seen
    spark.createDataFrame([(9, t + timedelta(seconds=60), 9, "claimed")], LEASE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert follow_once(spark, tmp_path, 60_000) == seen | {(9, "running", 2)}
