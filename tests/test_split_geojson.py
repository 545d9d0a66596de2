"""Features of files cut at every few bytes equal those of the whole files."""

import json
import random

import pytest

from netloom.sources.features import read_geojson
from netloom.sources.split_geojson import read_large_geojson

ODD = ['plain', 'brace } in { text', 'quote " and \\ slash', '"features":[{', '\\"}', 'é𝄞', '', '\\\\', '[[', ']}']


def collection(seed, n):
    rng = random.Random(seed)
    features = []
    for i in range(n):
        line = [[rng.random() * 90, rng.random() * 90] for _ in range(rng.randint(1, 6))]
        properties = {"id": f"f{i}", "note": rng.choice(ODD), "nested": {"features": [{"a": [1, {"b": rng.choice(ODD)}]}]}} if i % 3 else {}
        features.append({"type": "Feature", "geometry": {"type": "LineString", "coordinates": line} if i % 7 else None, "properties": properties})
    return {"crs": {"type": "name", "properties": {"name": "x", "features": [{}]}}, "other": [{"type": "Feature"}, {}], "type": "FeatureCollection", "features": features, "later": [{"type": "Feature"}], "end": {"features": [{"q": 1}]}}


def plain(rows):
    read = lambda s: None if s is None else json.loads(s)
    return sorted((r.feature_index, r.type, r.geometry and (r.geometry.type, str(read(r.geometry.coordinates))), str(read(r.properties))) for r in rows)


@pytest.mark.parametrize("size", ["150", "2500", "128m"])
def test_cut_files(spark, tmp_path, size):
    for k, layout in enumerate(({"separators": (",", ":")}, {"indent": 2}, {"ensure_ascii": False}, {})):
        (tmp_path / f"c{k}.geojson").write_text(json.dumps(collection(k, (14, 9, 11, 0)[k]), **layout))
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, (size, "0"), strict=True):
            spark.conf.set(k, v)
        got = read_large_geojson(spark, f"file://{tmp_path}").collect()
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
    for k in range(4):
        want = read_geojson(spark, str(tmp_path / f"c{k}.geojson")).collect()
        assert plain(r for r in got if r.file.endswith(f"c{k}.geojson")) == plain(want)


def test_other_roots(spark, tmp_path):
    (tmp_path / "x.geojson").write_text('{"type": "Feature", "features": []}')
    with pytest.raises(ValueError, match="INVALID_COLLECTION_TYPE"):
        read_large_geojson(spark, str(tmp_path))
