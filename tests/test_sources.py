"""Sources and sinks on odd input."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waygraph.operators import tiles
from waygraph.sources import files, images, sinks
from waygraph.streaming import resume


def test_boxes_are_parsed_and_checked():
    assert files.parse_box("1,2,3,4") == (1.0, 2.0, 3.0, 4.0)
    for bad in ("3,2,1,4", "1,4,3,2", "1,2,3", "a,b,c,d"):
        with pytest.raises(ValueError, match="box|numbers"):
            files.parse_box(bad)


def test_other_manifests_are_refused(spark):
    with pytest.raises(ValueError, match="not a manifest"):
        files.read_manifest(spark, "x.yaml")


def test_choosing_nothing_is_an_error(spark):
    with pytest.raises(ValueError, match="no tile"):
        tiles.choose(spark.range(3).withColumnRenamed("id", "k"), [1], [1])


def test_graph_json_as_network(spark, tmp_path):
    (tmp_path / "g.json").write_text("[[[41.0, -71.0], [41.1, -71.2], [41.3, -71.0]], [[0, 1], [1, 2]]]")
    got = files.read_network(spark, f"file://{tmp_path}/g.json").orderBy("x", "y").collect()
    assert [(r["x"], r["y"]) for r in got] == [(-71.2, 41.1), (-71.2, 41.1), (-71.0, 41.0), (-71.0, 41.3)]
    assert {r["epsg"] for r in got} == {4326}


def test_features_keep_nulls(spark):
    n = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "id long, x double, y double")
    e = spark.createDataFrame([(1, 2, None, 1, True)], "u long, v long, score double, edge_type int, synthetic boolean")
    f = sinks.edge_features(e, n).first()["feature"]
    assert '"confidence":null' in f and '"confidence_bin":"synthetic"' in f and '"coordinates":[[0.0,0.0],[1.0,1.0]]' in f


def test_graphs_are_saved(spark, tmp_path):
    n = spark.createDataFrame([("a", 1, 0.0, 0.0), ("b", 2, 1.0, 1.0)], "tile_id string, id long, x double, y double")
    e = spark.createDataFrame([("a", 1, 2, 0.9, 1, False)], "tile_id string, u long, v long, score double, edge_type int, synthetic boolean")
    sinks.save_graph(n, e, f"file://{tmp_path}/g")
    assert spark.read.parquet(f"file://{tmp_path}/g/nodes").count() == 2
    assert spark.read.text(f"file://{tmp_path}/g/features").first()["value"].startswith('{"type":"Feature"')


def test_cache_is_rebuilt_for_a_new_version(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    at = f"file://{tmp_path}/c"
    assert [resume.cached(spark, at, v, build).count() for v in ("a", "a", "b")] == [1, 1, 2]


def test_number_specs(spark):
    s = spark.createDataFrame([("3",), ("7-5",), (" 9 - 9 ",), ("x",), (None,)], "spec string")
    assert sorted(r["tile"] for r in files.expand_ids(s).collect()) == [3, 5, 6, 7, 9]


def test_natural_key(spark):
    s = spark.createDataFrame([("region_10.p",), ("region_9.p",), ("none",)], "n string")
    assert [r["n"] for r in s.orderBy(files.natural_key(F.col("n")).asc_nulls_last()).collect()] == ["region_9.p", "region_10.p", "none"]


def test_nested_collections(spark):
    g = '{"type":"LineString","coordinates":[[0,0],[1,1]]}'
    for _ in range(3):
        g = '{"type":"GeometryCollection","geometries":[' + g + "]}"
    assert files.geojson_lines(spark.createDataFrame([(1, g)], "fid long, geometry string")).count() == 2
    for _ in range(4):
        g = '{"type":"GeometryCollection","geometries":[' + g + "]}"
    with pytest.raises(Exception, match="nested"):
        files.geojson_lines(spark.createDataFrame([(1, g)], "fid long, geometry string")).collect()


def test_unknown_systems_are_an_error(spark):
    far = spark.createDataFrame([(500.0, 2.0)], "x double, y double")
    with pytest.raises(Exception, match="not degrees"):
        files.checked_crs(far).collect()
    assert files.checked_crs(far.where("x < 0").unionByName(spark.createDataFrame([(1.0, 2.0)], "x double, y double"))).first()["epsg"] == 4326


def test_png_filters_and_masks():
    rnd = np.random.default_rng(1)
    img = rnd.integers(0, 256, (9, 7, 3)).astype(np.uint8)
    assert (images.decode_png(images.encode_png(img)) == img).all()
    # every line filter, made by its definition
    lines = []
    flat = img.astype(int)
    zero = np.zeros((7, 3), int)
    for r in range(9):
        how, now, up = r % 5, flat[r], flat[r - 1] if r else zero
        left = np.vstack([zero[:1], now[:-1]])
        corner = np.vstack([zero[:1], up[:-1]])
        p = left + up - corner
        near = np.stack([abs(p - left), abs(p - up), abs(p - corner)])
        guess = [zero, left, up, (left + up) // 2, np.choose(near.argmin(axis=0), [left, up, corner])][how]
        lines.append(bytes([how]) + ((now - guess) % 256).astype(np.uint8).tobytes())
    head = struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"0000"
    raw = images.SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (images.decode_png(raw) == img).all()
    with pytest.raises(ValueError, match="two dimensions"):
        images.decode(images.encode_png(img), mask=True)
    with pytest.raises(ValueError, match="not a PNG"):
        images.decode(b"GIF89a", mask=False)
