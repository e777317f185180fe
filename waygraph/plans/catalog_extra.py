"""The third part of the catalogue: images, option parsing, orders, losses, compositions, logs."""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from waygraph.functions import geo
from waygraph.operators import evaluate as ev
from waygraph.operators import graph, labels, learning, merge, spatial, tiles
from waygraph.plans import fixtures as fx
from waygraph.plans.catalog import m, micro, query
from waygraph.plans.catalog_more import AB2, NODE_A, PATHS, SEG, SUPPLIER, _network, _node_a, _ring_graphs, _segments, _side, _supplier_points
from waygraph.plans.storage import dealt, shared_dir
from waygraph.sources import files, images, sinks
from waygraph.streaming import resume

T = fx.table


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _put(spark, path: str, raw: bytes) -> None:
    """Writes a small file to wherever Spark's file systems reach."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at)
    out.write(bytearray(raw))
    out.close()


def _tile_images(spark, sf, kind):
    """Files of three tiles: the greatest value of each place, 0 where there is none."""
    best = fx.pixels(spark, sf).groupBy("tile", "r", "c").agg(F.max("v").alias("v")).toPandas()  # three tiles of 64 x 48
    path = _folder(spark, "images")
    for t, rows in best.groupby("tile"):
        v = np.zeros((64, 48), np.int64)
        v[rows.r.to_numpy(int), rows.c.to_numpy(int)] = rows.v
        if kind == "npy":
            out = io.BytesIO()
            np.save(out, v.astype(np.uint8))
            raw = out.getvalue()
        else:
            raw = images.encode_png(v if kind == "mask" else np.stack([v, v * 7 % 256, v * 3 % 256], axis=2))
        _put(spark, f"{path}/tile_{t}.{'npy' if kind == 'npy' else 'png'}", raw)
    return path


def _tile_of():
    return F.regexp_extract("path", r"tile_(\d+)", 1).cast("long").alias("tile")


BEST = "SELECT tile, r, c, max(v) AS v FROM fx_pixel GROUP BY tile, r, c"


@query("s07_rgb_image", f"SELECT tile, r, c, v AS red, v * 7 % 256 AS green, v * 3 % 256 AS blue FROM ({BEST}) WHERE v > 0")
def _(spark, sf):
    return images.read_pixels(spark, _tile_images(spark, sf, "rgb")).where("red > 0").select(_tile_of(), "r", "c", "red", "green", "blue")


@query("s08_grey_mask", f"SELECT tile, r, c, v FROM ({BEST}) WHERE v > 0")
def _(spark, sf):
    return images.read_pixels(spark, _tile_images(spark, sf, "mask"), mask=True).where("v > 0").select(_tile_of(), "r", "c", "v")


@query("s09_array_mask", f"SELECT tile, r, c, v FROM ({BEST}) WHERE v > 0")
def _(spark, sf):
    return images.read_pixels(spark, _tile_images(spark, sf, "npy"), mask=True).where("v > 0").select(_tile_of(), "r", "c", "v")


SPECS = "SELECT k, CASE k % 4 WHEN 0 THEN k || ',' || (k + 1) || ',' || (k + 2) || ',' || (k + 3) WHEN 1 THEN (k + 5) || ', 2 ,' || k || ',3' WHEN 2 THEN k || ',x,1,2' ELSE k || ',1,2' END AS spec FROM fx_manifest"
GOOD_SPEC = "k % 4 = 0"


def _specs(spark, sf):
    k = F.col("k")
    join = lambda *xs: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in xs])
    spec = F.when(k % 4 == 0, join(k, ",", k + 1, ",", k + 2, ",", k + 3)).when(k % 4 == 1, join(k + 5, ", 2 ,", k, ",3")).when(k % 4 == 2, join(k, ",x,1,2")).otherwise(join(k, ",1,2"))
    return fx.manifest(spark, sf).select("k", spec.alias("spec"))


@query("s16_box_option", f"SELECT k, CAST(k AS DOUBLE) AS south, CAST(k + 1 AS DOUBLE) AS west, CAST(k + 2 AS DOUBLE) AS north, CAST(k + 3 AS DOUBLE) AS east FROM fx_manifest WHERE {GOOD_SPEC}")
def _(spark, sf):
    return _specs(spark, sf).select("k", files.box_option(F.col("spec"), "swne").alias("b")).where("b IS NOT NULL").select("k", "b.south", "b.west", "b.north", "b.east")


@query("s17_box_option_xy", f"SELECT k, CAST(k AS DOUBLE) AS west, CAST(k + 1 AS DOUBLE) AS south, CAST(k + 2 AS DOUBLE) AS east, CAST(k + 3 AS DOUBLE) AS north FROM fx_manifest WHERE {GOOD_SPEC}")
def _(spark, sf):
    return _specs(spark, sf).select("k", files.box_option(F.col("spec"), "wsen").alias("b")).where("b IS NOT NULL").select("k", "b.west", "b.south", "b.east", "b.north")


@query("s30_line_parts", "SELECT line AS fid, count(*) AS n FROM fx_polyline WHERE line % 4 NOT IN (0, 1) GROUP BY line HAVING count(*) >= 2")
def _(spark, sf):
    pts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"], p["y"]))
    line = fx.polylines(spark, sf).groupBy(F.col("line").alias("fid")).agg(pts.alias("c"))
    text = F.to_json(F.struct(F.lit("LineString").alias("type"), F.col("c").alias("coordinates")))
    g = F.when(F.col("fid") % 4 == 0, F.lit(None)).when(F.col("fid") % 4 == 1, F.lit('{"type":"LineString","coordinates":[]}')).otherwise(text)
    return files.geojson_lines(line.select("fid", g.alias("geometry"))).groupBy("fid").agg(F.count("*").alias("n"))


UNION_LINES = "SELECT line, seq, x * 0.001::DOUBLE AS lon, y * 0.001::DOUBLE AS lat FROM fx_polyline WHERE line % 3 <> 2"


def _two_networks(spark, sf):
    p = fx.polylines(spark, sf).selectExpr("line", "seq", "x * 0.001D AS x", "y * 0.001D AS y")
    return [p.where("line % 3 = 0"), p.where("line % 3 = 1"), p.where("line % 3 = 3")]  # the last is empty


@query("s19_union_networks", f"SELECT line, seq, CAST(round_even(radians(lon) * 6378137.0 * 100, 0) AS BIGINT) AS x_cm, CAST(round_even(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 * 100, 0) AS BIGINT) AS y_cm FROM ({UNION_LINES})")
def _(spark, sf):
    got = files.union_networks(_two_networks(spark, sf))
    return got.select("line", "seq", F.rint(F.col("x") * 100).cast("long").alias("x_cm"), F.rint(F.col("y") * 100).cast("long").alias("y_cm"))


@query("p11_project_lines", f"SELECT line, {m('sum(radians(lon) * 6378137.0)')} AS sx, count(*) AS n FROM (SELECT line, x * 0.001::DOUBLE AS lon FROM fx_polyline) GROUP BY line")
def _(spark, sf):
    pts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct((p["x"] * F.lit(0.001)).alias("x"), (p["y"] * F.lit(0.001)).alias("y")))
    line = fx.polylines(spark, sf).groupBy("line").agg(pts.alias("pts"))
    moved = line.select("line", geo.project_line(F.col("pts")).alias("pts"))
    return moved.select("line", micro(F.aggregate("pts", F.lit(0.0), lambda a, p: a + p["x"])).alias("sx"), F.size("pts").cast("long").alias("n"))


BOX_SQL = "(SELECT min(k % 5 * 2001.4::DOUBLE) AS x0, min(k // 5 * 2001.4::DOUBLE) AS y0, max(k % 5 * 2001.4::DOUBLE + 2001.4::DOUBLE) AS xe, max(k // 5 * 2001.4::DOUBLE + 2001.4::DOUBLE) AS ye FROM fx_manifest WHERE k % 5 < 3 AND k < 15)"


@query("s29_ground_truth", f"SELECT sid FROM (SELECT id AS sid, x1, y1, x2, y2 FROM {SEG}), {BOX_SQL} WHERE greatest(x1, x2) < xe AND least(x1, x2) > x0 AND greatest(y1, y2) < ye AND least(y1, y2) > y0")
def _(spark, sf):
    """Lines clipped to the union of some boxes; here those that lie wholly inside, whose clip is the line itself."""
    some = fx.manifest(spark, sf).where("k % 5 < 3 AND k < 15").selectExpr("k % 5 * 2001.4D AS x0", "k div 5 * 2001.4D AS y0", "k % 5 * 2001.4D + 2001.4D AS xe", "k div 5 * 2001.4D + 2001.4D AS ye")
    s = _segments(spark, sf).withColumnRenamed("id", "sid")
    c = tiles.ground_truth(s, some, 1000)
    return c.join(dealt(s), "sid").where("cx1 = x1 AND cy1 = y1 AND cx2 = x2 AND cy2 = y2").where("greatest(x1, x2) < 6004.2D AND least(x1, x2) > 0 AND greatest(y1, y2) < 6004.2D AND least(y1, y2) > 0").select("sid")


@query("f20_filled_config", "SELECT k, CAST(coalesce(CASE WHEN k % 2 = 0 THEN k END, 8) AS VARCHAR) AS batch, CASE WHEN k % 3 = 0 THEN '' ELSE 'poly' END AS schedule FROM fx_manifest")
def _(spark, sf):
    k = F.col("k")
    given = F.map_concat(F.when(k % 2 == 0, F.create_map(F.lit("batch"), k.cast("string"))).otherwise(F.create_map().cast("map<string,string>")), F.when(k % 3 == 0, F.create_map(F.lit("schedule"), F.lit(""))).otherwise(F.create_map().cast("map<string,string>")))
    full = tiles.filled(given, {"batch": "8", "schedule": "poly"})
    return fx.manifest(spark, sf).select("k", full.alias("c")).select("k", F.col("c")["batch"].alias("batch"), F.col("c")["schedule"].alias("schedule"))


# ---- orders and sets ---------------------------------------------------------------------


@query("t01_edge_order", "SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS place FROM (SELECT DISTINCT u, v FROM fx_edge)")
def _(spark, sf):
    return graph.ranked(fx.edges(spark, sf).select("u", "v").distinct(), [F.col("u"), F.col("v")], "place")


@query("t02_score_order", "SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS place FROM (SELECT k AS id, (k * 31) % 1009 AS score FROM fx_place)")
def _(spark, sf):
    p = T(spark, sf, "part").selectExpr("p_partkey AS id", "(p_partkey * 31) % 1009 AS score")
    return graph.ranked(p, [F.col("score").desc(), F.col("id")], "place").select("id", "place")


@query("t03_top_k_nearest", f"SELECT a, b, CAST(rn AS INTEGER) AS rank FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY {AB2}, b) AS rn FROM {NODE_A} JOIN {SUPPLIER} ON {AB2} <= 640000) WHERE rn <= 3")
def _(spark, sf):
    near = spatial.near_pairs(_node_a(spark, sf), _supplier_points(spark, sf), 800)
    w = Window.partitionBy("a").orderBy("d2", "b")
    return near.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("a", "b", "rank")


@query("u03_distinct_places", "SELECT DISTINCT x // 50 AS x, y // 50 AS y FROM fx_node")
def _(spark, sf):
    return fx.nodes(spark, sf).selectExpr("x div 50 AS x", "y div 50 AS y").distinct()


@query("u07_concat_lines", "SELECT DISTINCT shape FROM (SELECT string_agg(x || ' ' || y, ',' ORDER BY seq) AS shape FROM (SELECT line % 20 AS line, seq, (line % 20 * 13 + seq * 17) % 211 AS x, (line % 20 * 7 + seq * seq * 5) % 197 AS y, line AS own FROM fx_polyline) GROUP BY own)")
def _(spark, sf):
    p = fx.polylines(spark, sf).selectExpr("line AS own", "seq", "(line % 20 * 13 + seq * 17) % 211 AS x", "(line % 20 * 7 + seq * seq * 5) % 197 AS y")
    shape = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda q: F.concat_ws(" ", q["x"].cast("string"), q["y"].cast("string"))), ",")
    halves = [p.where(F.col("own") % 2 == i).groupBy("own").agg(shape.alias("shape")) for i in (0, 1)]
    return merge.concat_shapes(halves).select("shape")


# ---- scores, losses, schedules -----------------------------------------------------------

OD = "SELECT o_custkey % 9 AS graph_id, o_custkey % 7 <> 0 AS matched, o_custkey % 7 <> 0 AND o_orderkey % 3 <> 0 AS routable, CASE WHEN o_custkey % 7 <> 0 AND o_orderkey % 3 <> 0 THEN o_orderkey * 37 % 1001 ELSE 0 END AS od FROM orders"


@query("a26_od_means", f"SELECT graph_id, count(*) AS od_pairs, count(*) FILTER (WHERE matched) AS matched_pairs, {m('count(*) FILTER (WHERE matched) / count(*)::DOUBLE')} AS endpoint_coverage, {m('count(*) FILTER (WHERE routable) / (count(*) FILTER (WHERE matched))::DOUBLE')} AS connectivity_rate, {m('avg(od)')} AS strict, {m('avg(od) FILTER (WHERE matched)')} AS matched_mean, {m('avg(od) FILTER (WHERE routable)')} AS routable_mean FROM ({OD}) GROUP BY graph_id")
def _(spark, sf):
    o = T(spark, sf, "orders").selectExpr("o_custkey % 9 AS graph_id", "o_custkey % 7 <> 0 AS matched", "o_custkey % 7 <> 0 AND o_orderkey % 3 <> 0 AS routable", "CASE WHEN o_custkey % 7 <> 0 AND o_orderkey % 3 <> 0 THEN o_orderkey * 37 % 1001 ELSE 0 END AS od")
    s = ev.od_summary(o.selectExpr("*", "od AS length", "od AS geometry", "od AS vanilla"), ["graph_id"])
    return s.select("graph_id", "od_pairs", "matched_pairs", micro(F.col("endpoint_coverage")).alias("endpoint_coverage"), micro(F.col("connectivity_rate")).alias("connectivity_rate"), micro(F.col("combined_strict")).alias("strict"), micro(F.col("combined_matched")).alias("matched_mean"), micro(F.col("combined_routable")).alias("routable_mean"))


def e4(x: str) -> str:
    return f"CAST(round_even(({x}) * 1e4, 0) AS BIGINT)"


TRUE_P = "CASE WHEN y = 1 THEN q ELSE 1 - q END"
CLAMPED = "(SELECT z, y, least(1 - 1e-7::DOUBLE, greatest(1e-7::DOUBLE, p / 1000::DOUBLE)) AS q FROM fx_prediction)"


@query("m08_cross_entropy", f"SELECT z AS class, {e4(f'sum(-ln({TRUE_P}) * (1 + y)) / sum(1 + y)')} AS loss FROM {CLAMPED} GROUP BY z")
def _(spark, sf):
    q = F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), F.col("p") / 1000))
    truth = F.when(F.col("y") == 1, q).otherwise(1 - q)
    return fx.predictions(spark, sf).groupBy(F.col("z").alias("class")).agg(F.rint(learning.cross_entropy(truth, 1 + F.col("y")) * 1e4).cast("long").alias("loss"))


@query("m08_focal", f"SELECT z AS class, {e4(f'avg(-(CASE WHEN y = 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END) * pow(1 - {TRUE_P}, 2.0::DOUBLE) * ln({TRUE_P}))')} AS loss FROM {CLAMPED} GROUP BY z")
def _(spark, sf):
    return fx.predictions(spark, sf).groupBy(F.col("z").alias("class")).agg(F.rint(learning.focal(F.col("p") / 1000, F.col("y")) * 1e4).cast("long").alias("loss"))


@query("m09_ramped_loss", f"SELECT o_orderkey AS step, {m('(exp(-0.2::DOUBLE) * (o_custkey % 100) + 0.2::DOUBLE) + exp(0.1::DOUBLE) * (o_custkey % 7) * least(1.0::DOUBLE, o_orderkey / 20000.0::DOUBLE / 0.5::DOUBLE) - 0.1::DOUBLE')} AS loss FROM orders")
def _(spark, sf):
    o = T(spark, sf, "orders")
    loss = learning.balanced_loss(F.col("o_custkey") % 100, F.col("o_custkey") % 7, (0.2, -0.1), learning.ramp(F.col("o_orderkey"), 20000, 0.5))
    return o.select(F.col("o_orderkey").alias("step"), micro(loss).alias("loss"))


STEP = "(SELECT o_orderkey AS step FROM orders WHERE o_orderkey <= 1000)"


@query("m10_learning_rate", f"SELECT step, {m('CASE WHEN step < 50 THEN step / 50.0::DOUBLE ELSE pow(1 - (step - 50) / 950.0::DOUBLE, 0.9::DOUBLE) END')} AS poly, {m('CASE WHEN step < 50 THEN step / 50.0::DOUBLE ELSE 0.5::DOUBLE * (1 + cos(pi() * ((step - 50) / 950.0::DOUBLE))) END')} AS cosine FROM {STEP}")
def _(spark, sf):
    s = T(spark, sf, "orders").where("o_orderkey <= 1000").select(F.col("o_orderkey").alias("step"))
    return s.select("step", micro(learning.learning_rate(F.col("step"), 1000)).alias("poly"), micro(learning.learning_rate(F.col("step"), 1000, schedule="cosine")).alias("cosine"))


def _scored_graphs(spark, sf):
    _, e = _ring_graphs(spark, sf)
    s = (F.col("u") * 31 + F.col("v") * 17) % 1001
    return e.select("graph_id", "u", "v", (s / 1000).alias("score"), (s >= 600).cast("int").alias("label"))


@query("g35_connectivity_loss")
def _(spark, sf):
    return learning.connectivity(_scored_graphs(spark, sf)).select("graph_id", micro(F.col("loss")).alias("loss"))


@query("g36_laplacian_loss")
def _(spark, sf):
    return learning.laplacian(_scored_graphs(spark, sf).where("u % 4 = 0 AND v % 4 = 0")).select("graph_id", F.rint(F.col("loss") * 1e4).cast("long").alias("loss"))


# ---- graphs from lines -------------------------------------------------------------------

CROSS = f"SELECT a.id AS id, ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1))::DOUBLE / ((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1)) AS t FROM seg a JOIN seg b ON a.id <> b.id WHERE {_side('a', 'b', 1)} * {_side('a', 'b', 2)} < 0 AND {_side('b', 'a', 1)} * {_side('b', 'a', 2)} < 0"


@query("g18_noded_pieces", f"WITH seg AS (SELECT * FROM {SEG}), cut AS (SELECT DISTINCT id, t FROM ({CROSS}) UNION SELECT id, unnest([0.0::DOUBLE, 1.0::DOUBLE]) FROM seg), piece AS (SELECT id, t AS t0, lead(t) OVER (PARTITION BY id ORDER BY t) AS t1 FROM cut) SELECT id, {m('x1 + t0 * (x2 - x1)')} AS ax, {m('y1 + t0 * (y2 - y1)')} AS ay, {m('x1 + t1 * (x2 - x1)')} AS bx, {m('y1 + t1 * (y2 - y1)')} AS by_ FROM piece JOIN seg USING (id) WHERE t1 IS NOT NULL")
def _(spark, sf):
    return spatial.noded(_segments(spark, sf), 250).select("id", *[micro(F.col(c)).alias(c) for c in ("ax", "ay", "bx", "by_")])


@query("g41_metric_graph", "SELECT line, count(*) AS n FROM fx_polyline GROUP BY line HAVING count(*) >= 2")
def _(spark, sf):
    """Lines read, projected to metres, built into a graph and densified; here the vertices that are the lines' own."""
    p = fx.polylines(spark, sf).selectExpr("line", "seq", "x * 0.0001D - 71 AS x", "y * 0.0001D + 41 AS y")
    keep = p.groupBy("line").agg(F.count("*").alias("n")).where("n >= 2")
    pieces = tiles.metric_pieces(p, 25.0)
    ends = pieces.where("piece = 0 OR piece = pieces").groupBy("line").agg(F.countDistinct("at").alias("n"))
    return keep.select("line").join(ends, "line").select("line", "n")


# ---- sinks and logs ----------------------------------------------------------------------


@query("k02_minimal_tiles", "SELECT tile, count(*) AS n, CAST(sum(s) AS BIGINT) AS s FROM fx_edge GROUP BY tile")
def _(spark, sf):
    path = _folder(spark, "minimal")
    sinks.save_minimal(fx.edges(spark, sf).withColumnRenamed("tile", "tile_id"), path)
    back = spark.read.schema("u long, v long, s long, t int, tile_id long").parquet(path)
    return back.groupBy(F.col("tile_id").alias("tile")).agg(F.count("*").alias("n"), F.sum("s").alias("s"))


@query("k05_network_outputs", "SELECT (SELECT count(*) FROM fx_node) AS nodes, (SELECT count(*) FROM fx_edge) AS edges, (SELECT count(*) FROM fx_edge) AS features")
def _(spark, sf):
    path = _folder(spark, "network")
    e = fx.edges(spark, sf).select("u", "v", (F.col("s") / 1000).alias("score"), F.col("t").alias("edge_type"), F.lit(False).alias("synthetic"))
    sinks.save_network(fx.nodes(spark, sf).select(F.col("nid").alias("id"), "x", "y"), e, path)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    summary = spark.read.schema("nodes long, edges long").json(f"{path}/summary")
    return summary.crossJoin(n(spark.read.schema("value string").text(f"{path}/features"), "features"))


@query("k09_run_summary", "SELECT tile AS tile_id, (SELECT count(*) FROM fx_node n WHERE n.tile = e.tile) AS nodes, count(*) AS edges FROM fx_edge e GROUP BY tile")
def _(spark, sf):
    path = _folder(spark, "summary")
    sinks.save_summary(fx.nodes(spark, sf).withColumnRenamed("tile", "tile_id"), fx.edges(spark, sf).withColumnRenamed("tile", "tile_id"), path)
    return spark.read.csv(path, header=True, schema="tile_id long, nodes long, edges long")


@query("r02_done_log", "SELECT k FROM fx_manifest WHERE k % 3 <> 0")
def _(spark, sf):
    """Tiles are logged as done once they are saved; the pending ones are those without a log line."""
    t = fx.manifest(spark, sf)
    saved, log = _folder(spark, "saved"), _folder(spark, "log")
    resume.save_then_log(t.where("k % 3 = 0").select("k", "tile_id"), saved, log)
    done = spark.read.schema("tile_id string").json(log)
    return resume.pending(t, done).select("k")


@query("r05_bounded_batches", "SELECT count(*) AS n, 4 AS batches FROM events")
def _(spark, sf):
    base = _folder(spark, "bounded")
    e = T(spark, sf, "events")
    e.repartition(8).write.parquet(f"{base}/in")
    seen = resume.stream_bounded(spark, f"{base}/in", e.schema, 2, f"{base}/out", f"{base}/check")
    return spark.read.schema(e.schema).parquet(f"{base}/out").agg(F.count("*").alias("n")).withColumn("batches", F.lit(seen))


@query("r06_isolated_failures", "SELECT k, CASE WHEN k % 4 = 0 THEN 'no such tile' END AS error FROM fx_manifest")
def _(spark, sf):
    ways = resume.isolated(fx.manifest(spark, sf).select("k"), "k", _fails)
    return ways.select("k", "error")


def _fails(k: int) -> None:
    if k % 4 == 0:
        raise ValueError("no such tile")
