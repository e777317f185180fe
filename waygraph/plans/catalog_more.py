"""The second half of the catalogue: filters, joins, aggregates, graphs, scores, resuming."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from waygraph.functions import geo
from waygraph.operators import evaluate as ev
from waygraph.operators import fuse, graph, labels, merge, nms, patches, skeleton, spatial, tiles
from waygraph.plans import fixtures as fx
from waygraph.plans.catalog import QUERIES, m, micro, query
from waygraph.plans.storage import dealt, shared_dir, stored
from waygraph.sources import sinks
from waygraph.streaming import resume

T = fx.table


def points(spark, sf):
    """id, x, y, score over part: places without the doubled ones."""
    return fx.places(spark, sf).selectExpr("k AS id", "x", "y", "(k * 31) % 1009 AS score")


POINT = "(SELECT k AS id, x, y, (k * 31) % 1009 AS score FROM fx_place)"


def merged(spark, sf):
    return merge.global_merge(fx.nodes(spark, sf), fx.edges(spark, sf), fx.SNAP, fx.BRIDGE, fx.THRESHOLD)


# ---- filters and row generation ----------------------------------------------------------


@query("f01_pixel_threshold", "SELECT tile, c AS x, r AS y, v AS score, patch FROM fx_pixel WHERE v > 200")
def _(spark, sf):
    return fx.pixels(spark, sf).where("v > 200").selectExpr("tile", "c AS x", "r AS y", "v AS score", "patch")


#: Bands across images of 64 x 48 pixels, rough at their edges.
BANDS = "o_orderkey {div} 3072 AS tile, o_orderkey % 48 AS x, (o_orderkey {div} 48) % 64 AS y, abs((o_orderkey {div} 48 + o_orderkey) % 24 - 12) * 20 + o_custkey % 64 AS v"
#: Zhang and Suen's rounds on (tile, x, y); 128 of them suffice for 48 columns. p1 to p8: neighbours, clockwise from above.
THIN = f"""WITH RECURSIVE px AS (SELECT tile, x, y, max(v) AS v FROM (SELECT {BANDS.format(div="//")} FROM orders) WHERE v > 120 GROUP BY ALL),
    hop(tile, x, y, a, b, n) AS (SELECT tile, x, y, x, y, 0 FROM px UNION SELECT h.tile, h.x, h.y, p.x, p.y, h.n + 1 FROM hop h JOIN px p ON p.tile = h.tile AND abs(p.x - h.a) + abs(p.y - h.b) = 1 WHERE h.n < 5),
    big AS (SELECT tile, x, y FROM hop GROUP BY ALL HAVING count(DISTINCT (a, b)) >= 6),
    run(k, tile, x, y) AS (SELECT 0, tile, x, y FROM big UNION ALL
      SELECT k + 1, tile, x, y FROM (SELECT r.k, r.tile, r.x, r.y, {", ".join(f"CAST(count(*) FILTER (WHERE a.x - r.x = {dx} AND a.y - r.y = {dy}) AS INTEGER) AS p{i}" for i, (dx, dy) in enumerate(((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)), 1))}
        FROM run r LEFT JOIN run a ON a.tile = r.tile AND a.x BETWEEN r.x - 1 AND r.x + 1 AND a.y BETWEEN r.y - 1 AND r.y + 1 WHERE r.k < 128 GROUP BY ALL)
      WHERE NOT (p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 BETWEEN 2 AND 6 AND {" + ".join(f"(1 - p{i}) * p{i % 8 + 1}" for i in range(1, 9))} = 1
        AND CASE WHEN k % 2 = 0 THEN p1 * p3 * p5 + p3 * p5 * p7 ELSE p1 * p3 * p7 + p1 * p5 * p7 END = 0))
    SELECT tile, x, y, CAST(v AS DOUBLE) AS score FROM run JOIN px USING (tile, x, y) WHERE k = 128"""


@query("f02_centre_points", THIN)
def _(spark, sf):
    return skeleton.centre_points(T(spark, sf, "orders").selectExpr(*BANDS.format(div="div").split(", ")), 120, 6)


def greedy_sql(cols: str, radius: int, where: str = "TRUE", same: str = "TRUE", free: str = "FALSE") -> str:
    """The greedy pass in rounds: a point is kept (1) once all points above it are out, and out (2) once one of them is kept."""
    return f"""WITH RECURSIVE rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS i FROM (SELECT *, CAST(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS class FROM {POINT}) WHERE {where}),
    nb AS (SELECT a.i AS lo, b.i AS hi FROM rk a JOIN rk b ON a.i < b.i AND {same} AND NOT ({free.replace("id", "b.id")}) AND abs(a.x - b.x) <= {radius} AND abs(a.y - b.y) <= {radius} AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {radius * radius}),
    run(round, i, state) AS (SELECT 0, i, 0 FROM rk UNION ALL
      SELECT any_value(r.round) + 1, r.i, CASE WHEN any_value(r.state) <> 0 THEN any_value(r.state) WHEN count(*) FILTER (WHERE a.state = 1) > 0 THEN 2 WHEN count(*) FILTER (WHERE a.state = 0) = 0 THEN 1 ELSE 0 END
      FROM run r LEFT JOIN nb ON nb.hi = r.i LEFT JOIN run a ON a.i = nb.lo WHERE EXISTS (SELECT 1 FROM run o WHERE o.state = 0) GROUP BY r.i)
    SELECT {cols} FROM rk WHERE i IN (SELECT run.i FROM run WHERE run.state = 1 AND run.round = (SELECT max(round) FROM run))"""


@query("f03_greedy_nms", greedy_sql("id, x, y, score", 200))
def _(spark, sf):
    return nms.suppress(points(spark, sf), 200).select("id", "x", "y", "score")


@query("f04_training_nms", greedy_sql("id, x, y, score", 200, free="id % 10 = 0"))
def _(spark, sf):
    p = points(spark, sf).withColumn("always", F.col("id") % 10 == 0)
    return nms.suppress(p, 200, exempt="always").select("id", "x", "y", "score")


@query("f21_centre_proposals", THIN.replace("SELECT tile, x, y, CAST(v AS DOUBLE) AS score FROM run JOIN px USING (tile, x, y) WHERE k = 128", """, pt AS (SELECT tile, x, y, v AS score, y * 48 + x AS id FROM run JOIN px USING (tile, x, y) WHERE k = 128),
    nb AS (SELECT a.tile, a.id AS lo, b.id AS hi FROM pt a JOIN pt b ON a.tile = b.tile AND (a.score > b.score OR a.score = b.score AND a.id < b.id) AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 25),
    pass(round, tile, id, state) AS (SELECT 0, tile, id, 0 FROM pt UNION ALL
      SELECT any_value(r.round) + 1, r.tile, r.id, CASE WHEN any_value(r.state) <> 0 THEN any_value(r.state) WHEN count(*) FILTER (WHERE a.state = 1) > 0 THEN 2 WHEN count(*) FILTER (WHERE a.state = 0) = 0 THEN 1 ELSE 0 END
      FROM pass r LEFT JOIN nb ON nb.tile = r.tile AND nb.hi = r.id LEFT JOIN pass a ON a.tile = nb.tile AND a.id = nb.lo WHERE EXISTS (SELECT 1 FROM pass o WHERE o.state = 0) GROUP BY r.tile, r.id)
    SELECT tile, x, y, CAST(score AS DOUBLE) AS score FROM pt JOIN pass USING (tile, id) WHERE state = 1 AND round = (SELECT max(round) FROM pass)"""))
def _(spark, sf):
    line = skeleton.centre_points(T(spark, sf, "orders").selectExpr(*BANDS.format(div="div").split(", ")), 120, 6)
    return nms.suppress(line.withColumn("id", F.col("y") * 48 + F.col("x")), 5, by=["tile"]).select("tile", "x", "y", "score")


@query("f21_class_proposals", greedy_sql("class, id, x, y, score", 150, "score > 100", "a.class = b.class"))
def _(spark, sf):
    p = points(spark, sf).withColumn("class", F.when(F.col("id") % 3 == 0, 1).otherwise(0)).where("score > 100")
    return nms.suppress(p, 150, by=["class"]).select("class", "id", "x", "y", "score")


GRID = "SELECT n_nationkey AS k, 1000 + n_nationkey * 37 AS w, 700 + n_nationkey * 11 AS h, 256 AS p, n_nationkey % 7 AS n, n_nationkey % 3 * 16 AS margin FROM nation"


def _grid(spark, sf):
    return fx.manifest(spark, sf).selectExpr("k", "1000 + k * 37 AS w", "700 + k * 11 AS h", "256 AS p", "k % 7 AS n", "k % 3 * 16 AS margin")


def _edge_sql(length: str) -> str:
    return f"""SELECT DISTINCT k, pos FROM (SELECT k, greatest(0, least(e, pos)) AS pos FROM (
      SELECT k, e, 0 AS pos FROM g UNION ALL SELECT k, e, e FROM g WHERE n > 1
      UNION ALL SELECT k, e, CAST(round_even(lo + i * ((hi - lo) / greatest(n - 3, 1)::DOUBLE), 0) AS BIGINT) FROM (SELECT *, least(greatest(0, margin), e) AS lo, greatest(least(e - margin, e), least(greatest(0, margin), e)) AS hi FROM g), range(0, 10) r(i) WHERE n > 2 AND i < n - 2 AND hi > lo))"""


@query("f07_edge_inclusive", f"WITH g AS (SELECT *, w - p AS e FROM ({GRID})) {_edge_sql('w')}")
def _(spark, sf):
    g = _grid(spark, sf)
    return g.select("k", F.explode(geo.edge_inclusive(F.col("w"), F.col("p"), F.col("n"), F.col("margin"))).alias("pos"))


@query("f05_square_grid", f"WITH g AS (SELECT *, w - p AS e FROM ({GRID})), a AS ({_edge_sql('w')}) SELECT a.k, a.pos AS x0, b.pos AS y0, a.pos + 256 AS x1, b.pos + 256 AS y1 FROM a JOIN a b ON a.k = b.k")
def _(spark, sf):
    return patches.grid(_grid(spark, sf), "w", "w")


@query("f06_rect_grid", f"WITH g AS (SELECT *, w - p AS e FROM ({GRID})), a AS ({_edge_sql('w')}), g2 AS (SELECT *, h - p AS e FROM ({GRID})), b AS ({_edge_sql('h').replace('FROM g ', 'FROM g2 ').replace('FROM g)', 'FROM g2)')}) SELECT a.k, a.pos AS x0, b.pos AS y0, a.pos + 256 AS x1, b.pos + 256 AS y1 FROM a JOIN b ON a.k = b.k")
def _(spark, sf):
    return patches.grid(_grid(spark, sf), "w", "h")


@query("f08_strided_grid", f"SELECT k, pos FROM (SELECT k, range(0::BIGINT, (w - p + 1)::BIGINT, greatest(1, p - 2 * margin)::BIGINT) AS xs, w - p AS e FROM ({GRID})), LATERAL (SELECT DISTINCT unnest(list_append(xs, e::BIGINT)) AS pos)")
def _(spark, sf):
    return _grid(spark, sf).select("k", F.explode(geo.strided(F.col("w"), F.col("p"), F.col("margin"), F.lit(0))).alias("pos"))


@query("f09_coverage_patches", f"SELECT k, CAST(CASE WHEN w <= p * 4 THEN 1 ELSE ceil((w - p * 4) / (p * 4 * (1 - least(0.95::DOUBLE, margin / 20.0::DOUBLE)))) + 1 END AS INTEGER) AS n FROM ({GRID})")
def _(spark, sf):
    return _grid(spark, sf).select("k", geo.coverage_patches(F.col("w"), F.col("p") * 4, F.col("margin") / 20.0).alias("n"))


@query("f10_patch_filter", "SELECT CAST(floor(x / 400) AS BIGINT) AS i, CAST(floor(y / 400) AS BIGINT) AS j, count(*) AS n FROM fx_node GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return patches.occupied(fx.nodes(spark, sf), 400)


@query("f11_score_floor", "SELECT tile, count(*) AS n FROM fx_edge WHERE s >= 500 GROUP BY tile")
def _(spark, sf):
    return fx.edges(spark, sf).where("s >= 500").groupBy("tile").agg(F.count("*").alias("n"))


@query("f12_merge_threshold", "SELECT u, v, s, t FROM fx_kept")
def _(spark, sf):
    return merged(spark, sf)[1].where("synthetic = 0").select("u", "v", "s", "t")


IN_CORE = "x % 2502 BETWEEN 300 AND 2200 AND y BETWEEN 300 AND 9700"


@query("f13_core_window", "SELECT nid, tile, x, y FROM fx_node WHERE " + IN_CORE)
def _(spark, sf):
    return fx.nodes(spark, sf).where(IN_CORE)


@query("f14_keep_core", f"WITH core AS (SELECT nid FROM fx_node WHERE {IN_CORE}) SELECT u, v FROM fx_edge WHERE u IN (SELECT nid FROM core) OR v IN (SELECT nid FROM core)")
def _(spark, sf):
    n, e = fx.nodes(spark, sf), fx.edges(spark, sf)
    return tiles.keep_core(n, e, F.expr(IN_CORE))[1].select("u", "v")


@query("f15_prune_isolated", "SELECT nid, CAST(row_number() OVER (ORDER BY nid) - 1 AS BIGINT) AS new FROM (SELECT DISTINCT nid FROM fx_node JOIN fx_edge ON nid = u OR nid = v)")
def _(spark, sf):
    n, e = fx.nodes(spark, sf), fx.edges(spark, sf)
    return graph.dense_ids(tiles.drop_isolated(n, e), "nid")


@query("f16_invariants", "SELECT count(*) FILTER (WHERE t NOT IN (0, 1)) AS bad_type, count(*) FILTER (WHERE synthetic = 0 AND s IS NULL) AS no_score, count(*) FILTER (WHERE synthetic = 1 AND s IS NOT NULL) AS false_score, count(*) FILTER (WHERE u >= v) AS order_ FROM fx_merged")
def _(spark, sf):
    return tiles.violations(merged(spark, sf)[1])


@query("f17_pending", "SELECT tile_id FROM fx_manifest WHERE k % 2 <> 0")
def _(spark, sf):
    t = fx.manifest(spark, sf)
    return resume.pending(t, t.where("k % 2 = 0")).select("tile_id")


@query("f18_min_length", "SELECT u, v FROM fx_edge e JOIN fx_node a ON e.u = a.nid JOIN fx_node b ON e.v = b.nid WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) >= 10000")
def _(spark, sf):
    return labels.with_ends(fx.edges(spark, sf).select("u", "v"), fx.nodes(spark, sf)).where("(x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) >= 10000").select("u", "v")


@query("f19_include_exclude", "SELECT tile_id FROM fx_manifest WHERE k IN (1, 2, 3, 5, 8, 13, 21) AND k NOT IN (2, 13)")
def _(spark, sf):
    return tiles.choose(fx.manifest(spark, sf), [1, 2, 3, 5, 8, 13, 21], [2, 13]).select("tile_id")


@query("f22_in_bounds", "SELECT nid FROM fx_node WHERE x > 30 AND x < 306 * 30 - 30 AND y > 30 AND y < 306 * 30 - 30")
def _(spark, sf):
    return tiles.in_bounds(fx.nodes(spark, sf), 306 * 30, 30).select("nid")


@query("f23_one_per_cell", "SELECT min(nid) AS nid FROM fx_node GROUP BY floor(x / 97), floor(y / 97)")
def _(spark, sf):
    return patches.one_per_cell(fx.nodes(spark, sf), 97).select("nid")


# ---- joins -------------------------------------------------------------------------------


@query("j01_points_in_patches", "SELECT nid, k FROM fx_node JOIN (SELECT k, k % 5 * 2000 AS x0, k // 5 * 2000 AS y0, k % 5 * 2000 + 2200 AS x1, k // 5 * 2000 + 2200 AS y1 FROM fx_manifest) ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def _(spark, sf):
    boxes = fx.manifest(spark, sf).selectExpr("k", "k % 5 * 2000 AS x0", "k div 5 * 2000 AS y0", "k % 5 * 2000 + 2200 AS x1", "k div 5 * 2000 + 2200 AS y1")
    return spatial.box_join(fx.nodes(spark, sf), boxes, 1000).select("nid", "k")


@query("j02_radius_join", "SELECT a.nid AS a, b.nid AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM fx_node a JOIN fx_node b ON a.nid < b.nid AND abs(a.x - b.x) <= 100 AND abs(a.y - b.y) <= 100 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 10000")
def _(spark, sf):
    return spatial.radius_join(fx.nodes(spark, sf), 100, "nid")


KNN = "SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM (SELECT a.nid AS a, b.nid AS b, row_number() OVER (PARTITION BY a.nid ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.nid) AS rn FROM fx_node a JOIN fx_node b ON a.nid <> b.nid AND abs(a.x - b.x) <= 300 AND abs(a.y - b.y) <= 300 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 90000) WHERE rn <= 4"


@query("j03_knn_join", KNN)
def _(spark, sf):
    return spatial.knn_join(fx.nodes(spark, sf), 300, 4, "nid")


def _supplier_points(spark, sf):
    return T(spark, sf, "supplier").selectExpr("s_suppkey AS b", "(s_suppkey * 5003) % 10007 + (s_suppkey - 1) div 1000 * 10008 AS bx", "(s_suppkey * 7001) % 10007 AS by_")


SUPPLIER = "(SELECT s_suppkey AS b, (s_suppkey * 5003) % 10007 + (s_suppkey - 1) // 1000 * 10008 AS bx, (s_suppkey * 7001) % 10007 AS by_ FROM supplier)"
NODE_A = "(SELECT nid AS a, x AS ax, y AS ay FROM fx_node)"
AB2 = "(ax - bx) * (ax - bx) + (ay - by_) * (ay - by_)"


def _node_a(spark, sf):
    return fx.nodes(spark, sf).selectExpr("nid AS a", "x AS ax", "y AS ay")


@query("j04_nearest_join", f"SELECT n.a, q.b FROM {NODE_A} n LEFT JOIN (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY {AB2}, b) AS rn FROM {NODE_A} JOIN {SUPPLIER} ON {AB2} <= 160000) WHERE rn = 1) q ON n.a = q.a")
def _(spark, sf):
    return spatial.nearest_join(_node_a(spark, sf), _supplier_points(spark, sf), 400).select("a", "b")


@query("j05_near_any", f"SELECT DISTINCT a FROM {NODE_A} JOIN {SUPPLIER} ON {AB2} <= 90000")
def _(spark, sf):
    return spatial.near_any(_node_a(spark, sf), _supplier_points(spark, sf), 300).select("a")


def _segments(spark, sf):
    e = fx.edges(spark, sf).where("s >= 600").select("u", "v")
    return labels.with_ends(e, fx.nodes(spark, sf)).selectExpr("u * 1000003 + v AS id", "x1", "y1", "x2", "y2")


SEG = "(SELECT u * 1000003 + v AS id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM fx_edge JOIN fx_node a ON u = a.nid JOIN fx_node b ON v = b.nid WHERE s >= 600)"


def _side(p, q, e):
    return f"sign(({p}.x2 - {p}.x1) * ({q}.y{e} - {p}.y1) - ({p}.y2 - {p}.y1) * ({q}.x{e} - {p}.x1))"


@query("j06_crossovers", f"SELECT a.id AS a, b.id AS b FROM {SEG} a JOIN {SEG} b ON a.id < b.id WHERE {_side('a', 'b', 1)} * {_side('a', 'b', 2)} < 0 AND {_side('b', 'a', 1)} * {_side('b', 'a', 2)} < 0")
def _(spark, sf):
    return spatial.crossings(_segments(spark, sf), 250)


PSD = "CASE WHEN n2 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / n2)) END"


@query("j07_buffer_join", f"SELECT pid, sid FROM (SELECT *, {PSD} AS t FROM (SELECT nid AS pid, x::DOUBLE AS px, y::DOUBLE AS py FROM fx_node), (SELECT id AS sid, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE AS n2 FROM {SEG})) WHERE (px - (x1 + t * (x2 - x1))) * (px - (x1 + t * (x2 - x1))) + (py - (y1 + t * (y2 - y1))) * (py - (y1 + t * (y2 - y1))) <= 1600")
def _(spark, sf):
    p = fx.nodes(spark, sf).selectExpr("nid AS pid", "x AS px", "y AS py")
    return spatial.near_segments(p, _segments(spark, sf).withColumnRenamed("id", "sid"), 40)


@query("j10_seam_bridges", "SELECT u, v, t FROM fx_bridge")
def _(spark, sf):
    return merged(spark, sf)[1].where("synthetic = 1").select("u", "v", "t")


@query("j12_single_touch", "SELECT n FROM (SELECT u AS n FROM fx_edge UNION ALL SELECT v FROM fx_edge) GROUP BY n HAVING count(*) = 1")
def _(spark, sf):
    return graph.degree(fx.edges(spark, sf)).where("degree = 1").select("n")


@query("j14_clip", f"""SELECT sid, bid, {m('x1 + t0 * dx')} AS cx1, {m('y1 + t0 * dy')} AS cy1, {m('x1 + t1 * dx')} AS cx2, {m('y1 + t1 * dy')} AS cy2 FROM (
  SELECT *, greatest(0.0, CASE WHEN dx = 0 THEN 0.0 ELSE least((x0 - x1) / dx, (xe - x1) / dx) END, CASE WHEN dy = 0 THEN 0.0 ELSE least((y0 - y1) / dy, (ye - y1) / dy) END) AS t0,
  least(1.0, CASE WHEN dx = 0 THEN 1.0 ELSE greatest((x0 - x1) / dx, (xe - x1) / dx) END, CASE WHEN dy = 0 THEN 1.0 ELSE greatest((y0 - y1) / dy, (ye - y1) / dy) END) AS t1
  FROM (SELECT id AS sid, x1, y1, x2, y2, (x2 - x1)::DOUBLE AS dx, (y2 - y1)::DOUBLE AS dy FROM {SEG}), (SELECT k AS bid, k % 5 * 2001.4 AS x0, k // 5 * 2001.4 AS y0, k % 5 * 2001.4 + 2001.4 AS xe, k // 5 * 2001.4 + 2001.4 AS ye FROM (SELECT k::DOUBLE AS k0, k FROM fx_manifest)) b0
  WHERE greatest(x1, x2) >= x0 AND least(x1, x2) <= xe AND greatest(y1, y2) >= y0 AND least(y1, y2) <= ye) WHERE t0 < t1""".replace("2001.4", "2001.4::DOUBLE"))
def _(spark, sf):
    boxes = fx.manifest(spark, sf).selectExpr("k AS bid", "k % 5 * 2001.4D AS x0", "k div 5 * 2001.4D AS y0", "k % 5 * 2001.4D + 2001.4D AS xe", "k div 5 * 2001.4D + 2001.4D AS ye")
    c = spatial.clip(_segments(spark, sf).withColumnRenamed("id", "sid"), boxes, 1000)
    return c.select("sid", "bid", *[micro(F.col(n)).alias(n) for n in ("cx1", "cy1", "cx2", "cy2")])


@query("j15_edge_ends", "SELECT e.u, e.v, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM fx_edge e JOIN fx_node a ON e.u = a.nid JOIN fx_node b ON e.v = b.nid")
def _(spark, sf):
    return labels.with_ends(fx.edges(spark, sf).select("u", "v"), fx.nodes(spark, sf))


# ---- aggregates --------------------------------------------------------------------------


@query("a01_pixel_mean", "SELECT tile, r, c, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM fx_pixel GROUP BY tile, r, c")
def _(spark, sf):
    return fuse.pixel_mean(fx.pixels(spark, sf))


@query("a02_edge_means", "SELECT u, v, mix, CAST(sum(s) AS BIGINT) AS total, count(*) AS n FROM fx_observation GROUP BY u, v, mix")
def _(spark, sf):
    return fuse.edge_means(fx.observations(spark, sf))


@query("a03_fuse_passes", f"SELECT u, v, {m('p')} AS p, t FROM (SELECT u, v, mix AS t, CAST(sum(s) AS DOUBLE) / count(*) AS p, row_number() OVER (PARTITION BY u, v ORDER BY CAST(sum(s) AS DOUBLE) / count(*) DESC, mix DESC) AS rn FROM fx_observation GROUP BY u, v, mix) WHERE rn = 1")
def _(spark, sf):
    f = fuse.fuse_passes(fuse.edge_means(fx.observations(spark, sf)))
    return f.select("u", "v", micro(F.col("p")).alias("p"), "t")


@query("a04_edge_dedup", "SELECT u, v, CASE WHEN synthetic = 0 THEN s END AS s, t, synthetic FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY synthetic, CASE WHEN synthetic = 0 THEN s ELSE 0 END DESC, t DESC) AS rn FROM (SELECT u, v, s, mix AS t, CAST(patch % 3 = 0 AS INTEGER) AS synthetic FROM fx_observation)) WHERE rn = 1")
def _(spark, sf):
    o = fx.observations(spark, sf).withColumn("synthetic", (F.col("patch") % 3 == 0).cast("int"))
    return merge.dedup_edges(o.select("u", "v", F.when(F.col("synthetic") == 0, F.col("s")).alias("s"), F.col("mix").alias("t"), "synthetic"))


@query("a05_cluster_centroids", f"SELECT cid, {m('x')} AS x, {m('y')} AS y FROM fx_center")
def _(spark, sf):
    n = fx.nodes(spark, sf)
    return merge.centers(n, merge.snap_clusters(n, fx.SNAP)).select("cid", micro(F.col("x")).alias("x"), micro(F.col("y")).alias("y"))


@query("a06_origin_tiles", "SELECT cid, len(tiles) AS n, CAST(list_sum(tiles) AS BIGINT) AS s FROM fx_center")
def _(spark, sf):
    n = fx.nodes(spark, sf)
    c = merge.centers(n, merge.snap_clusters(n, fx.SNAP))
    return c.select("cid", F.size("tiles").cast("long").alias("n"), F.aggregate("tiles", F.lit(0).cast("long"), lambda a, b: a + b).alias("s"))


@query("a07_incident_votes", "SELECT n, CAST(v0 AS BIGINT) AS v0, CAST(v1 AS BIGINT) AS v1 FROM fx_vote")
def _(spark, sf):
    return merge.votes(merged(spark, sf)[1].where("synthetic = 0"))


@query("a08_degree", "SELECT n, count(*) AS degree FROM (SELECT u AS n FROM fx_edge UNION ALL SELECT v FROM fx_edge WHERE u <> v) GROUP BY n")
def _(spark, sf):
    return graph.degree(fx.edges(spark, sf))


REACH = f"RECURSIVE se AS (SELECT u, v FROM fx_edge WHERE s >= 600), two AS (SELECT u, v FROM se UNION SELECT v, u FROM se), reach(a, b) AS (SELECT u, u FROM two UNION SELECT r.a, t.v FROM reach r JOIN two t ON r.b = t.u), comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"


def _network(spark, sf):
    return fx.edges(spark, sf).where("s >= 600").select("u", "v")


@query("a09_large_components", f"WITH {REACH}, part AS (SELECT u, v, component FROM se JOIN comp ON id = u) SELECT u, v FROM part WHERE component IN (SELECT component FROM part GROUP BY component HAVING count(*) >= 3)")
def _(spark, sf):
    return graph.large_components(_network(spark, sf), 3)


@query("a10_pair_labels", "SELECT u, v, max(mix) AS label FROM fx_observation GROUP BY u, v")
def _(spark, sf):
    return fx.observations(spark, sf).groupBy("u", "v").agg(F.max("mix").alias("label"))


PRF_SQL = "SELECT s.l_returnflag AS tile, count(*) AS n_pred, count(*) FILTER (WHERE l_quantity > 25) AS hit, count(*) FILTER (WHERE l_discount > 0.04) AS n_ref, count(*) FILTER (WHERE l_discount > 0.04 AND l_tax > 0.03) AS hit_ref FROM lineitem s GROUP BY 1"


def _prf_rows(spark, sf):
    c = lambda e: F.count_if(F.expr(e))
    return T(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("tile")).agg(F.count("*").alias("n_pred"), c("l_quantity > 25").alias("hit"), c("l_discount > 0.04D").alias("n_ref"), c("l_discount > 0.04D AND l_tax > 0.03D").alias("hit_ref"))


@query("a11_precision_recall", f"SELECT tile, {m('p')} AS p, {m('r')} AS r, {m('CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END')} AS f1 FROM (SELECT tile, hit / n_pred::DOUBLE AS p, hit_ref / n_ref::DOUBLE AS r FROM ({PRF_SQL}))")
def _(spark, sf):
    p, r, f1 = ev.prf(*(F.col(c) for c in ("hit", "n_pred", "hit_ref", "n_ref")))
    return _prf_rows(spark, sf).select("tile", micro(p).alias("p"), micro(r).alias("r"), micro(f1).alias("f1"))


@query("a12_micro_macro", f"SELECT {m('sum(hit) / sum(n_pred)::DOUBLE')} AS micro_p, {m('avg(hit / n_pred::DOUBLE)')} AS macro_p FROM ({PRF_SQL})")
def _(spark, sf):
    return _prf_rows(spark, sf).agg(micro(ev.ratio(F.sum("hit"), F.sum("n_pred"))).alias("micro_p"), micro(F.avg(ev.ratio(F.col("hit"), F.col("n_pred")))).alias("macro_p"))


@query("a13_weighted_mean", "SELECT n_regionkey, CAST(CASE WHEN sum(c_nationkey) > 0 THEN trunc(sum(c_custkey * c_nationkey) / sum(c_nationkey)::DOUBLE * 1000) ELSE 0 END AS BIGINT) AS w FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey")
def _(spark, sf):
    c = T(spark, sf, "customer").join(T(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.groupBy("n_regionkey").agg((ev.weighted_mean(F.col("c_custkey"), F.col("c_nationkey")) * 1000).cast("long").alias("w"))


@query("a14_mean_or_zero", f"SELECT {m('coalesce(avg(p) FILTER (WHERE y = 1), 0)')} AS good, {m('coalesce(avg(p) FILTER (WHERE y = 9), 0)')} AS none FROM fx_prediction")
def _(spark, sf):
    return fx.predictions(spark, sf).agg(micro(ev.mean_or_zero(F.col("p"), F.col("y") == 1)).alias("good"), micro(ev.mean_or_zero(F.col("p"), F.col("y") == 9)).alias("none"))


SCORED = "SELECT o_orderkey AS t, o_custkey % 40 AS od, CAST(o_orderpriority LIKE '1%' AS INTEGER) AS available, (o_orderkey * 37) % 1001 AS strict, o_custkey % 7 AS matched FROM orders"


@query("a15_tile_summary", f"SELECT count(*) AS tiles, count(*) FILTER (WHERE available = 1) AS available, count(*) FILTER (WHERE matched > 0) AS matched, {m('avg(strict)')} AS macro, {m('sum(strict * od) / sum(od)::DOUBLE')} AS weighted, {m('sum(matched) / sum(od)::DOUBLE')} AS coverage FROM ({SCORED})")
def _(spark, sf):
    t = T(spark, sf, "orders").selectExpr("o_orderkey AS t", "o_custkey % 40 AS od", "cast(o_orderpriority LIKE '1%' AS int) AS available", "(o_orderkey * 37) % 1001 AS strict", "o_custkey % 7 AS matched")
    return t.agg(F.count("*").alias("tiles"), F.count_if(F.col("available") == 1).alias("available"), F.count_if(F.col("matched") > 0).alias("matched"), micro(F.avg("strict")).alias("macro"), micro(ev.weighted_mean(F.col("strict"), F.col("od"))).alias("weighted"), micro(ev.ratio(F.sum("matched"), F.sum("od"))).alias("coverage"))


@query("a16_edge_lengths", f"SELECT count(*) AS edges, {m('max(sqrt(d2::DOUBLE))')} AS longest, CAST(sum(d2) AS BIGINT) AS d2 FROM (SELECT (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM fx_edge e JOIN fx_node a ON e.u = a.nid JOIN fx_node b ON e.v = b.nid)")
def _(spark, sf):
    d = labels.with_ends(fx.edges(spark, sf).select("u", "v"), fx.nodes(spark, sf)).selectExpr("(x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) AS d2")
    return d.agg(F.count("*").alias("edges"), micro(F.max(F.sqrt("d2"))).alias("longest"), F.sum("d2").alias("d2"))


@query("a17_graph_summary", f"WITH {REACH} SELECT (SELECT count(*) FROM comp) AS nodes, (SELECT count(*) FROM se) AS edges, count(*) AS components, max(n) AS largest FROM (SELECT component, count(*) AS n FROM comp GROUP BY component)")
def _(spark, sf):
    e = _network(spark, sf)
    c = graph.connected_components(e).groupBy("component").agg(F.count("*").alias("n")).agg(F.sum("n").alias("nodes"), F.count("*").alias("components"), F.max("n").alias("largest"))
    return c.crossJoin(F.broadcast(e.agg(F.count("*").alias("edges")))).select("nodes", "edges", "components", "largest")


@query("a18_union_box", "SELECT min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM fx_manifest")
def _(spark, sf):
    return fx.manifest(spark, sf).agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


@query("a19_score_summary", "SELECT min(s) AS low, CAST(median(s) * 2 AS BIGINT) AS twice_median, max(s) AS high, count(*) FILTER (WHERE t = 1) AS crossings FROM fx_merged")
def _(spark, sf):
    e = merged(spark, sf)[1]
    return e.agg(F.min("s").alias("low"), (F.median("s") * 2).cast("long").alias("twice_median"), F.max("s").alias("high"), F.count_if(F.col("t") == 1).alias("crossings"))


@query("a20_class_histogram", "SELECT v % 4 AS class, count(*) AS n FROM fx_pixel GROUP BY 1")
def _(spark, sf):
    return fx.pixels(spark, sf).groupBy((F.col("v") % 4).alias("class")).agg(F.count("*").alias("n"))


@query("a21_class_iou", f"SELECT class, {m('count(*) FILTER (WHERE p = class AND g = class) / count(*)::DOUBLE')} AS iou FROM (SELECT v % 4 AS p, (v // 2) % 4 AS g FROM fx_pixel), range(0, 4) c(class) WHERE p = class OR g = class GROUP BY class")
def _(spark, sf):
    return tiles.iou(fx.pixels(spark, sf).selectExpr("v % 4 AS p", "(v div 2) % 4 AS g")).select("class", micro(F.col("iou")).alias("iou"))


@query("a22_confusion", "SELECT count(*) FILTER (WHERE p >= 500 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 500 AND y = 0) AS fp, count(*) FILTER (WHERE p < 500 AND y = 1) AS fn, count(*) FILTER (WHERE p < 500 AND y = 0) AS tn FROM fx_prediction")
def _(spark, sf):
    c = lambda e, n: F.count_if(F.expr(e)).alias(n)
    return fx.predictions(spark, sf).agg(c("p >= 500 AND y = 1", "tp"), c("p >= 500 AND y = 0", "fp"), c("p < 500 AND y = 1", "fn"), c("p < 500 AND y = 0", "tn"))


@query("a23_precision_curve", f"SELECT t, {m('coalesce(tp / nullif(n, 0)::DOUBLE, 0)')} AS precision_, {m('tp / pos::DOUBLE')} AS recall FROM (SELECT t, count(*) FILTER (WHERE p >= t * 10) AS n, count(*) FILTER (WHERE p >= t * 10 AND y = 1) AS tp, count(*) FILTER (WHERE y = 1) AS pos FROM fx_prediction, range(0, 100) r(t) GROUP BY t)")
def _(spark, sf):
    return tiles.curve(fx.predictions(spark, sf), 100).select("t", micro(F.col("precision_")).alias("precision_"), micro(F.col("recall")).alias("recall"))


@query("a23_average_precision", f"SELECT {m('sum((tp - before) / total::DOUBLE * (tp / n::DOUBLE))')} AS ap FROM (SELECT n, tp, coalesce(lag(tp) OVER (ORDER BY p DESC), 0) AS before, max(tp) OVER () AS total FROM (SELECT p, CAST(sum(count(*)) OVER (ORDER BY p DESC) AS BIGINT) AS n, CAST(sum(sum(y)) OVER (ORDER BY p DESC) AS BIGINT) AS tp FROM fx_prediction GROUP BY p))")
def _(spark, sf):
    return tiles.average_precision(fx.predictions(spark, sf)).select(micro(F.col("ap")).alias("ap"))


@query("a24_soft_dice", f"SELECT z AS class, {m('1 - (2 * sum(p * y) / 1000.0::DOUBLE + 1e-6::DOUBLE) / (sum(p) / 1000.0::DOUBLE + sum(y) + 1e-6::DOUBLE)')} AS dice FROM fx_prediction GROUP BY z")
def _(spark, sf):
    loss = 1 - (2 * F.sum(F.col("p") * F.col("y")) / 1000.0 + 1e-6) / (F.sum("p") / 1000.0 + F.sum("y") + 1e-6)
    return fx.predictions(spark, sf).groupBy(F.col("z").alias("class")).agg(micro(loss).alias("dice"))


@query("a27_direction_mean", f"SELECT k, {m('(f + r) / 2.0::DOUBLE')} AS score FROM (SELECT c_nationkey AS k, avg(c_custkey) AS f, avg(c_custkey % 100) AS r FROM customer GROUP BY 1)")
def _(spark, sf):
    c = T(spark, sf, "customer")
    f = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_custkey").alias("s"))
    r = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.avg(F.col("c_custkey") % 100).alias("s"))
    return f.unionByName(r).groupBy("k").agg(micro(F.sum("s") / 2.0).alias("score"))


# ---- graphs ------------------------------------------------------------------------------


@query("g01_adjacency_edges", "SELECT u, v FROM fx_edge UNION ALL SELECT v, u FROM fx_edge")
def _(spark, sf):
    return graph.both_ways(fx.edges(spark, sf).select("u", "v"))


@query("g02_simple_graph", "SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM fx_observation")
def _(spark, sf):
    return graph.canonical(fx.observations(spark, sf))


@query("g03_components", f"WITH {REACH} SELECT id, component FROM comp")
def _(spark, sf):
    return graph.connected_components(_network(spark, sf))


@query("g04_snap_clusters", "SELECT nid, cid FROM fx_cluster")
def _(spark, sf):
    return merge.snap_clusters(fx.nodes(spark, sf), fx.SNAP)


D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


@query(
    "g05_junction_collapse",
    f"""WITH RECURSIVE hi AS (SELECT nid, x, y FROM (SELECT n, count(*) AS c FROM (SELECT u AS n FROM fx_edge UNION ALL SELECT v FROM fx_edge) GROUP BY n) JOIN fx_node ON nid = n WHERE c >= 3),
    nr AS (SELECT a.nid AS a, b.nid AS b FROM hi a JOIN hi b ON a.nid <> b.nid AND abs(a.x - b.x) <= 40 AND abs(a.y - b.y) <= 40 AND {D2} <= 1600),
    rc(a, b) AS (SELECT nid, nid FROM hi UNION SELECT rc.a, nr.b FROM rc JOIN nr ON rc.b = nr.a), cl AS (SELECT a AS nid, min(b) AS cid FROM rc GROUP BY a),
    mp AS (SELECT nid, coalesce(cid, nid) AS cid FROM fx_node LEFT JOIN cl USING (nid))
    SELECT u, v, s, t, CAST(0 AS INTEGER) AS synthetic FROM (SELECT least(a.cid, b.cid) AS u, greatest(a.cid, b.cid) AS v, s, t, row_number() OVER (PARTITION BY least(a.cid, b.cid), greatest(a.cid, b.cid) ORDER BY s DESC, t DESC) AS rn
    FROM fx_edge e JOIN mp a ON e.u = a.nid JOIN mp b ON e.v = b.nid WHERE a.cid <> b.cid) WHERE rn = 1""",
)
def _(spark, sf):
    n, e = fx.nodes(spark, sf), fx.edges(spark, sf).withColumn("synthetic", F.lit(0))
    return merge.collapse_junctions(n, e.select("u", "v", "s", "t", "synthetic"), 40)[1]


@query("g06_global_merge", "SELECT u, v, s, t, synthetic FROM fx_merged")
def _(spark, sf):
    return merged(spark, sf)[1]


@query("g06_global_nodes", f"SELECT cid, {m('x')} AS x, {m('y')} AS y FROM fx_center")
def _(spark, sf):
    return merged(spark, sf)[0].select("cid", micro(F.col("x")).alias("x"), micro(F.col("y")).alias("y"))


HOP = "RECURSIVE two AS (SELECT u, v FROM fx_edge WHERE s >= 600 UNION SELECT v, u FROM fx_edge WHERE s >= 600), walk(source, n, hop) AS (SELECT DISTINCT u, u, 0 FROM two UNION SELECT source, v, hop + 1 FROM walk JOIN two ON n = u WHERE hop < 2)"


@query("g08_hops", f"WITH {HOP} SELECT source, n, min(hop) AS hop FROM walk GROUP BY source, n")
def _(spark, sf):
    e = fx.edges(spark, sf).where("s >= 600").select("u", "v")
    start = graph.both_ways(e).select(F.col("u").alias("source")).distinct()
    return graph.hops(e, start, 2)


@query("g07_bounded_search", f"WITH {HOP.replace('WHERE hop < 2', 'WHERE hop < 2 AND n NOT IN (SELECT u FROM fx_edge WHERE s >= 600 AND t = 1 UNION SELECT v FROM fx_edge WHERE s >= 600 AND t = 1)')} SELECT source, n, min(hop) AS hop FROM walk GROUP BY source, n")
def _(spark, sf):
    e = fx.edges(spark, sf).where("s >= 600")
    start = graph.both_ways(e.select("u", "v")).select(F.col("u").alias("source")).distinct()
    stop = e.where("t = 1").select(F.explode(F.array("u", "v")).alias("n")).distinct()  # crossings are not gone through
    return graph.hops(e.select("u", "v"), start, 2, stop)


@query("g09_bridges", """WITH RECURSIVE e AS (SELECT tile, u, v FROM fx_edge WHERE s >= 600), two AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
    walk(u, v, n) AS (SELECT u, v, u FROM e UNION SELECT w.u, w.v, t.v FROM walk w JOIN two t ON t.u = w.n WHERE NOT (least(t.u, t.v) = w.u AND greatest(t.u, t.v) = w.v))
    SELECT tile AS graph_id, u, v FROM e WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.u = e.u AND w.v = e.v AND w.n = e.v)""")
def _(spark, sf):
    return tiles.bridge_edges(fx.edges(spark, sf).where("s >= 600").select(F.col("tile").alias("graph_id"), "u", "v"))


def _ring_graphs(spark, sf):
    """Graphs for path work: the sparse edges of each small cell of the plane."""
    n = fx.nodes(spark, sf)
    cell = n.selectExpr("nid", "x", "y", "(x div 1700) * 10 + (y div 1700) AS graph_id")
    e = labels.with_ends(fx.edges(spark, sf).select("u", "v"), n).join(dealt(cell.select(F.col("nid").alias("u"), F.col("graph_id").alias("g1"))), "u").join(dealt(cell.select(F.col("nid").alias("v"), F.col("graph_id").alias("graph_id"))), "v").where("g1 = graph_id")
    length = F.sqrt((F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")))
    return cell.selectExpr("graph_id", "nid AS id", "cast(x AS double) AS x", "cast(y AS double) AS y"), e.select("graph_id", "u", "v", length.alias("length"))


@query("g10_chains")
def _(spark, sf):
    n, e = _ring_graphs(spark, sf)
    return tiles.chain_rows(n, e)


@query("g11_resample")
def _(spark, sf):
    n, e = _ring_graphs(spark, sf)
    return tiles.resample_rows(n, e, 60.0)


DENS = f"SELECT u, v, i AS piece, {m('x1 + (i / n) * (x2 - x1)')} AS x, {m('y1 + (i / n) * (y2 - y1)')} AS y FROM (SELECT e.u, e.v, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, greatest(1, CAST(ceil(sqrt(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE) / 60.0) AS INTEGER)) AS n FROM fx_edge e JOIN fx_node a ON e.u = a.nid JOIN fx_node b ON e.v = b.nid), LATERAL (SELECT unnest(range(0, n + 1))::INTEGER AS i)"


@query("g12_split_edges", DENS)
def _(spark, sf):
    e = labels.with_ends(fx.edges(spark, sf).select("u", "v"), fx.nodes(spark, sf))
    return graph.split_edges(e, 60.0).select("u", "v", "piece", micro(F.col("x")).alias("x"), micro(F.col("y")).alias("y"))


@query("g13_densify_places", f"SELECT DISTINCT x AS kx, y AS ky FROM ({DENS})")
def _(spark, sf):
    e = labels.with_ends(fx.edges(spark, sf).select("u", "v"), fx.nodes(spark, sf))
    return graph.distinct_places(graph.split_edges(e, 60.0))


@query("g14_long_edges", DENS.replace("greatest(1, CAST(ceil(sqrt(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE) / 60.0) AS INTEGER))", "CAST(CASE WHEN (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) > 10000 THEN floor(sqrt(((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE) / 50.0) + 1 ELSE 1 END AS INTEGER)"))
def _(spark, sf):
    e = labels.with_ends(fx.edges(spark, sf).select("u", "v"), fx.nodes(spark, sf))
    return graph.split_long_edges(e, 100.0, 50.0).select("u", "v", "piece", micro(F.col("x")).alias("x"), micro(F.col("y")).alias("y"))


PATHS = "SELECT o_orderkey AS k, o_custkey % 500 AS lg, (o_custkey * 7) % 500 AS lp, o_orderkey % 40 AS d FROM orders"


@query("g27_path_scores", f"SELECT k, {m('l')} AS length, {m('g')} AS geometry, {m('least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE * l + 0.5::DOUBLE * g))')} AS combined FROM (SELECT k, CASE WHEN lg > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - abs(lg - lp) / lg::DOUBLE)) ELSE 0 END AS l, CASE WHEN lg > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - d / 20.0::DOUBLE)) ELSE 0 END AS g FROM ({PATHS}))")
def _(spark, sf):
    p = T(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_custkey % 500 AS lg", "(o_custkey * 7) % 500 AS lp", "o_orderkey % 40 AS d")
    length, shape, both = ev.path_scores(F.col("lg"), F.col("lp"), F.col("d"), ev.Metric())
    return p.select("k", micro(length).alias("length"), micro(shape).alias("geometry"), micro(both).alias("combined"))


@query("a25_weighted_bce", "SELECT z AS class, CAST(round_even(avg(-(1 + y) * (y * ln(q) + (1 - y) * ln(1 - q))) * 1e4, 0) AS BIGINT) AS loss FROM (SELECT z, y, least(1 - 1e-7::DOUBLE, greatest(1e-7::DOUBLE, p / 1000::DOUBLE)) AS q FROM fx_prediction) GROUP BY z")
def _(spark, sf):
    loss = ev.weighted_bce(F.col("p") / 1000, F.col("y"), 1 + F.col("y"))
    return fx.predictions(spark, sf).groupBy(F.col("z").alias("class")).agg(F.rint(loss * 1e4).cast("long").alias("loss"))


@query("g20_spread_points", """WITH RECURSIVE p AS (SELECT (x // 1700) * 10 + y // 1700 AS g, nid AS id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM fx_node),
    c AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY id) - 1 AS i, (x - avg(x) OVER w) ** 2 + (y - avg(y) OVER w) ** 2 AS off FROM p WINDOW w AS (PARTITION BY g)),
    run(step, g, id, x, y, room, place) AS (SELECT 0, g, id, x, y, CAST('Infinity' AS DOUBLE), CASE WHEN row_number() OVER (PARTITION BY g ORDER BY off, id) = 1 THEN 0 END FROM c WHERE n > 5 UNION ALL
      SELECT step + 1, g, id, x, y, room, CASE WHEN place IS NOT NULL THEN place WHEN row_number() OVER (PARTITION BY g ORDER BY place IS NOT NULL, room DESC, id) = 1 THEN step + 1 END
      FROM (SELECT r.step, r.g, r.id, r.x, r.y, r.place, least(r.room, (r.x - o.x) ** 2 + (r.y - o.y) ** 2) AS room FROM run r JOIN run o ON o.g = r.g AND o.place = o.step WHERE r.step < 4))
    SELECT g AS graph_id, CAST(place AS INTEGER) AS place, id FROM run WHERE step = 4 AND place IS NOT NULL UNION ALL SELECT g, CAST(i AS INTEGER), id FROM c WHERE n <= 5""")
def _(spark, sf):
    n, e = _ring_graphs(spark, sf)
    return tiles.spread_rows(n, e, 5)


@query("g23_whole_lengths")
def _(spark, sf):
    n, e = _ring_graphs(spark, sf)
    return tiles.od_lengths(n, e.withColumn("length", F.floor(F.col("length") * 100).cast("double")), 20000.0, 12)


@query("u05_disjoint_origins", "SELECT a.cid AS a, b.cid AS b FROM fx_center a JOIN fx_center b ON a.cid < b.cid AND abs(a.x - b.x) <= 250 AND abs(a.y - b.y) <= 250 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 62500 WHERE NOT list_has_any(a.tiles, b.tiles)")
def _(spark, sf):
    n = fx.nodes(spark, sf)
    c = stored(merge.centers(n, merge.snap_clusters(n, fx.SNAP)), "centers")
    near = spatial.radius_join(c, 250, "cid")
    t = lambda k: c.select(F.col("cid").alias(k), F.col("tiles").alias("t" + k))
    return near.join(dealt(t("a")), "a").join(dealt(t("b")), "b").where(~F.arrays_overlap("ta", "tb")).select("a", "b")


VERT = "SELECT line, seq, x // 4 AS kx, y // 4 AS ky, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM fx_polyline WINDOW w AS (PARTITION BY line ORDER BY seq)"


@query("g15_polyline_graph", f"SELECT ax, ay, bx, by_, CAST(min(d2) AS BIGINT) AS d2 FROM (SELECT least((kx, ky), (kx2, ky2))[1] AS ax, least((kx, ky), (kx2, ky2))[2] AS ay, greatest((kx, ky), (kx2, ky2))[1] AS bx, greatest((kx, ky), (kx2, ky2))[2] AS by_, d2 FROM (SELECT kx, ky, x2 // 4 AS kx2, y2 // 4 AS ky2, (x - x2) * (x - x2) + (y - y2) * (y - y2) AS d2 FROM ({VERT}) WHERE x2 IS NOT NULL)) WHERE NOT (ax = bx AND ay = by_) GROUP BY ALL")
def _(spark, sf):
    return tiles.polyline_graph(fx.polylines(spark, sf), 4)


@query("g17_line_adjacency", "SELECT DISTINCT ax, ay, bx, by_ FROM (SELECT x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM fx_polyline WINDOW w AS (PARTITION BY line ORDER BY seq)) WHERE bx IS NOT NULL AND NOT (ax = bx AND ay = by_)")
def _(spark, sf):
    return tiles.consecutive(fx.polylines(spark, sf))


@query("g16_sanitise", "SELECT n, count(DISTINCT m) FILTER (WHERE m IS NOT NULL) AS neighbours FROM (SELECT l_suppkey AS n, CASE WHEN l_suppkey = l_partkey % 100 THEN NULL ELSE l_partkey % 100 END AS m FROM lineitem UNION ALL SELECT l_partkey % 100, CASE WHEN l_suppkey = l_partkey % 100 THEN NULL ELSE l_suppkey END FROM lineitem) GROUP BY n")
def _(spark, sf):
    e = T(spark, sf, "lineitem").selectExpr("l_suppkey AS u", "l_partkey % 100 AS v")
    every = e.select(F.explode(F.array("u", "v")).alias("n")).distinct()
    two = graph.both_ways(graph.canonical(e)).groupBy(F.col("u").alias("n")).agg(F.count("*").alias("c"))
    return every.join(dealt(two), "n", "left").select("n", F.coalesce("c", F.lit(0)).alias("neighbours"))


@query("g19_control_points")
def _(spark, sf):
    n, e = _ring_graphs(spark, sf)
    return tiles.control_rows(n, e, 200.0, 20)


@query("g22_od_lengths")
def _(spark, sf):
    n, e = _ring_graphs(spark, sf)
    return tiles.od_lengths(n, e, 200.0, 12)


@query("g24_diverse_paths")
def _(spark, sf):
    n, e = _ring_graphs(spark, sf)
    return tiles.diverse_rows(n, e, 3, 0.6, 20)


def _pair(spark, sf):
    n, e = _ring_graphs(spark, sf)
    both = n.withColumn("side", F.lit("gt")).unionByName(n.withColumn("side", F.lit("pred")).withColumn("x", F.col("x") + 3))
    kept = e.where((F.col("u") + F.col("v")) % 9 != 0).withColumn("side", F.lit("pred"))
    return both, e.withColumn("side", F.lit("gt")).unionByName(kept)


METRIC = ev.Metric(spacing=300.0, points=10, pairs=20, min_path=100.0, tolerance=10.0, hops=0, candidates=10)


@query("g25_apls")
def _(spark, sf):
    rows = ev.evaluate_pairs(*_pair(spark, sf), ev.Metric(k=1, spacing=300.0, points=10, pairs=20, min_path=100.0, tolerance=10.0, hops=0, candidates=1, w_length=1.0, w_geometry=0.0), symmetric=True)
    one = rows.groupBy("graph_id", "direction").agg(ev.mean_or_zero(F.col("vanilla")).alias("apls"))
    return one.groupBy("graph_id").agg(micro(F.avg("apls")).alias("apls"))


@query("g26_path_metric")
def _(spark, sf):
    s = ev.od_summary(ev.evaluate_pairs(*_pair(spark, sf), METRIC), ["graph_id"])
    return s.select("graph_id", "od_pairs", *[micro(F.col(c)).alias(c) for c in ("route_availability", "combined_strict", "combined_routable", "length_strict", "geometry_strict", "vanilla_strict")])


@query("g29_tile_metric")
def _(spark, sf):
    s = ev.od_summary(ev.evaluate_pairs(*_pair(spark, sf), METRIC), ["graph_id"])
    w = F.col("od_pairs")
    return s.agg(F.count("*").alias("tiles"), micro(F.avg("combined_strict")).alias("macro"), micro(ev.weighted_mean(F.col("combined_strict"), w)).alias("weighted"))


@query("j08_match_points")
def _(spark, sf):
    return ev.match_rows(*_pair(spark, sf), replace(METRIC, points=0))  # every control point


@query("g21_balanced_points")
def _(spark, sf):
    n, e = _ring_graphs(spark, sf)
    return tiles.control_rows(n, e, 100.0, 8)


#: Cells of the table of two polylines (i: a line's vertices, j: its even ones), then the discrete Frechet distance by diagonals: a diagonal and the one before are carried.
LINES = """WITH RECURSIVE pt AS (SELECT line, row_number() OVER (PARTITION BY line ORDER BY seq) - 1 AS i, x, y FROM fx_polyline),
    cell AS (SELECT a.line, a.i, b.i // 2 AS j, sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) AS d FROM pt a JOIN pt b ON a.line = b.line AND b.i % 2 = 0),
    run(line, i, j, f) AS (SELECT line, i, j, d FROM cell WHERE i = 0 AND j = 0 UNION ALL
      (SELECT c.line, c.i, c.j, greatest(min(r.f), any_value(c.d)) FROM (SELECT *, max(i + j) OVER () AS s FROM run) r JOIN cell c ON c.line = r.line AND c.i - r.i BETWEEN 0 AND 1 AND c.j - r.j BETWEEN 0 AND 1 AND c.i + c.j = r.s + 1 AND (r.i + r.j = r.s OR c.i + c.j - r.i - r.j = 2) GROUP BY c.line, c.i, c.j
       UNION ALL SELECT r.line, r.i, r.j, r.f FROM (SELECT *, max(i + j) OVER () AS s FROM run) r JOIN cell c ON c.line = r.line AND c.i = r.i + 1 AND c.j = r.j + 1 WHERE r.i + r.j = r.s)),
    ends AS (SELECT line, max(i) AS i, max(j) AS j FROM cell GROUP BY line),
    far AS (SELECT line, max(d) AS h FROM (SELECT line, min(d) AS d FROM cell GROUP BY line, i UNION ALL SELECT line, min(d) FROM cell GROUP BY line, j) GROUP BY line)
    SELECT DISTINCT line, h AS hausdorff, f AS frechet FROM run JOIN ends USING (line, i, j) JOIN far USING (line)"""


@query("g28_hausdorff", LINES)
def _(spark, sf):
    return tiles.line_distances(fx.polylines(spark, sf))


CAND = f"knn AS ({KNN})"


@query("g30_candidate_graph", f"WITH {CAND} SELECT u, v, b.x - a.x AS dx, b.y - a.y AS dy FROM (SELECT u, v FROM knn UNION ALL SELECT v, u FROM knn) e JOIN fx_node a ON a.nid = e.u JOIN fx_node b ON b.nid = e.v")
def _(spark, sf):
    return labels.candidate_graph(fx.nodes(spark, sf), 300, 4)


@query("g31_pair_labels", f"WITH {CAND} SELECT k.u, k.v, CAST(CASE WHEN e.u IS NULL THEN 0 ELSE 1 END AS INTEGER) AS label FROM knn k LEFT JOIN (SELECT DISTINCT u, v FROM fx_edge WHERE s >= 600) e ON e.u = k.u AND e.v = k.v")
def _(spark, sf):
    pairs = spatial.knn_join(fx.nodes(spark, sf), 300, 4, "nid")
    return labels.label_pairs(pairs, fx.edges(spark, sf).where("s >= 600"), 1)


@query(
    "g32_snapped_labels",
    f"""WITH pt AS (SELECT nid, x + 2 AS x, y - 1 AS y FROM fx_node), knn AS ({KNN.replace("rn <= 4", "rn <= 3")}),
    sn AS (SELECT a, b FROM (SELECT a.nid AS a, b.nid AS b, row_number() OVER (PARTITION BY a.nid ORDER BY {D2}, b.nid) AS rn FROM pt a JOIN fx_node b ON abs(a.x - b.x) <= 20 AND abs(a.y - b.y) <= 20 AND {D2} <= 400) WHERE rn = 1),
    two AS (SELECT u, v FROM fx_edge WHERE s >= 600 UNION SELECT v, u FROM fx_edge WHERE s >= 600), hop AS (SELECT u, v FROM two UNION SELECT a.u, b.v FROM two a JOIN two b ON a.v = b.u)
    SELECT k.u, k.v, CAST(CASE WHEN p.b <> q.b AND EXISTS (SELECT 1 FROM hop h WHERE h.u = p.b AND h.v = q.b) THEN 1 ELSE 0 END AS INTEGER) AS label FROM knn k JOIN sn p ON p.a = k.u JOIN sn q ON q.a = k.v""",
)
def _(spark, sf):
    n = fx.nodes(spark, sf)
    moved = n.selectExpr("nid", "x + 2 AS x", "y - 1 AS y")
    return labels.snapped_labels(moved, spatial.knn_join(moved, 300, 3, "nid"), n, fx.edges(spark, sf).where("s >= 600"), 20, 2)


@query("g33_interest", f"WITH d AS (SELECT nid, x, y, coalesce(c, 0) <> 2 AS odd FROM fx_node LEFT JOIN (SELECT n, count(*) AS c FROM (SELECT u AS n FROM fx_edge WHERE s >= 600 UNION ALL SELECT v FROM fx_edge WHERE s >= 600) GROUP BY n) ON n = nid), near AS (SELECT DISTINCT a.nid FROM d a JOIN d b ON b.odd AND abs(a.x - b.x) <= 60 AND abs(a.y - b.y) <= 60 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3600), tree AS (SELECT DISTINCT a AS nid FROM {NODE_A} JOIN {SUPPLIER} ON {AB2} <= 3600) SELECT nid, CAST(CASE WHEN nid IN (SELECT nid FROM near) OR nid IN (SELECT nid FROM tree) THEN 9 ELSE 1 END AS INTEGER) AS tenths, odd OR nid IN (SELECT nid FROM tree) AS always FROM d")
def _(spark, sf):
    return labels.interest(fx.nodes(spark, sf), fx.edges(spark, sf).where("s >= 600"), _supplier_points(spark, sf), 60)


@query("g38_edge_geometry", "SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM fx_edge")
def _(spark, sf):
    return graph.canonical(graph.both_ways(fx.edges(spark, sf).select("u", "v")))


@query("g39_split", "SELECT p_partkey AS id, CASE WHEN p_partkey * 7919 % 100 < 80 THEN 'train' WHEN p_partkey * 7919 % 100 < 90 THEN 'val' ELSE 'test' END AS part FROM part")
def _(spark, sf):
    return labels.split(T(spark, sf, "part").selectExpr("p_partkey AS id"))


@query("m02_topology_canvas", "SELECT CAST(floor((a.x + (k / 9) * (b.x - a.x)) / 100) AS BIGINT) AS i, CAST(floor((a.y + (k / 9) * (b.y - a.y)) / 100) AS BIGINT) AS j, count(*) AS n FROM fx_edge JOIN fx_node a ON a.nid = u JOIN fx_node b ON b.nid = v, range(0, 10) r(k) WHERE s >= 600 GROUP BY ALL")
def _(spark, sf):
    return tiles.canvas(labels.with_ends(fx.edges(spark, sf).where("s >= 600").select("u", "v"), fx.nodes(spark, sf)), 100)


# ---- sorts, sets -------------------------------------------------------------------------


@query("t04_top_components", f"WITH {REACH} SELECT component, n FROM (SELECT component, count(*) AS n FROM comp GROUP BY component ORDER BY n DESC, component LIMIT 10)")
def _(spark, sf):
    c = graph.connected_components(_network(spark, sf)).groupBy("component").agg(F.count("*").alias("n"))
    return c.orderBy(F.col("n").desc(), "component").limit(10)


@query("t05_head", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4)")
def _(spark, sf):
    return T(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").limit(4)


@query("t06_seeded_sample", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 48271) % 2147483647, o_orderkey LIMIT 100)")
def _(spark, sf):
    return T(spark, sf, "orders").select("o_orderkey").orderBy(F.col("o_orderkey") * 48271 % 2147483647, "o_orderkey").limit(100)


@query("t07_weighted_sample", "SELECT draw, arg_min(id, (-ln(u) / w, id)) AS id FROM (SELECT draw, c_custkey AS id, 1 + c_nationkey AS w, (CAST('0x' || substr(md5(c_custkey || ':' || draw || ':42'), 1, 13) AS BIGINT) + 1) / 4503599627370497.0::DOUBLE AS u FROM customer, (SELECT CAST(unnest(range(200)) AS INTEGER) AS draw)) GROUP BY draw")
def _(spark, sf):
    return tiles.weighted_sample(T(spark, sf, "customer").selectExpr("c_custkey AS id", "1 + c_nationkey AS w"), 200, 42)


@query("u01_concat_tiles", "SELECT tile, nid, CAST(row_number() OVER (ORDER BY tile, nid) - 1 AS BIGINT) AS new FROM fx_node")
def _(spark, sf):
    n = fx.nodes(spark, sf).select("tile", "nid")
    local = n.withColumn("i", F.row_number().over(Window.partitionBy("tile").orderBy("nid")) - 1)
    sizes = n.groupBy("tile").agg(F.count("*").alias("c"))
    at = sizes.select("tile", (F.sum("c").over(Window.orderBy("tile")) - F.col("c")).alias("pos"))  # a row a tile
    return local.join(at, "tile").select("tile", "nid", (F.col("pos") + F.col("i")).alias("new"))


@query("u02_union_passes", "SELECT u, v FROM fx_observation WHERE mix = 1 AND s > 700 UNION SELECT u, v FROM fx_observation WHERE mix = 0 AND s > 500")
def _(spark, sf):
    o = fx.observations(spark, sf)
    return o.where("mix = 1 AND s > 700").select("u", "v").union(o.where("mix = 0 AND s > 500").select("u", "v")).distinct()


@query("u04_shared_edges", "SELECT u, v FROM fx_observation WHERE mix = 1 INTERSECT SELECT u, v FROM fx_observation WHERE mix = 0")
def _(spark, sf):
    o = fx.observations(spark, sf)
    return o.where("mix = 1").select("u", "v").intersect(o.where("mix = 0").select("u", "v"))


@query("u06_first_seen", "SELECT l_suppkey AS id, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1")
def _(spark, sf):
    return T(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


@query("k01_saved_graph", "SELECT tile, count(*) AS n, CAST(sum(s) AS BIGINT) AS s FROM fx_edge GROUP BY tile")
def _(spark, sf):
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    sinks.save_graph(fx.nodes(spark, sf).withColumnRenamed("tile", "tile_id"), fx.edges(spark, sf).withColumnRenamed("tile", "tile_id"), path)
    back = spark.read.schema("u long, v long, s long, t int, tile_id long").parquet(f"{path}/edges")
    return back.groupBy(F.col("tile_id").alias("tile")).agg(F.count("*").alias("n"), F.sum("s").alias("s"))


# ---- resuming ----------------------------------------------------------------------------


@query("r01_resume_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    base = f"{shared_dir(spark)}/resume-{uuid.uuid4().hex}"
    ev_ = T(spark, sf, "events")
    for half in (0, 1):  # arrivals in two goes; the second call reads only what is new
        ev_.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{base}/in")
        resume.stream_once(spark, f"{base}/in", ev_.schema, lambda b: b.select("event_type"), f"{base}/out", f"{base}/check")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("r03_merge_cache", "SELECT count(*) AS n, CAST(sum(s) AS BIGINT) AS s FROM fx_kept")
def _(spark, sf):
    path = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    for _ in range(2):
        got = resume.cached(spark, path, "v1", lambda: merged(spark, sf)[1].where("synthetic = 0"))
    return got.agg(F.count("*").alias("n"), F.sum("s").alias("s"))


@query("r04_rejects", "SELECT count(*) FILTER (WHERE k % 5 <> 0) AS good, count(*) FILTER (WHERE k % 5 = 0) AS bad FROM fx_manifest")
def _(spark, sf):
    good, bad = resume.split_rejects(fx.manifest(spark, sf), F.when(F.col("k") % 5 == 0, "unreadable"))
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("bad")))


@query("x01_event_windows", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    w = resume.windowed_counts(T(spark, sf, "events"))
    return w.select(F.to_date("w.start").alias("day"), "event_type", "n")


from waygraph.plans import catalog_extra  # noqa: E402,F401  the rest of the queries
