"""The library's queries over the star-schema tables, each with its SQL where SQL can say it."""

from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.functions import geo

from waygraph.operators import graph, labels
from waygraph.plans import fixtures as fx
from waygraph.plans.storage import shared_dir
from waygraph.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = fx.with_relations(sql)
        return f

    return put


def micro(x):
    """A double as whole millionths, so that engines can be compared exactly."""
    return F.rint(x * 1e6).cast("long")


M = "CAST(round_even({} * 1e6, 0) AS BIGINT)"


def m(x: str) -> str:
    return M.format(f"({x})")


# ---- sources ---------------------------------------------------------------------------

MANIFEST = "SELECT tile_id, image_path, minx, miny, maxx, maxy FROM fx_manifest"


def _written(spark, sf, kind):
    import uuid

    rows = fx.manifest(spark, sf)
    path = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}.{kind}"
    if kind == "csv":
        rows.select(F.col("tile_id").alias("id"), "image_path", "minx", "miny", "maxx", "maxy").coalesce(1).write.csv(path, header=True)
    else:  # one document: a manifest is a small list of tiles
        one = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("tile_id", "image_path", F.array("minx", "miny", "maxx", "maxy").alias("bbox")))).alias("tiles")))
        rows.agg(one.alias("value")).write.text(path)
    return path


@query("s01_manifest_json", MANIFEST)
def _(spark, sf):
    return files.read_manifest(spark, _written(spark, sf, "json")).drop("pos")


@query("s02_manifest_csv", MANIFEST)
def _(spark, sf):
    return files.read_manifest(spark, _written(spark, sf, "csv")).drop("pos")


@query("s03_manifest_from_boxes", "SELECT tile_id, printf('img_%03d.png', k + 7) AS image_path, minx, miny, maxx, maxy FROM fx_manifest WHERE k % 3 <> 0")
def _(spark, sf):
    b = fx.manifest(spark, sf).selectExpr("k AS i", "miny AS south", "minx AS west", "maxy AS north", "maxx AS east")
    have = b.where("i % 3 <> 0").select(F.format_string("img_%03d.png", F.col("i") + 7).alias("image_path"))
    return files.manifest_from_boxes(b, "img_%03d.png", 7, have)


BROKEN = ("CASE WHEN k % 7 = 0 THEN NULL ELSE image_path END AS image_path", "CASE WHEN k % 5 = 0 THEN NULL ELSE minx END AS minx", "miny", "CASE WHEN k % 11 = 0 THEN minx ELSE maxx END AS maxx", "maxy")
BROKEN_SQL = ", ".join(BROKEN)


@query("s04_invalid_records", f"SELECT tile_id, CASE WHEN image_path IS NULL THEN 'image_path' WHEN minx IS NULL THEN 'bbox' ELSE 'order' END AS reason FROM (SELECT tile_id, {BROKEN_SQL} FROM fx_manifest) WHERE image_path IS NULL OR minx IS NULL OR minx >= maxx")
def _(spark, sf):
    return files.invalid_records(fx.manifest(spark, sf).selectExpr("tile_id", *BROKEN))


@query("s05_valid_records", f"SELECT tile_id FROM (SELECT tile_id, {BROKEN_SQL} FROM fx_manifest) WHERE image_path IS NOT NULL AND minx IS NOT NULL AND minx < maxx")
def _(spark, sf):
    rows = fx.manifest(spark, sf).selectExpr("tile_id", *BROKEN)
    return rows.join(files.invalid_records(rows), "tile_id", "left_anti").select("tile_id")


@query("s06_select_records", "SELECT tile_id FROM (SELECT tile_id, k FROM fx_manifest WHERE k IN (3, 9, 4, 17) ORDER BY k LIMIT 3)")
def _(spark, sf):
    rows = fx.manifest(spark, sf).withColumnRenamed("k", "pos")
    return files.select_records(rows, ["tile_00009", "tile_00003", "tile_00017", "tile_00004"], 3).select("tile_id")


LINES = "SELECT line AS fid, CAST(0 AS INTEGER) AS part, CAST(row_number() OVER (PARTITION BY line ORDER BY seq) - 1 AS INTEGER) AS seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM fx_polyline WHERE line IN (SELECT line FROM fx_polyline GROUP BY line HAVING count(*) >= 2)"


def _geojson(spark, sf):
    pts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"), F.lit(9.0)))
    lines = fx.polylines(spark, sf).groupBy(F.col("line").alias("fid")).agg(pts.alias("c"))
    plain = F.to_json(F.struct(F.lit("LineString").alias("type"), F.col("c").alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.array("c").alias("coordinates")))
    nest = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), plain, F.lit(',{"type":"Point","coordinates":[1,2]}]}'))
    g = F.when(F.col("fid") % 3 == 0, plain).when(F.col("fid") % 3 == 1, multi).otherwise(nest)
    return lines.select("fid", g.alias("geometry"))


@query("s11_geojson_lines", LINES)
def _(spark, sf):
    return files.geojson_lines(_geojson(spark, sf))


@query("s10_read_network", "SELECT count(*) AS n, CAST(sum(x + y) AS BIGINT) AS s, CAST(2157 AS INTEGER) AS epsg FROM (" + LINES + ")")
def _(spark, sf):
    import uuid

    feature = F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), F.col("geometry"), F.lit("}"))
    head = '{"type":"FeatureCollection","crs":{"properties":{"name":"urn:ogc:def:crs:EPSG::2157"}},"features":['
    one = _geojson(spark, sf).agg(F.concat(F.lit(head), F.array_join(F.collect_list(feature), ","), F.lit("]}")).alias("value"))
    path = f"{shared_dir(spark)}/network-{uuid.uuid4().hex}"
    one.write.text(path)  # one document: the network of a tile
    return files.read_network(spark, path).groupBy("epsg").agg(F.count("*").alias("n"), F.sum(F.col("x") + F.col("y")).cast("long").alias("s"))


@query("s21_line_features", "SELECT DISTINCT line AS fid FROM fx_polyline WHERE line % 2 = 0 AND line IN (SELECT line FROM fx_polyline GROUP BY line HAVING count(*) >= 2)")
def _(spark, sf):
    g = F.when(F.col("fid") % 2 == 0, F.col("geometry")).otherwise(F.lit('{"type":"Point","coordinates":[1,2]}'))
    return files.geojson_lines(_geojson(spark, sf).select("fid", g.alias("geometry"))).select("fid").distinct()


@query("s12_geojson_crs", "SELECT k, CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(3000 + k AS INTEGER) END AS epsg FROM fx_manifest")
def _(spark, sf):
    doc = F.when(F.col("k") % 3 == 0, F.lit('{"type":"FeatureCollection"}')).otherwise(F.format_string('{"crs":{"properties":{"name":"urn:ogc:def:crs:EPSG::%d"}}}', F.col("k") + 3000))
    return fx.manifest(spark, sf).select("k", files.geojson_crs(doc).alias("epsg"))


@query("s13_sniff_crs", f"SELECT g, CAST(CASE WHEN min(x) >= -180 AND max(x) <= 180 AND min(y) >= -90 AND max(y) <= 90 THEN 4326 END AS INTEGER) AS epsg FROM (SELECT 'm' AS g, x, y FROM fx_node UNION ALL SELECT 'd', x / 100.0 - 90, y / 200.0 FROM fx_node) GROUP BY g")
def _(spark, sf):
    n = fx.nodes(spark, sf)
    one = lambda name, df: files.sniff_crs(df).select(F.lit(name).alias("g"), "epsg")
    return one("m", n).unionByName(one("d", n.selectExpr("x / 100D - 90 AS x", "y / 200D AS y")))


@query("s14_pixel_keys", "SELECT nid, x AS r, y AS c FROM fx_node")
def _(spark, sf):
    text = F.when(F.col("nid") % 2 == 0, F.format_string("(%d, %d)", "x", "y")).otherwise(F.format_string("[%d,%d]", "x", "y"))
    return fx.nodes(spark, sf).select("nid", files.pixel_key(text).alias("k")).select("nid", "k.r", "k.c")


@query("s15_box_list", "SELECT CAST(k AS INTEGER) AS i, miny AS south, minx AS west, maxy AS north, maxx AS east FROM fx_manifest")
def _(spark, sf):
    doc = fx.manifest(spark, sf).agg(F.array_sort(F.collect_list(F.struct("k", "miny", "minx", "maxy", "maxx"))).alias("b")).select(F.to_json(F.transform("b", lambda b: F.array(b["miny"], b["minx"], b["maxy"], b["maxx"]))).alias("doc"))
    return doc.select(F.posexplode(files.boxes_from_json(F.col("doc"))).alias("i", "b")).select("i", "b.*")


@query("s18_latest_file", "SELECT o_custkey % 50 AS dir, printf('f%d.shp', arg_max(o_orderkey, o_orderdate::VARCHAR || printf('f%d.shp', o_orderkey))) AS path FROM orders GROUP BY 1")
def _(spark, sf):
    f = fx.table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("dir"), F.col("o_orderdate").alias("time"), F.format_string("f%d.shp", "o_orderkey").alias("path"))
    return files.latest(f)


@query("s20_graph_lines", "SELECT e.u, e.v, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM fx_edge e JOIN fx_node a ON e.u = a.nid JOIN fx_node b ON e.v = b.nid WHERE e.u <> e.v")
def _(spark, sf):
    n = fx.nodes(spark, sf)
    return labels.with_ends(fx.edges(spark, sf).where("u <> v").select("u", "v"), n)


@query("s23_walkways", "SELECT n_nationkey % 9 AS geometry FROM nation WHERE n_nationkey % 4 IN (0, 1) OR n_nationkey % 7 = 5 GROUP BY 1")
def _(spark, sf):
    pair = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    k = F.col("k")
    tags = (
        F.when(k % 4 == 0, pair("highway", "footway", "footway", "sidewalk"))
        .when(k % 4 == 1, pair("highway", "footway"))
        .when(k % 7 == 5, pair("highway", "path", "foot", "designated"))
        .when(k % 4 == 2, pair("highway", "footway", "footway", "crossing"))
        .otherwise(pair("highway", "motorway"))
    )
    ways = fx.manifest(spark, sf).select(k.alias("id"), tags.alias("tags"), (k % 9).alias("geometry"))
    return files.walkways(ways).select("geometry")


@query("s25_file_priority", "SELECT tile_id, CASE WHEN k % 2 = 0 THEN 'a' WHEN k % 3 = 0 THEN 'b' END AS dir, k % 2 <> 0 AND k % 3 <> 0 AS missing FROM fx_manifest")
def _(spark, sf):
    t = fx.manifest(spark, sf)
    a, b = t.where("k % 2 = 0").select("tile_id", F.lit("a").alias("da")), t.where("k % 3 = 0").select("tile_id", F.lit("b").alias("db"))
    found = t.select("tile_id").join(a, "tile_id", "left").join(b, "tile_id", "left")
    return found.select("tile_id", F.coalesce("da", "db").alias("dir"), F.coalesce("da", "db").isNull().alias("missing"))


@query("s26_natural_sort", "SELECT name, CAST(row_number() OVER (ORDER BY k, name) AS INTEGER) AS place FROM (SELECT printf('region_%d.p', n_nationkey * 37 % 101) AS name, n_nationkey * 37 % 101 AS k FROM nation)")
def _(spark, sf):
    from pyspark.sql import Window

    names = fx.manifest(spark, sf).select(F.format_string("region_%d.p", F.col("k") * 37 % 101).alias("name"))
    w = Window.orderBy("k", "name")  # a listing of tile names
    return names.withColumn("k", files.natural_key(F.col("name"))).select("name", F.row_number().over(w).alias("place"))


@query("s27_graph_json", "SELECT gid, count(*) AS nodes, CAST(sum(deg) AS BIGINT) AS ends FROM (SELECT line AS gid, 2 AS deg FROM fx_polyline) GROUP BY gid HAVING count(*) >= 2")
def _(spark, sf):
    line = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    g = fx.polylines(spark, sf).groupBy(F.col("line").alias("gid")).agg(line.alias("p")).where(F.size("p") >= 2)
    nodes = F.to_json(F.transform("p", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))
    ring = F.to_json(F.transform("p", lambda p, i: F.array(i, (i + 1) % F.size("p"))))
    n, e = files.graph_json(g.select("gid", F.concat(F.lit("["), nodes, F.lit(","), ring, F.lit("]")).alias("doc")))
    ends = e.select("gid", F.explode(F.array("u", "v")).alias("id")).join(n, ["gid", "id"]).groupBy("gid").agg(F.count("*").alias("ends"))
    return n.groupBy("gid").agg(F.count("*").alias("nodes")).join(ends, "gid").select("gid", "nodes", "ends")


@query("s28_tile_edges", "SELECT patch % 3 AS age, count(*) AS n, count(*) FILTER (WHERE patch % 3 = 2) AS bad, CAST(sum(CASE WHEN patch % 3 < 2 THEN s ELSE 0 END) AS BIGINT) AS s FROM fx_observation GROUP BY 1")
def _(spark, sf):
    o = fx.observations(spark, sf).withColumn("age", F.col("patch") % 3)
    new = o.where("age = 0").selectExpr("cast(age AS string) AS tile_id", "u", "v", "cast(s AS double) AS edge_score", "mix AS edge_type", "false AS synthetic")
    old = o.where("age = 1").selectExpr("cast(age AS string) AS tile_id", "u", "v", "cast(s AS double) AS edge_prob", "mix AS edge_type")
    bad = o.where("age = 2").selectExpr("cast(age AS string) AS tile_id", "u", "v", "mix AS edge_type")
    raw = new.unionByName(old, allowMissingColumns=True).unionByName(bad, allowMissingColumns=True)
    got = files.tile_edges(raw)
    return got.groupBy(F.col("tile_id").cast("int").alias("age")).agg(F.count("*").alias("n"), F.count_if(F.col("bad").isNotNull()).alias("bad"), F.sum(F.coalesce("score", F.lit(0.0))).cast("long").alias("s"))


# ---- sinks -----------------------------------------------------------------------------


@query("k03_edge_features", "SELECT u, v, CASE WHEN t = 1 THEN 'crossing' ELSE 'sidewalk' END AS link_type, CASE WHEN s < 250 THEN 'very_low' WHEN s < 500 THEN 'low' WHEN s < 700 THEN 'med' WHEN s < 850 THEN 'high' ELSE 'very_high' END AS bin, s AS confidence FROM fx_edge")
def _(spark, sf):
    e = fx.edges(spark, sf).select("u", "v", (F.col("s") / 1000).alias("score"), F.col("t").alias("edge_type"), F.lit(False).alias("synthetic"))
    f = sinks.edge_features(e, fx.nodes(spark, sf).withColumnRenamed("nid", "id"))
    p = lambda k: F.get_json_object("feature", f"$.properties.{k}")
    return f.select("u", "v", p("link_type").alias("link_type"), p("confidence_bin").alias("bin"), F.rint(p("confidence").cast("double") * 1000).cast("long").alias("confidence"))


@query("k04_confidence_bins", "SELECT CASE WHEN synthetic = 1 THEN 'synthetic' WHEN s < 700 THEN 'med' WHEN s < 850 THEN 'high' ELSE 'very_high' END AS bin, count(*) AS n FROM fx_merged GROUP BY 1")
def _(spark, sf):
    from waygraph.plans.catalog_more import merged

    e = merged(spark, sf)[1]
    return e.groupBy(sinks.confidence_bin(F.col("s") / 1000, F.col("synthetic") == 1).alias("bin")).agg(F.count("*").alias("n"))


@query("k06_adjacency", "SELECT n, len(list(DISTINCT v)) AS size, CAST(list_sum(list(DISTINCT v)) AS BIGINT) AS s FROM (SELECT u AS n, v FROM fx_edge UNION ALL SELECT v, u FROM fx_edge) GROUP BY n")
def _(spark, sf):
    a = sinks.adjacency(fx.edges(spark, sf))
    return a.select("n", F.size("neighbours").cast("long").alias("size"), F.aggregate("neighbours", F.lit(0).cast("long"), lambda x, y: x + y).alias("s"))


@query("k07_score_files", "SELECT l_returnflag AS tile, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    import uuid

    path = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}"
    sinks.save_scores(fx.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("tile")).agg(F.count("*").alias("n")), path)
    return spark.read.csv(f"{path}/csv", header=True, schema="tile string, n long")


@query("k08_json_safe", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice END AS v FROM part")
def _(spark, sf):
    p = fx.table(spark, sf, "part")
    x = F.when(F.col("p_partkey") % 6 == 0, F.lit(float("nan"))).when(F.col("p_partkey") % 6 == 3, F.lit(float("-inf"))).otherwise(F.col("p_retailprice"))
    return p.select("p_partkey", sinks.json_safe(x).alias("v"))


@query("k10_graph_export", "SELECT least(u, v) AS u, greatest(u, v) AS v FROM fx_edge WHERE u % 7 <> 0 AND v % 7 <> 0 GROUP BY ALL")
def _(spark, sf):
    e = fx.edges(spark, sf)
    two = graph.both_ways(e.select("u", "v")).selectExpr("u AS n", "v AS m").where("n % 7 <> 0")
    return sinks.graph_edges_for_json(two)


# ---- projections -----------------------------------------------------------------------

def _deg(spark, sf):
    return fx.nodes(spark, sf).selectExpr("nid", "cast(-71.0 + x * 0.0001D AS double) AS lon", "cast(41.0 + y * 0.0001D AS double) AS lat")


DEGSQL = "(SELECT nid, -71.0::DOUBLE + x * 0.0001::DOUBLE AS lon, 41.0::DOUBLE + y * 0.0001::DOUBLE AS lat FROM fx_node)"


@query("p01_local_metres", f"SELECT nid, CAST(round_even(radians(lon - lon0) * cos(radians(lat0)) * 6371008.8 * 100, 0) AS BIGINT) AS x_cm, CAST(round_even(radians(lat - lat0) * 6371008.8 * 100, 0) AS BIGINT) AS y_cm FROM {DEGSQL}, (SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM {DEGSQL})")
def _(spark, sf):
    d = _deg(spark, sf)
    o = d.agg(F.avg("lon").alias("lon0"), F.avg("lat").alias("lat0"))
    x, y = geo.local_metres(*(F.col(c) for c in ("lon", "lat", "lon0", "lat0")))
    return d.crossJoin(F.broadcast(o)).select("nid", F.rint(x * 100).cast("long").alias("x_cm"), F.rint(y * 100).cast("long").alias("y_cm"))


@query("p02_tile_pixel_to_degrees", f"SELECT tile, r, c, patch, {m('minx + ((c + 0.5) / greatest(1, 48)) * (maxx - minx)')} AS lon, {m('maxy - ((r + 0.5) / greatest(1, 64)) * (maxy - miny)')} AS lat FROM (SELECT DISTINCT tile, patch, r, c FROM fx_pixel) JOIN fx_manifest ON tile = k")
def _(spark, sf):
    px = fx.pixels(spark, sf).select("tile", "patch", "r", "c").distinct().join(fx.manifest(spark, sf), F.col("tile") == F.col("k"))
    lon, lat = geo.tile_pixel_to_deg(F.col("r"), F.col("c"), F.lit(48), F.lit(64), *(F.col(c) for c in ("minx", "miny", "maxx", "maxy")))
    return px.select("tile", "r", "c", "patch", micro(lon).alias("lon"), micro(lat).alias("lat"))


@query("p03_degrees_to_eval_pixel", f"SELECT nid, CAST(round_even(least(greatest((lon - (-71.0::DOUBLE)) / (-70.1::DOUBLE - (-71.0::DOUBLE)) * 2047, 0.0), 2047.0), 0) AS BIGINT) AS c, CAST(round_even(least(greatest((41.9::DOUBLE - lat) / (41.9::DOUBLE - 41.0::DOUBLE) * 2047, 0.0), 2047.0), 0) AS BIGINT) AS r FROM {DEGSQL}")
def _(spark, sf):
    c, r = geo.deg_to_eval_px(F.col("lon"), F.col("lat"), F.lit(-71.0), F.lit(41.0), F.lit(-70.1), F.lit(41.9), 2048)
    return _deg(spark, sf).select("nid", c.alias("c"), r.alias("r"))


@query("p04_pixel_to_mercator", f"SELECT nid, {m('100.0 + (x % 2048) / 2047.0::DOUBLE * 400.0')} AS mx, {m('900.0 - (y % 2048) / 2047.0::DOUBLE * 700.0')} AS my FROM fx_node")
def _(spark, sf):
    x, y = geo.px_to_mercator(F.col("y") % 2048, F.col("x") % 2048, 2048, 2048, F.lit(100.0), F.lit(200.0), F.lit(500.0), F.lit(900.0))
    return fx.nodes(spark, sf).select("nid", micro(x).alias("mx"), micro(y).alias("my"))


@query("p05_mercator", f"SELECT nid, CAST(round_even(radians(lon) * 6378137.0 * 100, 0) AS BIGINT) AS x_cm, CAST(round_even(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0 * 100, 0) AS BIGINT) AS y_cm FROM {DEGSQL}")
def _(spark, sf):
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    return _deg(spark, sf).select("nid", F.rint(x * 100).cast("long").alias("x_cm"), F.rint(y * 100).cast("long").alias("y_cm"))


@query("p06_metric_to_pixel", "SELECT nid, greatest(0, least(1023, CAST(trunc((10007.0 - y) / 10007.0 * 1023) AS BIGINT))) AS r, greatest(0, least(511, CAST(trunc(x / 10007.0 * 511) AS BIGINT))) AS c FROM fx_node")
def _(spark, sf):
    r, c = geo.metric_to_px(F.col("x").cast("double"), F.col("y").cast("double"), F.lit(0.0), F.lit(0.0), F.lit(10007.0), F.lit(10007.0), 512, 1024)
    return fx.nodes(spark, sf).select("nid", r.cast("long").alias("r"), c.cast("long").alias("c"))


@query("p07_local_box", f"SELECT nid, {m('degrees(x / 6378137.0)')} AS lon, {m('degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2)')} AS lat FROM fx_node")
def _(spark, sf):
    lon, lat = geo.inverse_mercator(F.col("x"), F.col("y"))
    return fx.nodes(spark, sf).select("nid", micro(lon).alias("lon"), micro(lat).alias("lat"))


@query("p08_synthetic_degrees", f"SELECT nid, {m('41.0::DOUBLE - y * (156543.03392804062::DOUBLE * cos(radians(41.0)) / 1048576) / 111111.0')} AS lat, {m('-71.0::DOUBLE + x * (156543.03392804062::DOUBLE * cos(radians(41.0)) / 1048576) / (111111.0 * cos(radians(41.0)))')} AS lon FROM fx_node")
def _(spark, sf):
    lat, lon = geo.synthetic_deg(F.col("y"), F.col("x"))
    return fx.nodes(spark, sf).select("nid", micro(lat).alias("lat"), micro(lon).alias("lon"))


@query("p09_planar_distance", f"SELECT nid, CAST(round_even(sqrt(((lat - 41.2::DOUBLE) * 111111.0) * ((lat - 41.2::DOUBLE) * 111111.0) + ((lon + 70.9::DOUBLE) * 111111.0 * cos(radians(lat))) * ((lon + 70.9::DOUBLE) * 111111.0 * cos(radians(lat)))) * 100, 0) AS BIGINT) AS cm FROM {DEGSQL}")
def _(spark, sf):
    d = geo.planar_gps_m(F.col("lat"), F.col("lon"), F.lit(41.2), F.lit(-70.9))
    return _deg(spark, sf).select("nid", F.rint(d * 100).cast("long").alias("cm"))


@query("p10_utm_zone", "SELECT k, CAST(CASE WHEN miny * 20 - 50 >= 0 THEN 32600 ELSE 32700 END + least(60, CAST(floor((minx * 80 - 180 + 180) / 6) AS INTEGER) + 1) AS INTEGER) AS epsg FROM fx_manifest")
def _(spark, sf):
    return fx.manifest(spark, sf).select("k", geo.utm_epsg(F.col("minx") * 80 - 180, F.col("miny") * 20 - 50).cast("int").alias("epsg"))


@query("p12_edge_key", "SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_suppkey <> l_partkey")
def _(spark, sf):
    return graph.canonical(fx.table(spark, sf, "lineitem"), "l_suppkey", "l_partkey").selectExpr("u AS a", "v AS b")


@query("p13_clamp", "SELECT c_custkey, least(1.0, greatest(0.0, c_acctbal / 5000)) AS v FROM customer")
def _(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", geo.clamp01(F.col("c_acctbal") / 5000).alias("v"))


@query("p14_edge_vectors", "SELECT e.u, e.v, b.x - a.x AS dx, b.y - a.y AS dy FROM fx_edge e JOIN fx_node a ON a.nid = e.u JOIN fx_node b ON b.nid = e.v UNION ALL SELECT e.v, e.u, a.x - b.x, a.y - b.y FROM fx_edge e JOIN fx_node a ON a.nid = e.u JOIN fx_node b ON b.nid = e.v")
def _(spark, sf):
    return labels.edge_vectors(graph.both_ways(fx.edges(spark, sf).select("u", "v")), fx.nodes(spark, sf))


@query("p15_patch_rotation", "SELECT nid, CASE nid % 4 WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 12000 - x ELSE 12000 - y END AS rx, CASE WHEN nid % 3 = 0 THEN 12000 - (CASE nid % 4 WHEN 0 THEN y WHEN 1 THEN 12000 - x WHEN 2 THEN 12000 - y ELSE x END) - 1 ELSE CASE nid % 4 WHEN 0 THEN y WHEN 1 THEN 12000 - x WHEN 2 THEN 12000 - y ELSE x END END AS ry FROM fx_node")
def _(spark, sf):
    x, y = geo.rotate_patch(F.col("x"), F.col("y"), F.lit(12000), F.col("nid") % 4, F.lit(False), F.col("nid") % 3 == 0)
    return fx.nodes(spark, sf).select("nid", x.alias("rx"), y.alias("ry"))


@query("p16_foreground", "SELECT tile, count(*) FILTER (WHERE greatest(v, (v * 7) % 256, (v * 3) % 256) > 0) AS nonzero, count(*) FILTER (WHERE greatest(v, (v * 7) % 256, (v * 3) % 256) > 127.5) AS above, count(*) FILTER (WHERE greatest(v, (v * 7) % 256, (v * 3) % 256) < 127.5) AS below FROM fx_pixel GROUP BY tile")
def _(spark, sf):
    r, g, b = F.col("v"), F.col("v") * 7 % 256, F.col("v") * 3 % 256
    on = lambda t, inv=False: F.count_if(geo.foreground(r, g, b, t, inv))
    return fx.pixels(spark, sf).groupBy("tile").agg(on(None).alias("nonzero"), on(127.5).alias("above"), on(127.5, True).alias("below"))


CLASSES = ("v AS c0", "(v * 7) % 256 AS c1", "(v * 11) % 256 AS c2", "greatest((v * 3) % 256, (v * 5) % 256) AS c3")


@query("p17_crossing_class", "SELECT r, c, tile, patch, v, greatest((v * 3) % 256, (v * 5) % 256) AS crossing FROM fx_pixel")
def _(spark, sf):
    return fx.pixels(spark, sf).select("r", "c", "tile", "patch", "v", F.greatest(F.col("v") * 3 % 256, F.col("v") * 5 % 256).alias("crossing"))


@query("p18_class_argmax", f"SELECT class, count(*) AS n FROM (SELECT CASE WHEN c0 >= c1 AND c0 >= c2 AND c0 >= c3 THEN 0 WHEN c1 >= c2 AND c1 >= c3 THEN 1 WHEN c2 >= c3 THEN 2 ELSE 3 END AS class FROM (SELECT {', '.join(CLASSES)} FROM fx_pixel)) GROUP BY class")
def _(spark, sf):
    px = fx.pixels(spark, sf).selectExpr(*CLASSES)
    return px.groupBy(geo.first_max(F.array("c0", "c1", "c2", "c3")).alias("class")).agg(F.count("*").alias("n"))


@query("p19_probability_byte", "SELECT id, CAST(trunc(p / 1000 * 255) AS INTEGER) AS b FROM fx_prediction")
def _(spark, sf):
    return fx.predictions(spark, sf).select("id", geo.to_byte(F.col("p") / 1000).alias("b"))


@query("p20_round_points", "SELECT nid, CAST(round_even(x / 2, 0) AS BIGINT) AS x, CAST(round_even(y / 2, 0) AS BIGINT) AS y FROM fx_node")
def _(spark, sf):
    return fx.nodes(spark, sf).select("nid", F.rint(F.col("x") / 2).cast("long").alias("x"), F.rint(F.col("y") / 2).cast("long").alias("y"))


@query("p21_expand_ids", "SELECT DISTINCT tile FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN [n_nationkey::BIGINT] ELSE range(n_nationkey::BIGINT, n_nationkey + 4) END AS t FROM nation) , unnest(t) AS x(tile)")
def _(spark, sf):
    k = F.col("k")
    return files.expand_ids(fx.manifest(spark, sf).select(F.when(k % 2 == 0, k.cast("string")).otherwise(F.format_string("%d-%d", k + 3, k)).alias("spec")))


@query("p22_location_name", "SELECT n_nationkey, lower(trim('  ' || n_name || ' ')) AS name, CASE WHEN lower(n_name) IN ('france', 'germany') THEN 'europe' ELSE 'other' END AS root FROM nation")
def _(spark, sf):
    name = F.lower(F.trim(F.concat(F.lit("  "), F.col("n_name"), F.lit(" "))))
    return fx.table(spark, sf, "nation").select("n_nationkey", name.alias("name"), F.when(name.isin("france", "germany"), "europe").otherwise("other").alias("root"))


@query("p23_normalise", f"SELECT tile, r, c, patch, v, {m('(v / 255.0::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE')} AS n FROM fx_pixel")
def _(spark, sf):
    return fx.pixels(spark, sf).select("tile", "r", "c", "patch", "v", micro(geo.normalise(F.col("v"), 0.485, 0.229)).alias("n"))


@query("p24_sinusoid", f"SELECT nid, {m('sin(x / 10007.0::DOUBLE)')} AS s0, {m('cos(x / 10007.0::DOUBLE * ' + repr(10000 ** (-2 / 8)) + ')')} AS c1 FROM fx_node")
def _(spark, sf):
    e = geo.sinusoid(F.col("x") / 10007.0, 8)
    return fx.nodes(spark, sf).select("nid", micro(F.get(e, F.lit(0))).alias("s0"), micro(F.get(e, F.lit(5))).alias("c1"))


from waygraph.plans import catalog_more  # noqa: E402,F401  the rest of the queries
