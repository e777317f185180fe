"""Relations of the spatial-graph model derived from the star-schema tables.

Integer arithmetic only, so that every engine gets equal values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SNAP, BRIDGE, THRESHOLD = 10, 250, 600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, x, y from part: 20,000 places to four tiles, then the next four tiles, so that density does not grow with the table."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "(p_partkey * 7919) % 10007 + (p_partkey - 1) div 20000 * 10008 AS x", "(p_partkey * 104729 + p_size * 37) % 10007 AS y")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nid, tile, x, y: places from part; those near a tile's edge are seen twice."""
    base = places(spark, sf_dir)
    own = base.selectExpr("k", "x div 2502 AS tile", "x", "y")
    again = base.where("x % 2502 >= 2482 AND x % 10008 < 7506").selectExpr("k", "x div 2502 + 1 AS tile", "x + 3 AS x", "y - 2 AS y")
    return own.unionByName(again).selectExpr("k * 10 + tile % 4 AS nid", "tile", "x", "y")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, u, v, s (score in thousandths), t (type): near pairs within a tile."""
    from waygraph.operators.spatial import radius_join

    pairs = radius_join(nodes(spark, sf_dir), BRIDGE, "nid", ["tile"])
    return pairs.selectExpr("tile", "a AS u", "b AS v", "(a * 31 + b * 17) % 1001 AS s", "cast((a + b) % 5 = 0 AS int) AS t")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patch, u, v, s, mix: an edge as several patches and two passes have scored it."""
    return (
        table(spark, sf_dir, "lineitem")
        .selectExpr("l_linenumber AS patch", "least(l_suppkey, l_partkey % 100) AS u", "greatest(l_suppkey, l_partkey % 100) AS v", "cast(round(l_extendedprice * 100) AS bigint) % 1001 AS s", "cast(l_returnflag = 'R' AS int) AS mix")
        .where("u <> v")
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile_id, image_path and bounds of a five by five grid of degrees."""
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS k",
        "printf('tile_%05d', n_nationkey) AS tile_id",
        "concat(n_name, '.png') AS image_path",
        "cast(n_nationkey % 5 AS double) AS minx",
        "cast(n_nationkey div 5 AS double) AS miny",
        "cast(n_nationkey % 5 + 1 AS double) AS maxx",
        "cast(n_nationkey div 5 + 1 AS double) AS maxy",
    )


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, seq, x, y: a vertex for each turn of a conversation."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().selectExpr("conv_id AS line", "turn AS seq", "(conv_id * 13 + turn * 17) % 211 AS x", "(conv_id * 7 + turn * turn * 5) % 197 AS y")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, p (thousandths), y: a scored target."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").selectExpr("doc_id AS id", "n_chars % 1001 AS p", "quality AS y", "toxic AS z")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, patch, r, c, v: overlapping patches' pixel values."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey % 3 AS tile", "o_custkey % 4 AS patch", "(o_orderkey div 96) % 64 AS r", "o_orderkey % 48 AS c", "cast(round(o_totalprice * 100) AS bigint) % 256 AS v")


#: The same relations as SQL; a query names those it needs.
SQL = {
    "fx_place": "SELECT p_partkey AS k, (p_partkey * 7919) % 10007 + (p_partkey - 1) // 20000 * 10008 AS x, (p_partkey * 104729 + p_size * 37) % 10007 AS y FROM part",
    "fx_node": "SELECT k * 10 + tile % 4 AS nid, tile, x, y FROM (SELECT k, x // 2502 AS tile, x, y FROM fx_place UNION ALL SELECT k, x // 2502 + 1, x + 3, y - 2 FROM fx_place WHERE x % 2502 >= 2482 AND x % 10008 < 7506)",
    "fx_edge": "SELECT a.tile, a.nid AS u, b.nid AS v, (a.nid * 31 + b.nid * 17) % 1001 AS s, CAST((a.nid + b.nid) % 5 = 0 AS INTEGER) AS t FROM fx_node a JOIN fx_node b ON a.tile = b.tile AND a.nid < b.nid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 62500",
    "fx_observation": "SELECT * FROM (SELECT l_linenumber AS patch, least(l_suppkey, l_partkey % 100) AS u, greatest(l_suppkey, l_partkey % 100) AS v, CAST(round(l_extendedprice * 100) AS BIGINT) % 1001 AS s, CAST(l_returnflag = 'R' AS INTEGER) AS mix FROM lineitem) WHERE u <> v",
    "fx_manifest": "SELECT n_nationkey AS k, printf('tile_%05d', n_nationkey) AS tile_id, n_name || '.png' AS image_path, CAST(n_nationkey % 5 AS DOUBLE) AS minx, CAST(n_nationkey // 5 AS DOUBLE) AS miny, CAST(n_nationkey % 5 + 1 AS DOUBLE) AS maxx, CAST(n_nationkey // 5 + 1 AS DOUBLE) AS maxy FROM nation",
    "fx_polyline": "SELECT conv_id AS line, turn AS seq, (conv_id * 13 + turn * 17) % 211 AS x, (conv_id * 7 + turn * turn * 5) % 197 AS y FROM (SELECT DISTINCT conv_id, turn FROM conversations)",
    "fx_prediction": "SELECT doc_id AS id, n_chars % 1001 AS p, quality AS y, toxic AS z FROM labels JOIN documents USING (doc_id)",
    "fx_pixel": "SELECT o_orderkey % 3 AS tile, o_custkey % 4 AS patch, (o_orderkey // 96) % 64 AS r, o_orderkey % 48 AS c, CAST(round(o_totalprice * 100) AS BIGINT) % 256 AS v FROM orders",
    # clusters of nodes within the snap distance, by least member
    "fx_near": "SELECT a.nid AS a, b.nid AS b FROM fx_node a JOIN fx_node b ON a.nid <> b.nid AND abs(a.x - b.x) <= 10 AND abs(a.y - b.y) <= 10 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100",
    "fx_reach(a, b)": "SELECT nid, nid FROM fx_node UNION SELECT r.a, n.b FROM fx_reach r JOIN fx_near n ON r.b = n.a",
    "fx_cluster": "SELECT a AS nid, min(b) AS cid FROM fx_reach GROUP BY a",
    "fx_center": "SELECT cid, avg(x) AS x, avg(y) AS y, list_sort(list(DISTINCT tile)) AS tiles FROM fx_cluster JOIN fx_node USING (nid) GROUP BY cid",
    "fx_joined": "SELECT u, v, s, t FROM (SELECT least(a.cid, b.cid) AS u, greatest(a.cid, b.cid) AS v, s, t, row_number() OVER (PARTITION BY least(a.cid, b.cid), greatest(a.cid, b.cid) ORDER BY s DESC, t DESC) AS rn FROM fx_edge e JOIN fx_cluster a ON e.u = a.nid JOIN fx_cluster b ON e.v = b.nid WHERE a.cid <> b.cid) WHERE rn = 1",
    "fx_kept": "SELECT * FROM fx_joined WHERE s >= 600",
    "fx_vote": "SELECT n, sum(CASE WHEN t = 0 THEN s ELSE 0 END) AS v0, sum(CASE WHEN t = 1 THEN s ELSE 0 END) AS v1 FROM (SELECT u AS n, s, t FROM fx_kept UNION ALL SELECT v, s, t FROM fx_kept) GROUP BY n",
    "fx_bridge": """SELECT a.cid AS u, b.cid AS v, CAST(NULL AS BIGINT) AS s, CAST(va.v1 + vb.v1 > va.v0 + vb.v0 AS INTEGER) AS t
        FROM fx_center a JOIN fx_center b ON a.cid < b.cid AND abs(a.x - b.x) <= 250 AND abs(a.y - b.y) <= 250
        JOIN fx_vote va ON va.n = a.cid JOIN fx_vote vb ON vb.n = b.cid
        WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) > 100 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 62500
        AND NOT list_has_any(a.tiles, b.tiles) AND NOT EXISTS (SELECT 1 FROM fx_kept k WHERE k.u = a.cid AND k.v = b.cid)""",
    "fx_merged": "SELECT u, v, s, t, 0 AS synthetic FROM fx_kept UNION ALL SELECT u, v, s, t, 1 FROM fx_bridge",
}


def with_relations(body: str) -> str:
    """``body`` behind the definitions of every fx_ relation that it uses, directly or not."""
    import re

    by = {k.split("(")[0]: k for k in SQL}
    need: list[str] = []

    def visit(text: str, me: str | None = None) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_\w+", text)):
            if name != me and name in by and by[name] not in need:
                visit(SQL[by[name]], name)
                need.append(by[name])

    visit(body)
    if not need:
        return body
    own = body.strip()
    rest = own[len("WITH RECURSIVE ") :] if own.startswith("WITH RECURSIVE ") else own[len("WITH ") :]
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({SQL[k]})" for k in need) + (", " + rest if own.startswith("WITH ") else " " + body)
