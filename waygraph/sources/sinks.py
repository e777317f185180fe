"""Sinks: typed exports of graphs and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.plans.storage import dealt


def confidence_bin(score: Column, synthetic: Column) -> Column:
    return (
        F.when(synthetic, "synthetic")
        .when(score < 0.25, "very_low")
        .when(score < 0.50, "low")
        .when(score < 0.70, "med")
        .when(score < 0.85, "high")
        .otherwise("very_high")
    )


def edge_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A GeoJSON feature, as JSON, for each edge (u, v, score, edge_type, synthetic) of nodes (id, x, y)."""
    a = nodes.select(F.col("id").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("id").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    both = edges.join(dealt(a), "u").join(dealt(b), "v")
    kind = F.when(F.col("edge_type") == 1, "crossing").otherwise("sidewalk")
    props = F.struct(F.lit("edge").alias("type"), F.col("u").alias("src"), F.col("v").alias("dst"), kind.alias("link_type"), F.when(~F.col("synthetic"), F.col("score")).alias("confidence"), confidence_bin(F.col("score"), F.col("synthetic")).alias("confidence_bin"), "synthetic")
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array("x1", "y1"), F.array("x2", "y2")).alias("coordinates"))
    return both.select("u", "v", F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), props.alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Parquet tables by tile where there is one, and line-wise GeoJSON features."""
    for name, t in (("nodes", nodes), ("edges", edges)):
        w = t.write.mode("overwrite")
        (w.partitionBy("tile_id") if "tile_id" in t.columns else w).parquet(f"{path}/{name}")
    if {"u", "v", "score", "edge_type", "synthetic"} <= set(edges.columns) and {"id", "x", "y"} <= set(nodes.columns):
        edge_features(edges, nodes).select("feature").write.mode("overwrite").text(f"{path}/features")


def save_scores(rows: DataFrame, path: str) -> None:
    """Per-tile scores as CSV with a header and as JSON lines."""
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    rows.select(*[json_safe(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/json")


def json_safe(x: Column) -> Column:
    """Null in place of numbers that JSON has not."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def adjacency(edges: DataFrame) -> DataFrame:
    """(n, neighbours sorted) of undirected edges, as adjacency files hold them."""
    two = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return two.groupBy(F.col("u").alias("n")).agg(F.array_sort(F.collect_set("v")).alias("neighbours"))


def graph_edges_for_json(adjacent: DataFrame) -> DataFrame:
    """One edge for each unordered pair of adjacency rows (n, m); ends that have no row of their own go."""
    known = adjacent.select("n").distinct()
    pairs = adjacent.join(dealt(known.withColumnRenamed("n", "m")), "m", "left_semi").where("n <> m")
    return pairs.select(F.least("n", "m").alias("u"), F.greatest("n", "m").alias("v")).distinct()


def save_minimal(edges: DataFrame, path: str) -> None:
    """Edges by tile (tile_id) and nothing else, for bulk runs."""
    edges.write.mode("overwrite").partitionBy("tile_id").parquet(path)


def save_network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A network without tiles: Parquet, CSV of nodes and of edges, line-wise features, and a summary of counts as JSON."""
    save_graph(nodes, edges, path)
    nodes.write.mode("overwrite").option("header", True).csv(f"{path}/nodes_csv")
    edges.write.mode("overwrite").option("header", True).csv(f"{path}/edges_csv")
    counts = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each
    counts.write.mode("overwrite").json(f"{path}/summary")


def save_summary(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """CSV with a line for each tile that has edges: tile_id, nodes, edges."""
    n = nodes.groupBy("tile_id").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("tile_id").agg(F.count("*").alias("edges"))
    n.join(e, "tile_id").select("tile_id", "nodes", "edges").write.mode("overwrite").option("header", True).csv(path)
