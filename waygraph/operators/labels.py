"""Candidate graphs and their training labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.operators.graph import both_ways, degree, hops
from waygraph.operators.spatial import knn_join, near_any, nearest_join
from waygraph.plans.storage import dealt, stored


def with_ends(edges: DataFrame, nodes: DataFrame, id_: str = "nid") -> DataFrame:
    """Edges with their ends' places x1, y1, x2, y2."""
    a = nodes.select(F.col(id_).alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col(id_).alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.join(dealt(a), "u").join(dealt(b), "v").select(*edges.columns, "x1", "y1", "x2", "y2")


def edge_vectors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, dx, dy); a reversed edge has the negated vector."""
    return with_ends(edges.select("u", "v"), nodes).selectExpr("u", "v", "x2 - x1 AS dx", "y2 - y1 AS dy")


def candidate_graph(points: DataFrame, radius, k: int, by=()) -> DataFrame:
    """Both directions of the candidate edges, with vectors."""
    pairs = knn_join(points, radius, k, "nid", by)
    return edge_vectors(both_ways(pairs.select("u", "v")), points)


def label_pairs(pairs: DataFrame, truth: DataFrame, depth: int = 1) -> DataFrame:
    """pairs (u, v) with label 1 where the truth graph joins them within ``depth`` edges.

    Both ends go half of the way and meet in the middle: the rows are those of half the depth.
    """
    pairs, truth = stored(pairs.select("u", "v"), "pairs"), stored(truth.select("u", "v"), "truth")
    reach = lambda c, d: hops(truth, pairs.select(F.col(c).alias("source")).distinct(), d).select(F.col("source").alias(c), F.col("n").alias("_n"))
    apart = pairs.where("u <> v").distinct()
    if depth < 2:
        met = apart.join(dealt(reach("u", depth).withColumnRenamed("_n", "v")), ["u", "v"])
    else:
        met = apart.join(dealt(reach("u", depth - depth // 2)), "u").join(dealt(reach("v", depth // 2)), ["v", "_n"], "left_semi")
    return pairs.join(dealt(met.select("u", "v", F.lit(1).alias("hit")).distinct()), ["u", "v"], "left").select("u", "v", F.coalesce("hit", F.lit(0)).alias("label"))


def snapped_labels(points: DataFrame, pairs: DataFrame, truth_nodes: DataFrame, truth: DataFrame, radius, depth: int) -> DataFrame:
    """pairs of free points, labelled through the truth vertices that they snap to."""
    left = points.select(F.col("nid").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    right = truth_nodes.select(F.col("nid").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by_"))
    snap = nearest_join(left, right, radius).select("a", "b")
    both = pairs.join(dealt(snap.selectExpr("a AS u", "b AS gu")), "u").join(dealt(snap.selectExpr("a AS v", "b AS gv")), "v")
    both = stored(both.select("u", "v", "gu", "gv"), "snapped")
    want = both.where("gu IS NOT NULL AND gv IS NOT NULL AND gu <> gv").select(F.col("gu").alias("u"), F.col("gv").alias("v")).distinct()
    hit = label_pairs(want, truth, depth).selectExpr("u AS gu", "v AS gv", "label")
    return both.join(dealt(hit), ["gu", "gv"], "left").select("u", "v", F.coalesce("label", F.lit(0)).alias("label"))


def interest(nodes: DataFrame, edges: DataFrame, trees: DataFrame, radius) -> DataFrame:
    """(nid, tenths, always): sampling weight 9 or 1 tenths, and whether NMS must keep the vertex.

    Of interest: vertices near one of degree other than 2, or near a tree (trees: b, bx, by_).
    """
    side = nodes.select(F.col("nid").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    deg = nodes.join(dealt(degree(edges).withColumnRenamed("n", "nid")), "nid", "left").withColumn("odd", F.coalesce("degree", F.lit(0)) != 2)
    treed = near_any(side, trees, radius).select("a").withColumn("t", F.lit(True))
    ends = deg.where("odd").select(F.col("nid").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by_"))
    near = near_any(side, ends, radius).select("a").withColumn("i", F.lit(True))
    out = deg.join(dealt(treed.withColumnRenamed("a", "nid")), "nid", "left").join(dealt(near.withColumnRenamed("a", "nid")), "nid", "left")
    on = F.coalesce("i", F.lit(False)) | F.coalesce("t", F.lit(False))
    return out.select("nid", F.when(on, 9).otherwise(1).alias("tenths"), (F.col("odd") | F.coalesce("t", F.lit(False))).alias("always"))


def split(ids: DataFrame, seed: int = 0, shares: tuple[int, int, int] = (80, 10, 10)) -> DataFrame:
    """ids with part (train, val, test) by an arithmetic hash of the id; no task sees all."""
    h = F.pmod(F.col("id") * 7919 + seed, F.lit(100))
    return ids.select("id", F.when(h < shares[0], "train").when(h < shares[0] + shares[1], "val").otherwise("test").alias("part"))
