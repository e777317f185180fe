"""Merging tile graphs into one: snap, deduplicate, threshold, bridge, collapse junctions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.operators.graph import connected_components, degree
from waygraph.operators.spatial import radius_join
from waygraph.plans.storage import dealt, stored


def snap_clusters(nodes: DataFrame, radius, id_: str = "nid") -> DataFrame:
    """(nid, cid): nodes within the radius of one another, chains included; cid: least member."""
    found = connected_components(radius_join(nodes, radius, id_), "a", "b")
    return nodes.select(F.col(id_).alias("nid")).join(dealt(found.withColumnRenamed("id", "nid")), "nid", "left").select("nid", F.coalesce("component", "nid").alias("cid"))


def centers(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cid, x, y, tiles): unweighted mean of a cluster's members, and the tiles that they come from."""
    return nodes.join(dealt(clusters), "nid").groupBy("cid").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.array_sort(F.collect_set("tile")).alias("tiles"))


def remap(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges between clusters, canonical, without loops; other columns stay."""
    a = clusters.select(F.col("nid").alias("u"), F.col("cid").alias("_a"))
    b = clusters.select(F.col("nid").alias("v"), F.col("cid").alias("_b"))
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.join(dealt(a), "u").join(dealt(b), "v").where("_a <> _b").select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v"), *rest)


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge a pair: real before synthetic, then the higher score, then the higher type.

    A maximum of structs, so it is aggregated before the shuffle.
    """
    best = edges.groupBy("u", "v").agg(F.max(F.struct((1 - F.col("synthetic")).alias("r"), F.coalesce("s", F.lit(-1)).alias("s"), "t")).alias("m"))
    return best.select("u", "v", F.when(F.col("m.r") == 1, F.col("m.s")).alias("s"), F.col("m.t").alias("t"), (1 - F.col("m.r")).alias("synthetic"))


def votes(edges: DataFrame) -> DataFrame:
    """(n, v0, v1): each node's incident confidence by edge type."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("n"), "s", "t")
    return ends.groupBy("n").agg(F.sum(F.when(F.col("t") == 0, F.col("s")).otherwise(0)).alias("v0"), F.sum(F.when(F.col("t") == 1, F.col("s")).otherwise(0)).alias("v1"))


def bridges(kept: DataFrame, center: DataFrame, snap, reach) -> DataFrame:
    """Synthetic edges across seams: near clusters that share no tile and no edge, both with edges."""
    vote = votes(kept)
    ends = center.join(dealt(vote.withColumnRenamed("n", "cid")), "cid")
    near = radius_join(ends, reach, "cid").where(F.col("d2") > snap * snap).select(F.col("a").alias("u"), F.col("b").alias("v")).join(dealt(kept.select("u", "v")), ["u", "v"], "left_anti")
    side = lambda k, p: ends.select(F.col("cid").alias(k), F.col("tiles").alias(f"{p}t"), F.col("v0").alias(f"{p}0"), F.col("v1").alias(f"{p}1"))
    both = near.join(dealt(side("u", "a")), "u").join(dealt(side("v", "b")), "v").where(~F.arrays_overlap("at", "bt"))
    return both.select("u", "v", F.lit(None).cast("long").alias("s"), (F.col("a1") + F.col("b1") > F.col("a0") + F.col("b0")).cast("int").alias("t"), F.lit(1).alias("synthetic"))


def global_merge(nodes: DataFrame, edges: DataFrame, snap, reach, threshold) -> tuple[DataFrame, DataFrame]:
    """(centers, edges u, v, s, t, synthetic) of the merged network."""
    clusters = stored(snap_clusters(nodes, snap), "clusters")
    center = centers(nodes, clusters)
    joined = dedup_edges(remap(edges.withColumn("synthetic", F.lit(0)).select("u", "v", "s", "t", "synthetic"), clusters))
    kept = stored(joined.where((F.col("synthetic") == 0) & (F.col("s") >= threshold)), "kept")
    return center, kept.unionByName(bridges(kept, center, snap, reach))


def collapse_junctions(nodes: DataFrame, edges: DataFrame, radius) -> tuple[DataFrame, DataFrame]:
    """The snap once more, for nodes of degree 3 and up only; nodes (nid, x, y)."""
    high = nodes.join(dealt(degree(edges).where("degree >= 3").select(F.col("n").alias("nid"))), "nid", "left_semi")
    found = snap_clusters(high, radius)
    clusters = stored(nodes.select("nid").join(dealt(found), "nid", "left").select("nid", F.coalesce("cid", "nid").alias("cid")), "junctions")
    center = nodes.join(dealt(clusters), "nid").groupBy("cid").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return center, dedup_edges(remap(edges, clusters))


def concat_shapes(parts: list[DataFrame], shape: str = "shape") -> DataFrame:
    """Rows of all parts, one of each shape."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col(shape).isNotNull()).dropDuplicates([shape])
