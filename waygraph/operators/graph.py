"""Graph operators on relational node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygraph.plans.storage import dealt, stored


def canonical(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Distinct undirected edges with u < v; loops and nulls go."""
    a, b = F.col(u), F.col(v)
    return edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 64) -> DataFrame:
    """(id, component) for every node of an edge; the component's label is its least id.

    Alternating large-star and small-star steps (Kiveris et al., SoCC 2014): each step
    replaces edges and never adds many, a node's neighbours are only aggregated (min),
    and each round's edges are written to the shared folder. It stops when a round
    changes nothing.
    """
    e = stored(canonical(edges, u, v).select(F.col("v").alias("u"), F.col("u").alias("v")), "edges")  # u > v from here on
    mark = lambda t: t.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    last = mark(e)
    for _ in range(rounds):
        if last[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # large star: every greater neighbour of k points to the least of k's neighbourhood
        large = both.join(dealt(least, 2 * last[0]), F.col("u") == F.col("k")).where(F.col("v") > F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: k and its lesser neighbours point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(dealt(low, last[0]), F.col("u") == F.col("k")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components are not done after {rounds} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def both_ways(edges: DataFrame) -> DataFrame:
    """The directed view: each edge in both directions (other columns stay)."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select("u", "v", *rest).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *rest))


def degree(edges: DataFrame) -> DataFrame:
    """(n, degree); a loop counts once."""
    ends = F.when(F.col("u") == F.col("v"), F.array("u")).otherwise(F.array("u", "v"))
    return edges.select(F.explode(ends).alias("n")).groupBy("n").agg(F.count("*").alias("degree"))


def dense_ids(nodes: DataFrame, id_: str) -> DataFrame:
    """``nodes`` with new, an id from 0 without gaps in the order of ``id_``.

    Counts by range partition give each partition's first id, so that no task sees all.
    """
    parts = nodes.select(id_).distinct().repartitionByRange(id_).sortWithinPartitions(id_).withColumn("_p", F.spark_partition_id())
    parts = stored(parts, "ids")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_at", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_at")  # a row a partition
    ranked = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(id_)))
    return ranked.join(F.broadcast(starts), "_p").select(id_, (F.col("_at") + F.col("_r") - 1).alias("new"))


def hops(edges: DataFrame, start: DataFrame, depth: int, stop: DataFrame | None = None) -> DataFrame:
    """(source, n, hop): nodes within ``depth`` edges of each source, at their least hop.

    ``start`` has source; a node of ``stop`` (column n) is reached but not gone on from.
    """
    two = both_ways(edges.select("u", "v")).withColumnRenamed("u", "n")
    edge = start.select("source", F.col("source").alias("n")).distinct()
    seen = edge.withColumn("hop", F.lit(0))
    for d in range(1, depth + 1):  # each level is stored, and only its new nodes are gone on from
        on = edge if stop is None else edge.join(dealt(stop), "n", "left_anti")
        step = on.join(dealt(two), "n").select("source", F.col("v").alias("n")).distinct()
        edge = stored(step.join(dealt(seen), ["source", "n"], "left_anti"), "hops")
        seen = seen.unionByName(edge.withColumn("hop", F.lit(d)))
    return seen


def large_components(edges: DataFrame, least: int = 3) -> DataFrame:
    """Edges of components with at least ``least`` edges."""
    label = connected_components(edges).select(F.col("id").alias("u"), "component")
    own = edges.join(dealt(label), "u")
    big = own.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("component")
    return own.join(dealt(big), "component", "left_semi").select(*edges.columns)


def _length() -> Column:
    return F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))


def cut_edges(edges: DataFrame, pieces: Column) -> DataFrame:
    """(u, v, piece, x, y): the ends of equal pieces of edges (x1, y1, x2, y2)."""
    cut = edges.withColumn("_n", F.greatest(F.lit(1), pieces.cast("int"))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    t = F.col("piece") / F.col("_n")
    return cut.select("u", "v", "piece", (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"))


def split_edges(edges: DataFrame, spacing: float) -> DataFrame:
    """Edges cut in equal pieces of at most ``spacing``."""
    return cut_edges(edges, F.ceil(_length() / F.lit(float(spacing))))


def split_long_edges(edges: DataFrame, over: float, step: float) -> DataFrame:
    """Edges longer than ``over`` cut in one piece more than ``step`` goes into them."""
    return cut_edges(edges, F.when(_length() > over, F.floor(_length() / F.lit(float(step))) + 1).otherwise(1))


def distinct_places(points: DataFrame, digits: int = 6) -> DataFrame:
    """(kx, ky): places of points told apart to ``digits`` decimals, as whole numbers."""
    key = lambda c: F.rint(F.col(c) * 10**digits).cast("long")
    return points.select(key("x").alias("kx"), key("y").alias("ky")).distinct()


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place from 0 in an order that leaves no ties, without a task that sees all.

    Ranges go to partitions; what the earlier partitions hold is added to the place inside.
    """
    parts = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranks")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_at"))  # a row a partition
    inside = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return inside.join(starts, "_p").select(*rows.columns, (F.col("_at") + F.col("_r") - 1).alias(name))
