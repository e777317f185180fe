"""Per-tile steps: pruning, checks, metrics, and grouped path work."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygraph.operators import routing as R
from waygraph.plans.storage import dealt


def keep_core(nodes: DataFrame, edges: DataFrame, core: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes in the core or on an edge with one that is; edges whose ends both stay."""
    inside = nodes.where(core).select("nid")
    a = edges.join(dealt(inside.withColumnRenamed("nid", "u")), "u", "left_semi")
    b = edges.join(dealt(inside.withColumnRenamed("nid", "v")), "v", "left_semi")
    kept = a.select(*edges.columns).unionByName(b.select(*edges.columns)).dropDuplicates(["u", "v"])
    ends = kept.select(F.explode(F.array("u", "v")).alias("nid")).unionByName(inside).distinct()
    return nodes.join(dealt(ends), "nid", "left_semi"), kept


def drop_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("u", "v")).alias("nid")).distinct()
    return nodes.join(dealt(ends), "nid", "left_semi")


def violations(edges: DataFrame) -> DataFrame:
    """Counts of edges that break the table's rules, in one row."""
    c = lambda e, n: F.count_if(F.expr(e)).alias(n)
    return edges.agg(c("t NOT IN (0, 1)", "bad_type"), c("synthetic = 0 AND s IS NULL", "no_score"), c("synthetic = 1 AND s IS NOT NULL", "false_score"), c("u >= v", "order_"))


def choose(rows: DataFrame, include: list[int], exclude: list[int]) -> DataFrame:
    """Rows of included ids without excluded ones; an error if that leaves no id."""
    left = sorted(set(include) - set(exclude))
    if not left:
        raise ValueError("no tile is left")
    return rows.where(F.col("k").isin(left))


def in_bounds(nodes: DataFrame, size: float, margin: float) -> DataFrame:
    ok = lambda c: (F.col(c) > margin) & (F.col(c) < size - margin)
    return nodes.where(ok("x") & ok("y"))


def iou(pairs: DataFrame) -> DataFrame:
    """(class, iou) from predicted p and true g, by the confusion counts."""
    conf = pairs.groupBy("p", "g").agg(F.count("*").alias("n"))
    each = conf.select(F.explode(F.array_distinct(F.array("p", "g"))).alias("class"), "p", "g", "n")
    return each.groupBy("class").agg((F.sum(F.when(F.col("p") == F.col("g"), F.col("n")).otherwise(0)) / F.sum("n")).alias("iou"))


def curve(rows: DataFrame, steps: int) -> DataFrame:
    """(t, precision_, recall) at thresholds t / steps of p in thousandths; from counts by score."""
    scale = 1000 // steps
    by = rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("tp"))  # at most 1001 rows
    at = by.withColumn("t", F.explode(F.sequence(F.lit(0), F.least(F.lit(steps - 1), F.floor(F.col("p") / scale).cast("int"))))).groupBy("t").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"))
    every = rows.sparkSession.range(steps).select(F.col("id").alias("t")).crossJoin(F.broadcast(by.agg(F.sum("tp").alias("pos"))))
    return every.join(at, "t", "left").select("t", F.coalesce(F.try_divide("tp", "n"), F.lit(0.0)).alias("precision_"), F.coalesce(F.try_divide("tp", "pos"), F.lit(0.0)).alias("recall"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Sum over scores, from the top, of recall gained times precision so far."""
    w = Window.orderBy(F.col("p").desc())  # over the distinct scores, at most 1001 rows
    by = rows.groupBy("p").agg(F.count("*").alias("c"), F.sum("y").alias("k"))
    run = by.select(F.sum("c").over(w).alias("n"), F.sum("k").over(w).alias("tp"), "k", F.sum("k").over(Window.partitionBy()).alias("total"))
    return run.agg(F.sum(F.col("k") / F.col("total") * (F.col("tp") / F.col("n"))).alias("ap"))


def consecutive(lines: DataFrame) -> DataFrame:
    """Distinct (ax, ay, bx, by_) of neighbouring vertices (line, seq, x, y); equal ones don't count."""
    w = Window.partitionBy("line").orderBy("seq")
    p = lines.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by_"))
    return p.where("bx IS NOT NULL AND NOT (ax = bx AND ay = by_)").distinct()


def polyline_graph(lines: DataFrame, tolerance: int) -> DataFrame:
    """Edges between cells of ``tolerance``; of parallel ones the shorter (d2, squared)."""
    w = Window.partitionBy("line").orderBy("seq")
    p = lines.select("x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 IS NOT NULL")
    k = lambda a, b: F.struct(F.expr(f"{a} div {tolerance}").alias("x"), F.expr(f"{b} div {tolerance}").alias("y"))
    e = p.select(F.least(k("x", "y"), k("x2", "y2")).alias("a"), F.greatest(k("x", "y"), k("x2", "y2")).alias("b"), F.expr("(x - x2) * (x - x2) + (y - y2) * (y - y2)").alias("d2"))
    return e.where("a <> b").groupBy("a", "b").agg(F.min("d2").alias("d2")).select(F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by_"), "d2")


def canvas(segments: DataFrame, size: int, points: int = 10) -> DataFrame:
    """(i, j, n): points spread along segments, counted by cell."""
    t = F.col("k") / F.lit(points - 1)
    at = segments.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    cell = lambda c: F.floor((F.col(f"{c}1") + t * (F.col(f"{c}2") - F.col(f"{c}1"))) / size).cast("long")
    return at.groupBy(cell("x").alias("i"), cell("y").alias("j")).agg(F.count("*").alias("n"))


def weighted_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` draws with replacement (draw, id), in proportion to w: each draw takes the row of least -ln(u) / w."""
    digest = F.md5(F.concat_ws(":", "id", "draw", F.lit(seed)).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / F.lit(float((1 << 52) + 1))
    each = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("key", -F.ln(u) / F.col("w"))
    return each.groupBy("draw").agg(F.min_by("id", F.struct("key", "id")).alias("id"))


# ---- one graph a group ---------------------------------------------------------------


def _grouped(nodes: DataFrame, edges: DataFrame, step, schema: str) -> DataFrame:
    n = nodes.selectExpr("graph_id", "id AS a", "cast(null AS bigint) AS b", "x AS p", "y AS q")
    e = edges.selectExpr("graph_id", "u AS a", "v AS b", "length AS p", "cast(null AS double) AS q")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        es, ns = pdf[pdf.b.notna()], pdf[pdf.b.isna()]
        adj = R.adjacency(zip(es.a.astype(int), es.b.astype(int), es.p, strict=True))
        xy = {int(i): (x, y) for i, x, y in sorted(zip(ns.a, ns.p, ns.q, strict=True))}
        return pd.DataFrame([(int(pdf.graph_id.iloc[0]), *r) for r in step(adj, xy)], columns=names)

    return n.unionByName(e).groupBy("graph_id").applyInPandas(run, schema)


def bridge_edges(edges: DataFrame) -> DataFrame:
    """Edges (graph_id, u, v) whose removal disconnects their graph."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adj = R.adjacency((int(u), int(v), 1.0) for u, v in zip(pdf.u, pdf.v, strict=True))
        return pd.DataFrame([(int(pdf.graph_id.iloc[0]), u, v) for u, v in R.bridges(adj)], columns=["graph_id", "u", "v"])

    return edges.groupBy("graph_id").applyInPandas(run, "graph_id long, u long, v long")


def chain_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    def step(adj, xy):
        lines, loops = R.chains(adj)
        for i, (path, closed) in enumerate([*((p, False) for p in lines), *((p, True) for p in loops)]):
            yield i, closed, path

    return _grouped(nodes, edges, step, "graph_id long, chain int, closed boolean, nodes array<long>")


def resample_rows(nodes: DataFrame, edges: DataFrame, spacing: float) -> DataFrame:
    def step(adj, xy):
        lines, loops = R.chains(adj)
        for i, (path, closed) in enumerate([*((p, False) for p in lines), *((p, True) for p in loops)]):
            for j, (x, y) in enumerate(R.resample([xy[n] for n in path], spacing, closed)):
                yield i, j, x, y

    return _grouped(nodes, edges, step, "graph_id long, chain int, seq int, x long, y long")


def control_rows(nodes: DataFrame, edges: DataFrame, spacing: float, limit: int) -> DataFrame:
    def step(adj, xy):
        yield from enumerate(R.control_points(adj, xy, spacing, limit))

    return _grouped(nodes, edges, step, "graph_id long, place int, id long")


def spread_rows(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    def step(adj, xy):
        yield from enumerate(R.spread(sorted(xy), xy, limit))

    return _grouped(nodes, edges, step, "graph_id long, place int, id long")


def od_lengths(nodes: DataFrame, edges: DataFrame, spacing: float, limit: int) -> DataFrame:
    def step(adj, xy):
        points = R.control_points(adj, xy, spacing, limit)
        for i, s in enumerate(points):
            dist, _ = R.dijkstra(adj, s)
            yield from ((s, t, float(dist[t])) for t in points[i + 1 :] if t in dist)

    return _grouped(nodes, edges, step, "graph_id long, s long, t long, length double")


def diverse_rows(nodes: DataFrame, edges: DataFrame, k: int, theta: float, most: int) -> DataFrame:
    def step(adj, xy):
        ends = sorted(adj)
        if len(ends) > 1:
            for rank, (length, path) in enumerate(R.diverse(adj, ends[0], ends[-1], k, theta, most)):
                yield rank, float(length), path

    return _grouped(nodes, edges, step, "graph_id long, rank int, length double, nodes array<long>")


def line_distances(lines: DataFrame) -> DataFrame:
    """(line, hausdorff, frechet) of each line against its even vertices' line."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = [(float(x), float(y)) for x, y in pdf.sort_values("seq")[["x", "y"]].itertuples(index=False)]
        return pd.DataFrame([(int(pdf.line.iloc[0]), R.hausdorff(p, p[::2]), R.frechet(p, p[::2]))], columns=["line", "hausdorff", "frechet"])

    return lines.groupBy("line").applyInPandas(run, "line long, hausdorff double, frechet double")


def filled(given: Column, defaults: dict[str, str]) -> Column:
    """A config (map of strings) with the defaults of the keys that it lacks; empty values are kept."""
    own = F.coalesce(given, F.create_map().cast("map<string,string>"))
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)


def ground_truth(segments: DataFrame, boxes: DataFrame, size) -> DataFrame:
    """Parts of segments inside the union box of ``boxes`` (x0, y0, xe, ye)."""
    from waygraph.operators.spatial import clip

    union = boxes.agg(F.lit(0).alias("bid"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("xe").alias("xe"), F.max("ye").alias("ye"))
    return clip(segments, union, size)


def metric_pieces(lines: DataFrame, spacing: float) -> DataFrame:
    """(line, seq, piece, pieces, at, x, y): lines in degrees (line, seq, x, y), projected about their mean and densified.

    ``at`` names the place: a vertex's number along its line, plus the share of the way to the next.
    """
    from waygraph.functions import geo

    origin = lines.agg(F.avg("x").alias("lon0"), F.avg("y").alias("lat0"))  # one row
    x, y = geo.local_metres(F.col("x"), F.col("y"), F.col("lon0"), F.col("lat0"))
    p = lines.crossJoin(F.broadcast(origin)).select("line", "seq", x.alias("x"), y.alias("y"))
    w = Window.partitionBy("line").orderBy("seq")
    p = p.withColumn("i", F.row_number().over(w) - 1).withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where("x2 IS NOT NULL")
    d = F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))
    cut = p.withColumn("pieces", F.greatest(F.lit(1), F.ceil(d / spacing).cast("int"))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces"))))
    t = F.col("piece") / F.col("pieces")
    return cut.select("line", "seq", "piece", "pieces", (F.col("i") + t).alias("at"), (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"))
