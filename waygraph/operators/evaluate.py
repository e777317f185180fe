"""Scoring a predicted network against a reference: path length and geometry, and roll-ups."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.operators import routing as R


@dataclass(frozen=True)
class Metric:
    """What the path metric needs; checked when made."""

    k: int = 3
    theta: float = 0.6
    w_length: float = 0.5
    w_geometry: float = 0.5
    tau: float = 20.0
    geometry: str = "hausdorff"
    candidates: int = 30
    penalize_missing: bool = True
    spacing: float = 50.0
    points: int = 160
    pairs: int = 500
    min_path: float = 60.0
    max_path: float = 0.0
    tolerance: float = 4.0
    hops: int = 4
    seed: int = 0

    def __post_init__(self):
        if self.k < 1 or not 0 < self.theta <= 1 or self.tau <= 0 or self.spacing <= 0 or self.candidates < self.k or self.geometry not in ("hausdorff", "frechet") or abs(self.w_length + self.w_geometry - 1) > 1e-9:
            raise ValueError(f"not a metric: {self}")


def _clamp(x: float) -> float:
    return max(0.0, min(1.0, x))


def score_paths(gt: list, pred: list, xy_gt: dict, xy_pred: dict, m: Metric) -> tuple[float, float, float, float, list[tuple[float, float]]]:
    """Combined, length and geometry score of two ranked path lists, the first paths' length score, distances."""
    rows = []
    for (lg, pg), (lp, pp) in zip(gt, pred, strict=False):
        if lg <= 0:
            rows.append((0.0, 0.0, 0.0, math.inf))
            continue
        length = _clamp(1 - abs(lg - lp) / lg)
        d = getattr(R, m.geometry)([xy_gt[n] for n in pg], [xy_pred[n] for n in pp])
        shape = _clamp(1 - d / m.tau)
        rows.append((_clamp(m.w_length * length + m.w_geometry * shape), length, shape, d))
    if not gt or not pred:
        return 0.0, 0.0, 0.0, 0.0, []
    n = len(gt) if m.penalize_missing else len(rows)
    sums = [_clamp(sum(r[i] for r in rows) / n) for i in range(3)]
    return (*sums, _clamp(1 - abs(gt[0][0] - pred[0][0]) / gt[0][0]), [(r[3], r[0]) for r in rows])


def od_rows(gt: R.Adjacency, xy_gt: dict, pred: R.Adjacency, xy_pred: dict, m: Metric) -> list[dict]:
    """A row for each origin-destination pair of the reference's control points."""
    points = R.control_points(gt, xy_gt, m.spacing, m.points)
    to = R.match_points(points, xy_gt, pred, xy_pred, m.tolerance, m.hops)
    pairs = []
    for i, s in enumerate(points):
        dist, _ = R.dijkstra(gt, s)
        pairs += [(s, t, dist[t]) for t in points[i + 1 :] if t in dist and dist[t] >= m.min_path and (m.max_path <= 0 or dist[t] <= m.max_path)]
    if 0 < m.pairs < len(pairs):
        import hashlib

        rank = lambda p: hashlib.sha256(f"{m.seed}:{p[0]}:{p[1]}".encode()).digest()
        pairs = sorted(sorted(pairs, key=rank)[: m.pairs])
    out, trees = [], {}

    def paths(side: str, adj: R.Adjacency, a: int, b: int) -> list:
        if (side, b) not in trees:  # distances to b serve all pairs that end there
            trees[side, b] = R.dijkstra(adj, b)[0]
        return R.diverse(adj, a, b, m.k, m.theta, m.candidates, trees[side, b])

    for s, t, length in pairs:
        a, b = to[s], to[t]
        g = paths("gt", gt, s, t)
        p = paths("pred", pred, a, b) if a is not None and b is not None else []
        od, ln, ge, vanilla, _ = score_paths(g, p, xy_gt, xy_pred, m)
        out.append({"s": s, "t": t, "gt_length": float(length), "gt_paths": len(g), "pred_paths": len(p), "matched": a is not None and b is not None, "routable": bool(p), "od": od, "length": ln, "geometry": ge, "vanilla": vanilla})
    return out


OD = "graph_id long, direction string, s long, t long, gt_length double, gt_paths int, pred_paths int, matched boolean, routable boolean, od double, length double, geometry double, vanilla double"


def _both_graphs(nodes: DataFrame, edges: DataFrame, step, schema: str) -> DataFrame:
    """``step(adj_gt, xy_gt, adj_pred, xy_pred)`` for each graph_id; its rows without graph_id."""
    kind = lambda k, cols: F.struct(*[F.lit(None).cast(t).alias(c) if c not in cols else cols[c].cast(t).alias(c) for c, t in (("a", "long"), ("b", "long"), ("p", "double"), ("q", "double"))])
    n = nodes.select("graph_id", "side", F.lit("n").alias("kind"), kind("n", {"a": F.col("id"), "p": F.col("x"), "q": F.col("y")}).alias("r"))
    e = edges.select("graph_id", "side", F.lit("e").alias("kind"), kind("e", {"a": F.col("u"), "b": F.col("v"), "p": F.col("length")}).alias("r"))
    both = n.unionByName(e).select("graph_id", "side", "kind", "r.*")

    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        args = []
        for side in ("gt", "pred"):
            own = pdf[pdf.side == side]
            es, ns = own[own.kind == "e"], own[own.kind == "n"]
            args += [R.adjacency(zip(es.a.astype(int), es.b.astype(int), es.p, strict=True)), {int(i): (x, y) for i, x, y in sorted(zip(ns.a, ns.p, ns.q, strict=True))}]
        out = pd.DataFrame([{"graph_id": int(pdf.graph_id.iloc[0]), **r} for r in step(*args)], columns=names)
        return out.astype({"matched": "Int64"}) if "point" in names else out

    return both.groupBy("graph_id").applyInPandas(run, schema)


def evaluate_pairs(nodes: DataFrame, edges: DataFrame, metric: Metric, symmetric: bool = False) -> DataFrame:
    """OD rows of every graph_id. nodes: graph_id, side (gt/pred), id, x, y; edges: graph_id, side, u, v, length."""

    def step(gt, xy_gt, pred, xy_pred):
        rows = [{"direction": "forward", **r} for r in od_rows(gt, xy_gt, pred, xy_pred, metric)]
        return rows + ([{"direction": "reverse", **r} for r in od_rows(pred, xy_pred, gt, xy_gt, metric)] if symmetric else [])

    return _both_graphs(nodes, edges, step, OD)


def match_rows(nodes: DataFrame, edges: DataFrame, metric: Metric) -> DataFrame:
    """(graph_id, point, matched): the reference's control points and their nodes of the prediction, or null."""

    def step(gt, xy_gt, pred, xy_pred):
        points = R.control_points(gt, xy_gt, metric.spacing, metric.points)
        return [{"point": p, "matched": m} for p, m in R.match_points(points, xy_gt, pred, xy_pred, metric.tolerance, metric.hops).items()]

    return _both_graphs(nodes, edges, step, "graph_id long, point long, matched long").withColumn("matched", F.col("matched").cast("long"))


def mean_or_zero(x: Column, where: Column | None = None) -> Column:
    return F.coalesce(F.avg(x if where is None else F.when(where, x)), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def od_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Strict, matched and routable means, and coverage rates, for each group of OD rows."""
    out = []
    for name, c in (("combined", "od"), ("length", "length"), ("geometry", "geometry"), ("vanilla", "vanilla")):
        out += [mean_or_zero(F.col(c)).alias(f"{name}_strict"), mean_or_zero(F.col(c), F.col("matched")).alias(f"{name}_matched"), mean_or_zero(F.col(c), F.col("routable")).alias(f"{name}_routable")]
    n, m, r = F.count("*"), F.count_if(F.col("matched")), F.count_if(F.col("routable"))
    return rows.groupBy(*by).agg(n.alias("od_pairs"), m.alias("matched_pairs"), r.alias("routable_pairs"), ratio(m, n).alias("endpoint_coverage"), ratio(r, m).alias("connectivity_rate"), ratio(r, n).alias("route_availability"), *out)


def prf(tp_pred: Column, n_pred: Column, tp_ref: Column, n_ref: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1; 0 where a count is 0."""
    p, r = ratio(tp_pred, n_pred), ratio(tp_ref, n_ref)
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.when(F.coalesce(F.sum(w), F.lit(0)) > 0, F.try_divide(F.sum(x * w), F.sum(w))).otherwise(0.0)


def path_scores(gt: Column, pred: Column, distance: Column, m: Metric) -> tuple[Column, Column, Column]:
    """Length, geometry and combined score of aligned paths, as columns; 0 where the path has no length."""
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    length = F.when(gt > 0, clamp(1 - F.abs(gt - pred) / gt)).otherwise(0.0)
    shape = F.when(gt > 0, clamp(1 - distance / m.tau)).otherwise(0.0)
    return length, shape, clamp(m.w_length * length + m.w_geometry * shape)


def weighted_bce(p: Column, y: Column, w: Column) -> Column:
    """Mean of weighted cross-entropy of probabilities held within 1e-7 of 0 and 1."""
    q = F.least(F.lit(1 - 1e-7), F.greatest(F.lit(1e-7), p))
    return F.avg(-w * (y * F.ln(q) + (1 - y) * F.ln(1 - q)))
