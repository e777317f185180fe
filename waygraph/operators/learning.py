"""Training arithmetic that needs no model: losses over scored rows, schedules, ramps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.operators import routing as R

EPS = 1e-7


def cross_entropy(p: Column, weight: Column | None = None) -> Column:
    """Weighted mean of -ln of the true class's probability."""
    loss = -F.ln(F.greatest(p, F.lit(EPS)))
    return F.avg(loss) if weight is None else F.try_divide(F.sum(loss * weight), F.sum(weight))


def focal(p: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Mean of cross-entropy times (1 - probability of the truth) ** gamma, classes weighted alpha and 1 - alpha."""
    q = F.least(F.lit(1 - EPS), F.greatest(F.lit(EPS), p))
    truth = F.when(y == 1, q).otherwise(1 - q)
    return F.avg(-F.when(y == 1, alpha).otherwise(1 - alpha) * F.pow(1 - truth, F.lit(gamma)) * F.ln(truth))


def learning_rate(step: Column, total: int, warm: float = 0.05, schedule: str = "poly", exponent: float = 0.9) -> Column:
    """Share of the base rate at a step: a linear rise, then polynomial or cosine decay."""
    if schedule not in ("poly", "cosine"):
        raise ValueError(f"not a schedule: {schedule}")
    rise = int(warm * total)
    done = (step - rise) / float(max(1, total - rise))
    fall = 0.5 * (1 + F.cos(F.lit(np.pi) * done)) if schedule == "cosine" else F.pow(1 - done, F.lit(exponent))
    return F.when(step < rise, step / float(max(1, rise))).otherwise(fall)


def ramp(step: Column, total: int, fraction: float) -> Column:
    """Share of a loss that counts at a step: linear up to ``fraction`` of all steps, then whole."""
    return F.least(F.lit(1.0), step / float(total) / fraction) if fraction > 0 else F.lit(1.0)


def balanced_loss(mask: Column, topology: Column, log_vars: tuple[float, float], scale: Column) -> Column:
    """Two losses by learned log variances."""
    a, b = log_vars
    return float(np.exp(-a)) * mask + a + float(np.exp(-b)) * topology * scale + b


def connectivity(edges: DataFrame, pairs: int = 16) -> DataFrame:
    """(graph_id, loss): mean of -ln of the scores' product along reference paths, over at most ``pairs`` node pairs.

    edges: graph_id, u, v, score, label. Paths have the fewest reference edges (label 1);
    pairs are taken in the order of a hash, among nodes that reference edges connect.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        score = {(min(u, v), max(u, v)): s for u, v, s in zip(pdf.u, pdf.v, pdf.score, strict=True)}
        adj = R.adjacency((int(u), int(v), 1.0) for u, v, y in zip(pdf.u, pdf.v, pdf.label, strict=True) if y == 1)
        order = sorted(adj, key=lambda n: (n * 0x9E3779B1) & 0xFFFFFFFF)
        sums: list[float] = []
        for i, s in enumerate(order):
            if len(sums) >= pairs:
                break
            dist, prev = R.dijkstra(adj, s)
            for t in order[i + 1 :]:
                if t in dist and len(sums) < pairs:
                    path = R.trail(prev, s, t)
                    sums.append(-sum(np.log(score[min(a, b), max(a, b)] + EPS) for a, b in zip(path, path[1:], strict=False)))
        return pd.DataFrame({"graph_id": [int(pdf.graph_id.iloc[0])], "loss": [float(np.mean(sums)) if sums else 0.0]})

    return edges.groupBy("graph_id").applyInPandas(run, "graph_id long, loss double")


def fiedler(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> float:
    """Second least eigenvalue of a weighted graph's Laplacian; 0 if it is disconnected."""
    a = np.zeros((n, n))
    a[u, v] = a[v, u] = w
    return float(np.linalg.eigvalsh(np.diag(a.sum(axis=1)) - a)[1])


def laplacian(edges: DataFrame, least: int = 4) -> DataFrame:
    """(graph_id, loss): how far the scored graph's second eigenvalue lies under the reference's, of graphs with ``least`` nodes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([pdf.u, pdf.v]), return_inverse=True)
        if len(names) < least:
            return pd.DataFrame({"graph_id": pd.Series([], dtype="int64"), "loss": pd.Series([], dtype="float64")})
        u, v = at[: len(pdf)], at[len(pdf) :]
        want, got = (fiedler(len(names), u, v, pdf[c].to_numpy(float)) for c in ("label", "score"))
        return pd.DataFrame({"graph_id": [int(pdf.graph_id.iloc[0])], "loss": [max(0.0, want - got + 1e-6)]})

    return edges.groupBy("graph_id").applyInPandas(run, "graph_id long, loss double")
