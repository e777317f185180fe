"""Non-maximum suppression of points, equal to the greedy pass in score order.

Points are ranked by (score down, id up). Each round accepts every open point that has no
open neighbour of higher rank, and suppresses the accepted points' neighbours; this gives
the lexicographically first maximal independent set, which is what the greedy pass keeps.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.operators.spatial import _sides, near_pairs
from waygraph.plans.storage import dealt, stored

#: Rounds whose points are put in one table, so that a long line of points keeps a short plan.
MERGE = 32


def suppress(points: DataFrame, radius, id_: str = "id", by: Sequence[str] = (), exempt: str | None = None) -> DataFrame:
    """Rows of ``points`` (id, x, y, score) that are kept; ``exempt`` names a flag of rows never suppressed."""
    left, right = _sides(points, id_, by, "x", "y")
    rank = points.select(*by, F.col(id_).alias("a"), F.col("score").alias("sa"))
    other = points.select(*by, F.col(id_).alias("b"), F.col("score").alias("sb"), *([F.col(exempt).alias("free")] if exempt else [F.lit(False).alias("free")]))
    # a may suppress b
    over = near_pairs(left, right, radius, by).where("a <> b").join(dealt(rank), [*by, "a"]).join(dealt(other), [*by, "b"])
    over = over.where("(sa > sb OR (sa = sb AND a < b)) AND NOT free").select(*by, "a", "b")
    over = stored(over, "nms-pairs")
    # rows without id or group are in no join, so none of them is kept
    open_ = stored(points.select(*by, F.col(id_).alias("n")).dropna(), "nms-open")
    kept = []
    while many := open_.count():  # the highest open point is accepted, so each round leaves fewer
        live = over.join(dealt(open_.withColumnRenamed("n", "a"), many), [*by, "a"], "left_semi").join(dealt(open_.withColumnRenamed("n", "b"), many), [*by, "b"], "left_semi")
        taken = stored(open_.join(dealt(live.select(*by, F.col("b").alias("n")).distinct(), many), [*by, "n"], "left_anti"), "nms-kept")
        gone = live.join(dealt(taken.withColumnRenamed("n", "a"), many), [*by, "a"], "left_semi").select(*by, F.col("b").alias("n")).distinct()
        open_ = stored(open_.join(dealt(taken, many), [*by, "n"], "left_anti").join(dealt(gone, many), [*by, "n"], "left_anti"), "nms-open")
        kept.append(taken)
        if len(kept) == MERGE:
            kept = [stored(functools.reduce(DataFrame.unionByName, kept), "nms-kept")]
    if not kept:
        return points
    out = functools.reduce(DataFrame.unionByName, kept)
    return points.join(dealt(out.withColumnRenamed("n", id_)), [*by, id_], "left_semi")
