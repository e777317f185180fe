"""Fusing overlapping observations of pixels and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pixel_mean(pixels: DataFrame) -> DataFrame:
    """(tile, r, c, total, n): sum and count over patches; their ratio is the fused value."""
    return pixels.groupBy("tile", "r", "c").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def edge_means(observed: DataFrame) -> DataFrame:
    """(u, v, mix, total, n) over patches, for each scoring pass."""
    return observed.groupBy("u", "v", "mix").agg(F.sum("s").alias("total"), F.count("*").alias("n"))


def fuse_passes(means: DataFrame) -> DataFrame:
    """(u, v, p, t): the higher of the passes' means; the mixed pass's (type 1) at a tie."""
    best = means.groupBy("u", "v").agg(F.max(F.struct((F.col("total") / F.col("n")).alias("p"), F.col("mix").alias("t"))).alias("m"))
    return best.select("u", "v", "m.p", "m.t")
