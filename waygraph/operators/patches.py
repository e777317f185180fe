"""Patch grids over images, and points in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.functions import geo


def grid(images: DataFrame, width: str, height: str) -> DataFrame:
    """(k, x0, y0, x1, y1) of images (k, p, n, margin): patches that include every edge."""
    at = lambda c: F.explode(geo.edge_inclusive(F.col(c), F.col("p"), F.col("n"), F.col("margin")))
    return images.withColumn("x0", at(width)).withColumn("y0", at(height)).select("k", "x0", "y0", (F.col("x0") + F.col("p")).alias("x1"), (F.col("y0") + F.col("p")).alias("y1"))


def occupied(points: DataFrame, size: int, least: int = 2) -> DataFrame:
    """(i, j, n): cells with at least ``least`` points."""
    return points.groupBy(F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def one_per_cell(points: DataFrame, size: int, id_: str = "nid") -> DataFrame:
    """The point of least id in each cell."""
    return points.groupBy(F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j")).agg(F.min(id_).alias(id_))
