"""Spatial joins by grid cells: an equi-join on cells, then the exact test.

A cell is as wide as the search distance, so a match lies in one of nine cells; one side
is laid out over them. Coordinates are plain numeric columns; ids are comparable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygraph.plans.storage import dealt, stored


def _cell(c: Column, size) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def _around(df: DataFrame, x: str, y: str, size) -> DataFrame:
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return (
        df.withColumn("_i", F.explode(F.transform(steps, lambda d: _cell(F.col(x), size) + d)))
        .withColumn("_j", F.explode(F.transform(steps, lambda d: _cell(F.col(y), size) + d)))
    )


def near_pairs(left: DataFrame, right: DataFrame, radius, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., a, ax, ay, b, bx, by_, d2) with squared distance at most radius squared.

    ``left`` has a, ax, ay and ``right`` b, bx, by_ (and both the ``by`` columns).
    """
    l = _around(left, "ax", "ay", radius)
    r = right.withColumn("_i", _cell(F.col("bx"), radius)).withColumn("_j", _cell(F.col("by_"), radius))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by_")
    return l.join(dealt(r), [*by, "_i", "_j"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= radius * radius).drop("_i", "_j")


def _sides(df: DataFrame, id_: str, by: Sequence[str], x: str, y: str) -> tuple[DataFrame, DataFrame]:
    left = df.select(*by, F.col(id_).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"))
    return left, df.select(*by, F.col(id_).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by_"))


def radius_join(df: DataFrame, radius, id_: str, by: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """(by..., a, b, d2) with a < b, within the radius (inclusive)."""
    left, right = _sides(df, id_, by, x, y)
    return near_pairs(left, right, radius, by).where("a < b").select(*by, "a", "b", "d2")


def knn_join(df: DataFrame, radius, k: int, id_: str, by: Sequence[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """Distinct pairs (by..., u, v): each point with its ``k`` nearest strictly within the radius."""
    left, right = _sides(df, id_, by, x, y)
    near = near_pairs(left, right, radius, by).where((F.col("a") != F.col("b")) & (F.col("d2") < radius * radius))
    w = Window.partitionBy(*by, "a").orderBy("d2", "b")
    return near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select(*by, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def nearest_join(left: DataFrame, right: DataFrame, radius, by: Sequence[str] = ()) -> DataFrame:
    """Every left row with its nearest right id (b) within the radius, else null; ties to the least id."""
    best = near_pairs(left, right, radius, by).groupBy(*by, "a").agg(F.min(F.struct("d2", "b")).alias("_m"))
    return left.join(dealt(best.select(*by, "a", F.col("_m.b").alias("b"), F.col("_m.d2").alias("d2"))), [*by, "a"], "left")


def near_any(left: DataFrame, right: DataFrame, radius, by: Sequence[str] = ()) -> DataFrame:
    """Left rows with any right row within the radius."""
    hit = near_pairs(left, right, radius, by).select(*by, "a").distinct()
    return left.join(dealt(hit), [*by, "a"], "left_semi")


def box_join(points: DataFrame, boxes: DataFrame, size, by: Sequence[str] = ()) -> DataFrame:
    """Points (x, y) in boxes (x0, y0, x1, y1; edges count), by the cells that a box covers."""
    cells = (
        boxes.withColumn("_i", F.explode(F.sequence(_cell(F.col("x0"), size), _cell(F.col("x1"), size))))
        .withColumn("_j", F.explode(F.sequence(_cell(F.col("y0"), size), _cell(F.col("y1"), size))))
    )
    at = points.withColumn("_i", _cell(F.col("x"), size)).withColumn("_j", _cell(F.col("y"), size))
    return at.join(dealt(cells), [*by, "_i", "_j"]).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").drop("_i", "_j")


def _crossed(segments: DataFrame, size) -> DataFrame:
    """Pairs of crossing segments, a_id < b_id, each with both segments' places (a_x1 to b_y2).

    Segments are laid out over the cells that their boxes cover; a pair that meets in
    several cells counts in the first one only, so nothing is dealt out again.
    """
    def laid(p: str) -> DataFrame:
        s = segments.select(*[F.col(c).alias(p + c) for c in ("id", "x1", "y1", "x2", "y2")])
        for c, cell in (("x", "_i"), ("y", "_j")):
            lo, hi = (_cell(end(F.col(f"{p}{c}1"), F.col(f"{p}{c}2")), size) for end in (F.least, F.greatest))
            s = s.withColumn(f"{p}lo{c}", lo).withColumn(cell, F.explode(F.sequence(lo, hi)))
        return s

    def side(p: str, q: str, end: str) -> Column:
        c = lambda n: F.col(n)
        return (c(f"{p}x2") - c(f"{p}x1")) * (c(f"{q}y{end}") - c(f"{p}y1")) - (c(f"{p}y2") - c(f"{p}y1")) * (c(f"{q}x{end}") - c(f"{p}x1"))

    first = (F.col("_i") == F.greatest("a_lox", "b_lox")) & (F.col("_j") == F.greatest("a_loy", "b_loy"))
    both = laid("a_").join(dealt(laid("b_")), ["_i", "_j"]).where("a_id < b_id").where(first)
    cross = (F.signum(side("a_", "b_", "1")) * F.signum(side("a_", "b_", "2")) < 0) & (F.signum(side("b_", "a_", "1")) * F.signum(side("b_", "a_", "2")) < 0)
    return both.where(cross).drop("_i", "_j", "a_lox", "a_loy", "b_lox", "b_loy")


def crossings(segments: DataFrame, size) -> DataFrame:
    """(a, b), a < b: segments (id, x1, y1, x2, y2) whose interiors cross; shared ends and collinear ones don't."""
    return _crossed(segments, size).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def nearest_share(px, py, x1, y1, x2, y2) -> Column:
    """Where on a segment a point is nearest to, as a share of its length."""
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.nullif(n, F.lit(0)))))


def point_segment_d2(px, py, x1, y1, x2, y2, share: Column | None = None) -> Column:
    """Squared distance from a point to a segment; ``share``: ``nearest_share``, where it is at hand."""
    dx, dy = x2 - x1, y2 - y1
    t = nearest_share(px, py, x1, y1, x2, y2) if share is None else share
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey


def near_segments(points: DataFrame, segments: DataFrame, radius) -> DataFrame:
    """(pid, sid): points (pid, px, py) within ``radius`` of segments (sid, x1, y1, x2, y2)."""
    lo = lambda c: _cell(F.least(F.col(f"{c}1"), F.col(f"{c}2")) - radius, radius * 4)
    hi = lambda c: _cell(F.greatest(F.col(f"{c}1"), F.col(f"{c}2")) + radius, radius * 4)
    s = segments.withColumn("_i", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("_j", F.explode(F.sequence(lo("y"), hi("y"))))
    p = points.withColumn("_i", _cell(F.col("px"), radius * 4)).withColumn("_j", _cell(F.col("py"), radius * 4))
    # the join itself only tests the segment's box; behind the generator the share is computed once, and the test stays out of the join's code
    box = [F.col(f"p{c}").between(F.least(f"{c}1", f"{c}2") - radius, F.greatest(f"{c}1", f"{c}2") + radius) for c in ("x", "y")]
    at = [F.col(c).cast("double") for c in ("px", "py", "x1", "y1", "x2", "y2")]
    met = p.join(dealt(s), ["_i", "_j"]).where(box[0] & box[1]).withColumn("_t", F.explode(F.array(nearest_share(*at))))
    return met.where(point_segment_d2(*at, F.col("_t")) <= radius * radius).select("pid", "sid")


def clip(segments: DataFrame, boxes: DataFrame, size) -> DataFrame:
    """Parts of segments (sid, x1..y2) inside boxes (bid, x0, y0, xe, ye): Liang-Barsky in columns.

    Both are laid out over the cells of ``size`` that they cover; a pair that meets in
    several cells counts in the first one only. A part of no length is dropped.
    """

    def laid(df: DataFrame, ends: dict[str, tuple[Column, Column]], p: str) -> DataFrame:
        for axis, (lo, hi) in ends.items():
            df = df.withColumn(f"{p}{axis}", _cell(lo, size)).withColumn(f"_{axis}", F.explode(F.sequence(_cell(lo, size), _cell(hi, size))))
        return df

    s = laid(segments, {c: (F.least(f"{c}1", f"{c}2"), F.greatest(f"{c}1", f"{c}2")) for c in ("x", "y")}, "_s")
    b = laid(boxes, {c: (F.col(f"{c}0"), F.col(f"{c}e")) for c in ("x", "y")}, "_b")
    first = (F.col("_x") == F.greatest("_sx", "_bx")) & (F.col("_y") == F.greatest("_sy", "_by"))
    s = s.join(dealt(b), ["_x", "_y"]).where(first).where("greatest(x1, x2) >= x0 AND least(x1, x2) <= xe AND greatest(y1, y2) >= y0 AND least(y1, y2) <= ye")
    dx, dy = (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")
    entry, leave = [F.lit(0.0)], [F.lit(1.0)]
    for d, at, lo, hi in ((dx, "x1", "x0", "xe"), (dy, "y1", "y0", "ye")):
        low, high = (F.col(lo) - F.col(at)) / F.nullif(d, F.lit(0.0)), (F.col(hi) - F.col(at)) / F.nullif(d, F.lit(0.0))
        entry.append(F.coalesce(F.least(low, high), F.lit(0.0)))
        leave.append(F.coalesce(F.greatest(low, high), F.lit(1.0)))
    t = s.withColumn("t0", F.greatest(*entry)).withColumn("t1", F.least(*leave)).where("t0 < t1")
    at = lambda a, d, q: (F.col(a) + F.col(q) * d).alias
    return t.select("sid", "bid", at("x1", dx, "t0")("cx1"), at("y1", dy, "t0")("cy1"), at("x1", dx, "t1")("cx2"), at("y1", dy, "t1")("cy2"))


def noded(segments: DataFrame, size) -> DataFrame:
    """(id, t0, t1, ax, ay, bx, by_): segments (id, x1, y1, x2, y2) cut wherever two cross.

    t: the share of the segment's length; pieces that meet have equal t there, so they share an end.
    """
    s = stored(segments.select("id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]), "segments")
    d = lambda k, c: F.col(f"{k}_{c}2") - F.col(f"{k}_{c}1")
    off = lambda k, o, c: F.col(f"{o}_{c}1") - F.col(f"{k}_{c}1")
    share = lambda k, o: (off(k, o, "x") * d(o, "y") - off(k, o, "y") * d(o, "x")) / (d(k, "x") * d(o, "y") - d(k, "y") * d(o, "x"))
    cut = lambda k, o: F.struct(F.col(f"{k}_id").alias("id"), share(k, o).alias("t0"))
    # both segments' cuts are found where the pair meets; only they are dealt out by segment
    cuts = _crossed(s, size).select(F.explode(F.array(cut("a", "b"), cut("b", "a"))).alias("c")).select("c.id", "c.t0")
    ends = s.select("id", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t0"))
    after = F.lead("t0").over(Window.partitionBy("id").orderBy("t0"))  # a segment's own cuts
    piece = cuts.unionByName(ends).withColumn("t1", after).where("t0 < t1").join(dealt(s), "id")
    at = lambda c, q: F.col(f"{c}1") + F.col(q) * (F.col(f"{c}2") - F.col(f"{c}1"))
    return piece.select("id", "t0", "t1", at("x", "t0").alias("ax"), at("y", "t0").alias("ay"), at("x", "t1").alias("bx"), at("y", "t1").alias("by_"))
