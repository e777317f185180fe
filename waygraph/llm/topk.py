"""Exact top-k inner products by distributed histogram selection.

Components become floor(256 x), so scores are integers. Each pass scores every candidate
against every query and counts scores in equal bins; the bin that holds a query's kth
score is cut into bins again until it holds one score only. Then scores from the kth on
are kept and ranked, ties to the smaller vec_id.

A task sends, of each query's histogram, the bins from the top until they hold k scores:
the global kth score cannot lie below, so what is sent is complete where it matters.
Queries are taken ``PASS`` at a time, which bounds what is broadcast and held.

Edge cases: vectors that are null, empty or hold null or non-finite components, and rows
without vec_id, take no part; only vectors of equal length meet; rows with the query's
own vec_id are not its candidates; other repeated rows count each. Where rows that take
part share a query's vec_id, the least of their vectors (as lists of numbers) is the query.
Scores must fit a long: components so great that they could not raise ``ScoreRange``. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygraph.llm.common import only

SCALE = 256.0
BINS = 1024
PASS = 4096
ROWS, COLS = 512, 4096


class ScoreRange(ValueError):
    """Inner products of these vectors may not fit 64 bits."""


def usable() -> Column:
    """Rows that take part: an id, and components that are all there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad)


def vectors(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """vec_ids and integer vectors (as doubles) of a batch, by length."""
    ids, lists = batch.column("vec_id"), batch.column("embedding")
    flat = lists.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), dtype=np.float64)
    there = ~(np.asarray(lists.is_null()) | np.asarray(ids.is_null()))
    sizes = np.asarray(pc.list_value_length(lists).fill_null(0)) if len(lists) else np.zeros(0, int)
    ends = np.cumsum(sizes)
    keys = np.asarray(ids.fill_null(0))
    out = {}
    for dim in np.unique(sizes[there & (sizes > 0)]).tolist():
        rows = np.flatnonzero(there & (sizes == dim))
        v = np.floor(SCALE * values[(ends[rows] - dim)[:, None] + np.arange(dim)])
        good = np.isfinite(v).all(axis=1)
        if good.any():
            out[dim] = keys[rows[good]], v[good]
    return out


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles are exact under 2**53."""
    if np.abs(q).sum(axis=1).max() * np.abs(v).max() < 2**53:
        return (q @ v.T).astype(np.int64)
    return q.astype(np.int64) @ v.astype(np.int64).T


def _tiles(batches, queries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query places, candidate ids, scores) over blocks; own rows score below all."""
    for batch in batches:
        for dim, (ids, v) in vectors(batch).items():
            if dim not in queries:
                continue
            at, names, q = queries[dim]
            for a in range(0, len(q), ROWS):
                for b in range(0, len(v), COLS):
                    s = _scores(q[a : a + ROWS], v[b : b + COLS])
                    s[names[a : a + ROWS, None] == ids[None, b : b + COLS]] = np.iinfo(np.int64).min
                    yield at[a : a + ROWS], ids[b : b + COLS], s


def _histograms(rows: DataFrame, shared, state, k: int) -> DataFrame:
    """(query, bin, n): counts in each query's current range, above it as bin BINS."""

    def run(batches):
        low, width, _ = state.value
        counts = np.zeros((len(low), BINS + 1), np.int32)
        for at, _, s in _tiles(batches, shared.value):
            lo = low[at][:, None]
            inside = s >= lo
            bins = np.minimum((s - np.minimum(lo, s)) // width, BINS)
            flat = (at[:, None] * (BINS + 1) + bins)[inside]
            if len(flat):
                base = int(at[0]) * (BINS + 1)
                # a block's queries lie side by side
                counts[at[0] : at[-1] + 1].reshape(-1)[:] += np.bincount(flat - base, minlength=(int(at[-1]) - int(at[0]) + 1) * (BINS + 1)).astype(np.int32)
        down = counts[:, ::-1]
        sent = (down > 0) & (np.cumsum(down, axis=1) - down < k)
        q, b = np.nonzero(sent)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array((BINS - b).astype(np.int32)), pa.array(down[q, b].astype(np.int64))], names=["q", "bin", "n"])

    return rows.mapInArrow(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _kth_bins(hist: DataFrame, k: int) -> DataFrame:
    """For each query the highest bin at or above which k scores lie (else the lowest seen)."""
    w = Window.partitionBy("q").orderBy(F.col("bin").desc())
    upto = hist.withColumn("upto", F.sum("n").over(w))
    return upto.groupBy("q").agg(F.coalesce(F.max(F.when(F.col("upto") >= k, F.col("bin"))), F.lit(-1)).alias("bin"))


def _kept(rows: DataFrame, shared, state, k: int) -> DataFrame:
    """Scores from each query's kth on: of each task's tile its best k, ties to smaller ids."""

    def run(batches):
        floor = state.value[0]
        for at, ids, s in _tiles(batches, shared.value):
            good = (s >= floor[at][:, None]) & (s > np.iinfo(np.int64).min)
            q, c = np.nonzero(good)
            score, vec = s[q, c], ids[c]
            order = np.lexsort((vec, -score, q))
            q, score, vec = q[order], score[order], vec[order]
            first = np.searchsorted(q, q, side="left")
            top = np.arange(len(q)) - first < k
            yield pa.RecordBatch.from_arrays([pa.array(at[q[top]].astype(np.int32)), pa.array(vec[top].astype(np.int64)), pa.array(score[top])], names=["q", "vec_id", "score"])

    return rows.mapInArrow(run, "q int, vec_id long, score long")


def _one_pass(spark, rows: DataFrame, queries: dict, names: np.ndarray, reach: float, k: int) -> DataFrame:
    """One pass over all candidates for at most PASS queries."""
    shared = spark.sparkContext.broadcast(queries)
    # scores lie within +-reach; each query has its own range, all of one width
    low = np.full(len(names), -int(reach), np.int64)
    span = 2 * int(reach) + 1
    while span > 1:
        width = -(-span // BINS)
        state = spark.sparkContext.broadcast((low, width, span))
        for r in _kth_bins(_histograms(rows, shared, state, k), k).collect():  # a row a query of this pass
            low[r["q"]] += max(r["bin"], 0) * width
        span = width
    state = spark.sparkContext.broadcast((low, 1, 1))
    ids = spark.createDataFrame([(i, int(n)) for i, n in enumerate(names.tolist())], "q int, query_id long")
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    ranked = _kept(rows, shared, state, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(ids), "q").select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, is_query, k: int = 5, size: int = PASS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's ``k`` best candidates.

    ``is_query``: a condition on vec_id. Every row is a candidate.
    """
    spark = rows.sparkSession
    rows = only(rows, "vec_id", "embedding").where(usable())
    chosen = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def norms(batches):
        for batch in batches:
            best = max((float(np.sqrt((v * v).sum(axis=1).max())) for _, v in vectors(batch).values()), default=0.0)
            yield pa.RecordBatch.from_arrays([pa.array([best])], names=["norm"])

    norm = rows.mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0] or 0.0
    if norm * norm >= 2.0**62:
        raise ScoreRange(f"a vector of length {norm:g}, in 256ths")
    # about size / 2 queries a pass
    passes = -(-2 * chosen.count() // size)
    out = None
    for i in range(passes):
        part = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i)
        table = part.sort("vec_id").toArrow()
        queries, names = {}, []
        for batch in table.to_batches():
            for dim, (ids, v) in vectors(batch).items():
                queries.setdefault(dim, []).append((ids, v))
        packed, at = {}, 0
        for dim, found in queries.items():
            ids, v = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            packed[dim] = (np.arange(at, at + len(ids)), ids, v)
            names.append(ids)
            at += len(ids)
        if not at:
            continue
        done = _one_pass(spark, rows, packed, np.concatenate(names), norm * norm + 1, k)
        out = done if out is None else out.unionByName(done)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out


def op5_histogram_topk(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
