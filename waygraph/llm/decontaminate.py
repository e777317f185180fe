"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

A first scan counts in how many documents of the whole corpus each benchmark n-gram occurs;
the rare ones, in at most ``RARE_SHARE`` of the documents, are seeds. A second scan cuts the
window around an n-gram that an aligned copy would fill. Windows with a seed are aligned,
and so is each other window that has enough of the item's words to be a copy (an item that
leaked into very many documents has no rare n-gram), where they are found: no text is
written or shuffled. A text that many windows of a chunk share is aligned once. A copy is
one whose score reaches ``SIMILARITY`` of the item's score against itself.

The items' n-grams go to the workers in passes of at most ``PASS`` n-grams.

Edge cases: null or wordless texts and items match nothing; an item shorter than an
n-gram is one seed as a whole; repeated rows and items count each; empty tables give an empty
result; other columns are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.llm.common import free, only

WORD = re.compile(r"\w+")
GRAM = 3
RARE_SHARE, RARE_LEAST = 0.001, 10
SIMILARITY = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
PASS = 500_000
BATCH_CELLS = 1 << 18
#: Different windows that are gathered before they are aligned.
CHUNK = 4096


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(w: list[str], n: int) -> list[tuple[str, ...]]:
    return [tuple(w)] if 0 < len(w) < n else list(zip(*(w[i:] for i in range(n)), strict=False))


def slack(length: int) -> int:
    """Words that an edited copy may be longer or shifted by."""
    return 2 + length // 4


class Seeds:
    """n-gram -> [(item number, place in the item)], of one pass."""

    def __init__(self, items: list[tuple[int, list[str]]], n: int):
        self.n, self.items = n, items
        self.at: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        self.number: dict[tuple[str, ...], int] = {}
        self.short: dict[int, set] = defaultdict(set)
        for i, (_, w) in enumerate(items):
            for p, g in enumerate(grams(w, n)):
                self.at[g].append((i, p))
                self.number.setdefault(g, len(self.number))
                if len(g) < n:
                    self.short[len(g)].add(g)

    def hits(self, w: list[str]) -> list[tuple[int, tuple[str, ...]]]:
        """(place, n-gram) of the items' n-grams in a text."""
        known = self.at
        found = [(p, g) for p, g in enumerate(zip(*(w[i:] for i in range(self.n)), strict=False)) if g in known]
        for size, some in self.short.items():
            found += [(p, g) for p, g in enumerate(zip(*(w[i:] for i in range(size)), strict=False)) if g in some]
        return found

    def windows(self, w: list[str]) -> Iterator[tuple[int, int, int, list[int]]]:
        """(item, first word, end word, n-gram numbers), windows of an item merged."""
        hits, known = self.hits(w), self.at
        if not hits:
            return
        by_item: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for p, g in hits:
            for item, at in known[g]:
                length = len(self.items[item][1])
                by_item[item].append((max(0, p - at - slack(length)), min(len(w), p - at + length + slack(length)), self.number[g]))
        for item, spans in by_item.items():
            spans.sort()
            a, b, found = spans[0][0], spans[0][1], [spans[0][2]]
            for x, y, g in spans[1:]:
                if x <= a + slack(len(self.items[item][1])) * 2:
                    b = max(b, y)
                    found.append(g)
                else:
                    yield item, a, b, sorted(set(found))
                    a, b, found = x, y, [g]
            yield item, a, b, sorted(set(found))


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Best local alignment scores of (item, window) word numbers; one batch, padded.

    A row of the table at a time, over all pairs; gaps along the row by a running maximum.
    """
    m = max(len(a) for a, _ in pairs)
    k = max(len(b) for _, b in pairs)
    a = np.full((len(pairs), m), -1, np.int64)
    b = np.full((len(pairs), k), -2, np.int64)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)], b[i, : len(y)] = x, y
    ramp = -GAP * np.arange(1, k + 1)
    last = np.zeros((len(pairs), k + 1), np.int64)
    best = np.zeros(len(pairs), np.int64)
    for i in range(m):
        h = np.maximum(last[:, :-1] + np.where(b == a[:, i : i + 1], MATCH, MISMATCH), last[:, 1:] + GAP)
        np.maximum(h, 0, out=h)
        h = np.maximum.accumulate(h + ramp, axis=1) - ramp
        last[:, 1:] = h
        np.maximum(best, h.max(axis=1), out=best)
    return best


SCORED = "doc_id long, tkey long, item_id long, sw_score long, similarity double"


def rare_grams(docs: DataFrame, shared, documents: int) -> set[int]:
    """Numbers of the pass's rare n-grams, by the documents of the whole corpus that hold them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n = shared.value.number, Counter()
        for batch in batches:
            for text in batch.column("text"):
                n.update({number[g] for _, g in shared.value.hits(words(text.as_py()))})
        # at most PASS rows a task
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["g", "n"])

    limit = max(RARE_LEAST, int(RARE_SHARE * documents))
    counts = docs.select("text").mapInArrow(run, "g int, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return {r["g"] for r in counts.where(F.col("n") <= limit).collect()}  # at most PASS rows


def _score(docs: DataFrame, shared, rare, similarity: float) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, good = shared.value, rare.value
        number: dict[str, int] = {}
        own = [np.array([number.setdefault(x, len(number)) for x in w], np.int64) for _, w in seeds.items]
        bags = [Counter(w) for _, w in seeds.items]

        def enough(item: int, window: tuple[str, ...]) -> bool:
            """Could the words that both have reach the similarity, if all were aligned?"""
            return (Counter(window) & bags[item]).total() >= similarity * len(own[item]) - 1e-9

        def aligned(same: dict[tuple[int, tuple[str, ...]], list]) -> pa.RecordBatch:
            rows = sorted(same, key=lambda k: (len(own[k[0]]), len(k[1])))
            at, out = 0, []
            while at < len(rows):
                width = max(len(own[rows[at][0]]), len(rows[at][1]))
                some = rows[at : at + max(1, BATCH_CELLS // width)]
                at += len(some)
                best = align([(own[item], np.array([number.get(x, -3) for x in window], np.int64)) for item, window in some])
                for (item, window), s in zip(some, best.tolist(), strict=True):
                    share = s / (MATCH * len(own[item]))
                    if share >= similarity:
                        out += [(doc, key, seeds.items[item][0], s, share) for doc, key in same[item, window]]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "tkey", "item_id", "sw_score", "similarity"])

        for batch in batches:
            same: dict[tuple[int, tuple[str, ...]], list] = defaultdict(list)
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("tkey").to_pylist(), batch.column("text"), strict=True):
                w = words(text.as_py())
                for item, a, b, found in seeds.windows(w):
                    window = tuple(w[a:b])
                    if (item, window) in same or not good.isdisjoint(found) or enough(item, window):
                        same[item, window].append((doc, key))
                if len(same) >= CHUNK:
                    yield aligned(same)
                    same.clear()
            if same:
                yield aligned(same)

    return docs.mapInArrow(run, SCORED)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = GRAM, similarity: float = SIMILARITY, size: int = PASS) -> DataFrame:
    """(doc_id, tkey, item_id, sw_score, similarity), a row for each document and item that it holds.

    tkey: xxhash64 of the text.
    """
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"))
    items = only(benchmark, "item_id", "text").where("text IS NOT NULL").dropDuplicates()
    lengths = items.agg(F.sum(F.size(F.split("text", r"\W+")))).first()[0] or 0
    documents, out = docs.count(), None
    passes = -(-lengths // max(size, 1))
    for i in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).orderBy("item_id", "text")
        seeds = Seeds([(r["item_id"], w) for r in part.toLocalIterator() if (w := words(r["text"]))], n)
        if not seeds.items:
            continue
        shared = spark.sparkContext.broadcast(seeds)
        rare = spark.sparkContext.broadcast(rare_grams(rows, shared, documents))
        done = _score(rows, shared, rare, similarity)
        out = done if out is None else out.unionByName(done)
    if out is None:
        return spark.createDataFrame([], SCORED)
    return out.groupBy("doc_id", "tkey", "item_id").agg(F.max("sw_score").alias("sw_score"), F.max("similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, with their columns."""
    doc, key = free(docs, "doc_", "key_")
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias(doc), F.col("tkey").alias(key)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(key)), "left_anti")


def op9_rare_seed_alignment(spark, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "sw_score", "similarity")
