"""Which texts hold a passage of more than fifty words that another document holds too.

Words are compared, not bytes, so a passage counts however short its words are. As in
``suffix_dedup``, each window of ``PASSAGE`` words has an anchor, the place of its
eight-word gram of least hash: equal windows have equal anchors, so windows are compared
only where a gram at an anchor is shared. Runs of windows with one anchor that are equal
as a whole (copies, long passages) settle their documents by counting; the windows of
grams whose documents are still open are counted one by one.

Counts are aggregated before each shuffle and nothing is collected by key, so a gram that
a third of all documents share costs no more than its rows.

Edge cases: a null text has no words; rows alike in doc_id and text are one document, a
row without doc_id is told by its text; repeats within one document don't count; a text of
any length is taken whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.llm.common import discard, stored, swept

#: More than fifty words.
PASSAGE = 51
GRAM = 8
#: Bytes whose words are hashed at once, and windows that are compared at once.
BLOCK, WINDOWS = 1 << 18, 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """Stafford's 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0x2545F4914F6CDD1D
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number from the zeroth, and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] of each pair, the same wherever it stands."""
    up, down = _power(len(values) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    return _mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, byte at which it begins); words are what white space parts."""
    hashes, places = [], []
    at = 0
    while at < len(raw):
        stop = min(at + BLOCK, len(raw))
        while stop < len(raw) and not _SPACE[raw[stop]]:  # a block ends with a word
            stop += 1
        part = np.frombuffer(raw, np.uint8, stop - at, at)
        gap = _SPACE[part]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        hashes.append(_sums(_BYTE[part], starts, ends))
        places.append(starts + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    starts = np.arange(max(0, len(words) - size + 1))
    return _sums(words, starts, starts + size)


def runs(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(doc, first window, last window, gram, digest) of windows with one anchor, of words of many documents."""
    from waygraph.llm.suffix_dedup import least_in_window

    found = []
    for at in range(0, len(words) - size + 1, WINDOWS):
        w, d = words[at : at + WINDOWS + size - 1], doc[at : at + WINDOWS + size - 1]
        g = window_hashes(w, GRAM)
        packed = (g & ~np.uint64(0xFFFFFF)) | np.arange(len(g), dtype=np.uint64)
        anchor = (least_in_window(packed, size - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.flatnonzero(d[: len(anchor)] == d[size - 1 :])
        if not len(start):
            continue
        a, own = anchor[start], d[start]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (own[1:] != own[:-1]))))
        last = np.append(first[1:], len(start)) - 1
        lo, hi = start[first], start[last]
        # all words that the run's windows cover, and where its anchor is among them
        digest = _mixed(_sums(w, lo, hi + size) + (a[first] - lo).astype(np.uint64))
        found.append((own[first], lo + at, hi + at, g[a[first]].view(np.int64), digest.view(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def anchored(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, tkey, lo, hi, gram, ctx): runs of windows (numbered by their first word) with one anchor."""

    def flush(some: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        words = np.concatenate([w for _, _, w in some])
        n = np.array([len(w) for _, _, w in some])
        own, lo, hi, gram, ctx = runs(words, np.repeat(np.arange(len(some)), n), size)
        shift = (np.cumsum(n) - n)[own]
        ids, keys = (np.array([x[i] for x in some], np.int64)[own] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array((lo - shift).astype(np.int32)), pa.array((hi - shift).astype(np.int32)), pa.array(gram), pa.array(ctx)], names=["doc_id", "tkey", "lo", "hi", "gram", "ctx"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0
        for batch in batches:
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("tkey").to_pylist(), batch.column("text"), strict=True):
                words = word_hashes((text.as_py() or "").encode("utf-8", "surrogatepass"))[0]
                if len(words) < size:
                    continue
                some.append((doc, key, words))
                held += len(words)
                if held >= WINDOWS:
                    yield flush(some)
                    some, held = [], 0
        if some:
            yield flush(some)

    return docs.select("doc_id", "tkey", "text").mapInArrow(run, "doc_id long, tkey long, lo int, hi int, gram long, ctx long")


def _each_window(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(gram, window, doc_id, tkey) of the wanted runs."""
    cuts = wanted.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("lo", "hi", "gram")).alias("cut"))
    both = docs.join(cuts, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "cut")

    def flush(some):
        n = [len(w) for _, _, _, w in some]
        gram, doc, key = (np.repeat(np.array([x[i] for x in some], np.int64), n) for i in range(3))
        window = np.concatenate([w for _, _, _, w in some]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, window, doc, key)], names=["gram", "window", "doc_id", "tkey"])

    def run(batches):
        some, held = [], 0
        for batch in batches:
            for doc, key, text, cut in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = word_hashes((text or "").encode("utf-8", "surrogatepass"))[0]
                for c in cut:
                    w = window_hashes(words[c["lo"] : c["hi"] + size], size)
                    some.append((c["gram"], doc, key, w))
                    held += len(w)
                    if held >= 1 << 15:
                        yield flush(some)
                        some, held = [], 0
        if some:
            yield flush(some)

    return both.mapInArrow(run, "gram long, window long, doc_id long, tkey long")


def shared(docs: DataFrame, size: int = PASSAGE) -> DataFrame:
    """Distinct (doc_id, tkey) of ``docs`` (doc_id, tkey, text) that share ``size`` words in a row with another document."""
    node = F.xxhash64("doc_id", "tkey")
    two = F.min("node") != F.max("node")  # held by two documents at least
    marked = anchored(docs, size)  # made twice rather than stored: many rows, few of them shared
    # stored by itself, so that the join's own shuffle can be split where a gram is frequent
    grams = stored(marked.withColumn("node", node).groupBy("gram").agg(two.alias("two")).where("two").select("gram"), "passage-grams")
    met = stored(marked.join(grams, "gram", "left_semi").withColumn("node", node), "passage-shared")
    discard(grams)
    swept(docs.sparkSession)
    # equal runs: whether two documents hold them, and one run that stands for all
    rep = F.min(F.struct("doc_id", "tkey", "lo", "hi")).alias("rep")
    alike = stored(met.groupBy("gram", "ctx").agg(two.alias("two"), rep), "passage-alike")
    done = stored(met.join(alike.where("two").select("gram", "ctx"), ["gram", "ctx"], "left_semi").select("doc_id", "tkey").distinct(), "passage-copies")
    unsettled = met.join(done, ["doc_id", "tkey"], "left_anti").select("gram").distinct()
    loose = alike.select("gram", "rep.*").join(unsettled, "gram", "left_semi")
    each = _each_window(docs, loose, size)  # made twice as well, from one shuffle of the texts
    same = each.withColumn("node", node).groupBy("gram", "window").agg(two.alias("two")).where("two").select("gram", "window")
    out = stored(done.unionByName(each.join(same, ["gram", "window"], "left_semi").select("doc_id", "tkey")).distinct(), "passages")
    discard(met, alike, done)
    return out
