"""Groups of texts whose word-shingle sets have at least a given Jaccard similarity.

An exact set-similarity join. All sets are ordered by one order of the shingles, frequent
ones last; two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of
each (prefix filter), so texts that share none there are never compared and no true pair
is missed. Sizes and places in the order rule out further pairs; what is left is decided
on the texts' own shingles. How frequent a shingle is comes from a sample: that changes
the cost, not the result. Before texts are moved, counts of their shingles in buckets
(``sketch``) rule out most pairs: the lesser counts' sum is no less than what two sets share.

A large group of like texts would give all its pairs, so two steps: first the pairs that
another search proposes (SimHash) and a chain and a star in each group of texts that share
a shingle, verified and connected; then all pairs whose ends are not connected yet. Chains
and stars follow one order of the texts, so that like texts propose the same few pairs for
each shingle they share; a star's hub is the text with the fewest rarer shingles, which of
many changed copies is the one that is like all others.

Edge cases: wordless texts (null too) are alike; a text shorter than a shingle is one
shingle as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.llm.common import discard, only, stored, swept
from waygraph.operators.graph import canonical, connected_components
from waygraph.plans.storage import dealt

SEED = 42
#: One text in so many tells which shingles are frequent; at most so many are, from so many texts on.
SAMPLE, FREQUENT, LEAST = 16, 1 << 16, 4
#: Members that are compared in one task, and groups whose pairs are found side by side.
GROUP, SMALL = 8192, 16
EPS = 1e-9


def text_key() -> Column:
    """What tells texts apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, width: int) -> set[bytes]:
    words = split(text)
    if 0 < len(words) < width:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def hashes(text: str | None, width: int) -> np.ndarray:
    """The set of the shingles' hashes."""
    words, digest = split(text), xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    own = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def similar(a: set[bytes], b: set[bytes], similarity: float) -> bool:
    both = len(a & b)
    either = len(a) + len(b) - both
    return both >= similarity * either - EPS


def frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent shingles in rising order, and how many of the sample's texts have them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(hashes(text.as_py(), width).view(np.int64))], names=["h"])

    some = docs.where(F.pmod("node", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "h long")
    top = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in top], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix(h: np.ndarray, known: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set in the common order, as many as the similarity asks for."""
    often = np.zeros(len(h), np.int64)
    if len(known[0]) and len(h):
        at = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
        often = np.where(known[0][at] == h, known[1][at], 0)
    return h[np.lexsort((h, often))][: len(h) - ceil(similarity * len(h) - EPS) + 1]


def sketch(h: np.ndarray) -> bytes:
    """How many of a set's hashes fall in each of 2^k buckets, two to four on average; none where a count is too large for a byte."""
    size = 1 << (max(len(h), 16) // 4).bit_length()
    n = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


def at_most(a: bytes, b: bytes) -> float:
    """So many elements, at most, that the sets of two sketches share."""
    if not a or not b:
        return float("inf")
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    while len(x) > len(y):
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] + y[len(y) // 2 :]
    return int(np.minimum(x, y).sum())


def prefixes(docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """(node, size, first, sketch) of each text: its shingles' number, prefix and sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, width))

    def cut(batches):
        known = shared.value
        for batch in batches:
            sizes, firsts, sketches = [], [], []
            for text in batch.column("text"):
                h = hashes(text.as_py(), width)
                sizes.append(len(h))
                firsts.append((prefix(h, known, similarity) if len(h) else np.zeros(1, np.uint64)).tobytes())
                sketches.append(sketch(h))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int32()), pa.array(firsts, pa.binary()), pa.array(sketches, pa.binary())], names=["node", "size", "first", "sketch"])

    form = "node long, size int, first binary, sketch binary"
    return stored(docs.select("node", "text").mapInArrow(cut, form).dropDuplicates(["node"]), "alike-prefixes")


def meetings(once: DataFrame) -> DataFrame:
    """(token, node, size, pos): each text's prefix, where another text has the token too."""

    def spread(batches):
        for batch in batches:
            firsts = batch.column("first").to_pylist()
            n = np.array([len(f) // 8 for f in firsts], np.int64)
            token = np.frombuffer(b"".join(firsts), np.int64)
            node, size = (np.repeat(batch.column(c).to_numpy(), n) for c in ("node", "size"))
            pos = (np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            for at in range(0, len(token), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (token, node, size, pos)], names=["token", "node", "size", "pos"])

    def shared_only(batches):
        """Rows whose token the row before or after has too; the last row waits for the next batch."""
        last, met = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
            token = whole.column("token").to_numpy()
            same = token[1:] == token[:-1]
            good = np.concatenate(([met], same)) | np.concatenate((same, [False]))
            yield whole.slice(0, len(token) - 1).filter(pa.array(good[:-1]))
            last, met = whole.slice(len(token) - 1), bool(good[-1])
        if last is not None and met:
            yield last

    form = "token long, node long, size int, pos int"
    rows = once.select("node", "size", "first").mapInArrow(spread, form).repartition("token").sortWithinPartitions("token")
    return stored(rows.mapInArrow(shared_only, form), "alike-meet")


def pairs(met: DataFrame, similarity: float, few: bool, group: int | None = None) -> DataFrame:
    """Pairs (u, v) of different ``root`` that may be alike; ``few``: only a chain and a star of each group."""
    group = group or GROUP
    sizes = met.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > group)
    dealt = (
        met.join(sizes, "token", "left")
        .withColumn("k", F.coalesce(F.ceil(F.col("n") / F.lit(group / 2)).cast("int"), F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        # each two blocks meet, and each block meets itself
        .select("node", "root", "size", "pos", "block", F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")).alias("key"))
    )
    names = ("key", "size", "node", "root", "pos", "block")

    def flush(key, size, node, root, pos, block):
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        length = np.diff(cut)

        def good(a, b):
            need = similarity / (1 + similarity) * (size[a] + size[b]) - EPS
            fits = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - EPS
            fits &= 1 + np.minimum(size[a] - pos[a] - 1, size[b] - pos[b] - 1) >= need
            fits &= root[a] != root[b]
            return pa.RecordBatch.from_arrays([pa.array(node[a[fits]]), pa.array(node[b[fits]])], names=["u", "v"])

        if few:
            at = np.flatnonzero(key[1:] == key[:-1])  # rows are in order of node
            yield good(at, at + 1)
            # the hub has the fewest shingles that are rarer than the shared one: no changes of its own
            hub = np.lexsort((node, pos, key))[cut[:-1]]
            yield good(np.repeat(hub, length), np.arange(len(key)))
            return
        some = np.flatnonzero(np.repeat(length <= SMALL, length))
        k = key[some]
        for o in range(1, min(SMALL, len(k))):
            hit = np.flatnonzero(k[o:] == k[:-o])
            yield good(some[hit], some[hit + o])
        for a, n in zip(cut[:-1][length > SMALL].tolist(), length[length > SMALL].tolist(), strict=True):
            across = bool((block[a : a + n] != block[a]).any())
            top = np.searchsorted(size[a : a + n], size[a : a + n] / similarity + EPS, "right")  # rows are in order of size
            for i in range(n):
                b = np.arange(a + i + 1, a + int(top[i]))
                b = b[(root[b] != root[a + i]) & ((block[b] != block[a + i]) | (not across))]
                if len(b):
                    yield good(np.full(len(b), a + i), b)

    def run(batches):
        rest = None
        for batch in batches:
            cols = tuple(batch.column(c).to_numpy() for c in names)
            cols = cols if rest is None else tuple(np.concatenate(x) for x in zip(rest, cols, strict=True))
            last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last group may go on
            if last:
                yield from flush(*(c[:last] for c in cols))
            rest = tuple(c[last:] for c in cols)
        if rest is not None and len(rest[0]):
            yield from flush(*rest)

    return dealt.repartition("key").sortWithinPartitions("key", "node" if few else "size").mapInArrow(run, "u long, v long")


def likely(found: DataFrame, once: DataFrame, similarity: float) -> DataFrame:
    """The pairs without those whose sketches rule out that they are as similar; no similar pair goes."""
    a = once.select(F.col("node").alias("u"), F.col("size").alias("nu"), F.col("sketch").alias("su"))
    b = once.select(F.col("node").alias("v"), F.col("size").alias("nv"), F.col("sketch").alias("sv"))

    def run(batches):
        for batch in batches:
            n = (batch.column("nu").to_numpy().astype(np.int64) + batch.column("nv").to_numpy()) * (similarity / (1 + similarity)) - EPS
            most = [at_most(x.as_py(), y.as_py()) for x, y in zip(batch.column("su"), batch.column("sv"), strict=True)]
            good = pa.array(np.array(most, float) >= n)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(good), batch.column("v").filter(good)], names=["u", "v"])

    return stored(found.join(dealt(b), "v").join(dealt(a), "u").select("u", "v", "nu", "nv", "su", "sv").mapInArrow(run, "u long, v long"), "alike-likely")


def verified(found: DataFrame, docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """Those of the pairs whose texts' shingle sets are as similar."""
    ends = found.select(F.col("u").alias("node")).unionByName(found.select(F.col("v").alias("node"))).distinct()
    texts = docs.select("node", "text").join(ends, "node", "left_semi").dropDuplicates(["node"])
    a = texts.select(F.col("node").alias("u"), F.col("text").alias("tu"))
    b = texts.select(F.col("node").alias("v"), F.col("text").alias("tv"))

    def run(batches):
        u, left = None, set()
        for batch in batches:
            keep = []
            for x, s, t in zip(batch.column("u").to_pylist(), batch.column("tu"), batch.column("tv"), strict=True):
                if x != u:
                    u, left = x, shingles(s.as_py(), width)
                keep.append(similar(left, shingles(t.as_py(), width), similarity))
            good = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(good), batch.column("v").filter(good)], names=["u", "v"])

    return stored(found.join(b, "v").join(a, "u").select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long"), "alike-links")


def groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, proposed: DataFrame | None = None, linked: DataFrame | None = None) -> DataFrame:
    """(node, root) of every text that is alike another one; node is ``text_key``.

    ``proposed``: pairs (u, v) of nodes that are verified first; ``linked``: pairs that are
    in one group as they are. Each step that moves texts or their shingles begins without the shuffle files of those before, which else add up.
    """
    spark = docs.sparkSession
    own = only(docs, "text").select(text_key().alias("node"), "text")
    swept(spark)
    once = prefixes(own, similarity, width)
    swept(spark)
    met = meetings(once)
    swept(spark)
    some = pairs(met.withColumn("root", F.col("node")), similarity, True)
    some = stored(canonical(some if proposed is None else some.unionByName(proposed)), "alike-pairs")
    some = likely(some, once, similarity)
    swept(spark)
    first = verified(some, own, similarity, width)
    swept(spark)
    if linked is not None:
        first = first.unionByName(stored(canonical(linked), "alike-linked"))
        swept(spark)
    named = connected_components(first).select(F.col("id").alias("node"), "component")
    rest = pairs(met.join(named, "node", "left").withColumn("root", F.coalesce("component", "node")), similarity, False)
    rest = stored(canonical(rest), "alike-pairs")
    swept(spark)
    rest = likely(rest, once, similarity)
    swept(spark)
    links = first.unionByName(verified(rest, own, similarity, width))
    discard(once, met)
    swept(spark)
    return connected_components(links).select(F.col("id").alias("node"), F.col("component").alias("root"))
