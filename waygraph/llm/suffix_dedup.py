"""Removal of repeated byte strings by merging shards' sparse Burrows-Wheeler transforms.

Every 400-byte string has an anchor: the place in it whose 32-byte gram has the least
hash. Equal strings have their anchors at equal places, so only suffixes that begin at
anchors need an order (about one byte in 185). The text from an anchor on is a string of
eight-byte symbols. A shard keeps the transform of its strings: for each length of suffix
the symbols that come before, in the suffixes' order. Shards are merged two by two by
refining the interleave of their orders (``merge``): it begins with suffixes of no symbols
and each pass lengthens them by one, reading both transforms as they are; neither side's
suffixes are sorted again. The passes over the merged transform say how much neighbours
have in common (``common_symbols``). The same, done with the preceding text read
backwards, gives common suffixes. For each distance d from string start to anchor, the
repeated intervals are those with d equal bytes before and 400 - d equal bytes from the
anchor on.

What keeps it in proportion: anchors whose gram is alone in the corpus are done at once;
anchors with the same surroundings (all strings that they stand for) are counted, and one
stands for all; only the rest is merged, by gram. A gram with more than ``HOT`` different
surroundings is not brought to one task: its strings are counted one by one.

Edge cases: a null text is empty; texts under 400 bytes keep all; repeated rows (doc_id
and text alike) are documents of their own and repeat each other; a null doc_id is a value
like any other; an empty table gives an empty result; other columns are ignored; long
texts are taken in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.llm import passages
from waygraph.llm.common import discard, only, stored, swept

LENGTH, GRAM = 400, 32
CHUNK = 1 << 20
#: Surroundings of one gram that a task still merges: about 20 MB of text.
HOT = 32768
#: Strings of a shard whose transform is built at once.
SHARD = 1024
#: Bytes of surroundings that a task merges at once.
MERGE_BYTES = 2 << 20
#: Odd 64-bit multipliers (digits of pi's fraction).
MIX = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707345, 0xA4093822299F31D1, 0x082EFA98EC4E6C89)]


def gram_hashes(data: bytes) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    n = len(data) - GRAM + 1
    word = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    h = np.zeros(n, np.uint64)
    for k, mult in enumerate(MIX):
        h += word[8 * k : 8 * k + n]
        h *= mult
        h ^= h >> np.uint64(29)
    return h


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` consecutive values, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(out) - (width - span)], out[width - span :])
    return out


def anchor_runs(data: bytes, cuts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(piece, anchor, first start, last start, gram hash) over concatenated pieces.

    ``cuts``: where each piece begins, and the end. Places count from the chunk's begin.
    """
    empty = (np.zeros(0, np.int64),) * 5
    if len(data) < length:
        return empty
    h = gram_hashes(data)
    packed = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    at = (least_in_window(packed, length - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.arange(len(at))
    piece = np.searchsorted(cuts, starts, side="right") - 1
    whole = starts + length <= cuts[piece + 1]  # the string ends in its own piece
    starts, piece, at = starts[whole], piece[whole], at[whole]
    if not len(starts):
        return empty
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return piece[first], at[first], starts[first], starts[last], h[at[first]].view(np.int64)


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Chunks of (row, offset, bytes); a long text comes in pieces that overlap by length - 1."""
    chunk, size = [], 0
    for row, text in enumerate(texts):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, CHUNK):
            piece = text[at : at + CHUNK + length - 1]
            if chunk and size + len(piece) > CHUNK + length:
                yield chunk
                chunk, size = [], 0
            chunk.append((row, at, piece))
            size += len(piece)
    if chunk:
        yield chunk


ANCHORS = "doc_id long, tkey long, a int, lo int, hi int, gram long, ctx binary"


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """One row for each run of strings with the same anchor; ctx: digest of all its bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("tkey").to_numpy()
            ids = np.asarray(batch.column("doc_id").fill_null(-1)) if batch.column("doc_id").null_count else ids
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text")]
            for chunk in _pieces(texts, length):
                data = b"".join(p for _, _, p in chunk)
                cuts = np.concatenate(([0], np.cumsum([len(p) for _, _, p in chunk])))
                piece, a, lo, hi, gram = anchor_runs(data, cuts, length)
                rows = np.array([r for r, _, _ in chunk])[piece]
                shift = np.array([o for _, o, _ in chunk])[piece] - cuts[piece]
                ctx = [digest(data[x : y + length], z) for x, y, z in zip(lo.tolist(), hi.tolist(), (a - lo).tolist(), strict=True)]
                i32 = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows]), pa.array(keys[rows]), i32(a + shift), i32(lo + shift), i32(hi + shift), pa.array(gram), pa.array(ctx, pa.binary())],
                    names=["doc_id", "tkey", "a", "lo", "hi", "gram", "ctx"],
                )

    return docs.mapInArrow(run, ANCHORS)


# ---- the merge -----------------------------------------------------------------------


def symbols(rows: list[bytes], width: int) -> np.ndarray:
    """Eight bytes a symbol, big end first, so that symbols compare as bytes do."""
    cols = -(-width // 8)
    flat = b"".join(r[: cols * 8].ljust(cols * 8, b"\0") for r in rows)
    return np.frombuffer(flat, ">u8").reshape(len(rows), cols).astype(np.uint64)


class Transform:
    """Burrows-Wheeler transform of strings of equal length, a row of suffixes for each length.

    ``last[o][j]``: the symbol before the jth of the suffixes that begin at place o + 1, in
    their order; ``step[o][j]``: the place of the suffix that this symbol lengthens, in the
    order of those that begin at o. ``rows``: the strings in order (whole strings begin at 0).
    """

    def __init__(self, last: list[np.ndarray], step: list[np.ndarray], rows: np.ndarray):
        self.last, self.step, self.rows = last, step, rows


def _places(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int32)
    out[order] = np.arange(len(order), dtype=np.int32)
    return out


def shard_transform(sym: np.ndarray, members: np.ndarray) -> Transform:
    """A shard's transform of its own strings, built from the last symbol to the first."""
    n, cols = len(members), sym.shape[1]
    last, step, rows = [np.empty(0)] * cols, [np.empty(0)] * cols, np.asarray(members)
    for o in reversed(range(cols)):
        last[o] = sym[rows, o]
        order = np.argsort(last[o], kind="stable")
        step[o], rows = _places(order), rows[order]
    return Transform(last, step, rows)


def _woven(z: np.ndarray, own: np.ndarray, one, two) -> np.ndarray:
    """Values of the first at places ``own``, of the second at the others."""
    out = np.empty(len(z), one.dtype)
    out[own], out[~z] = one, two
    return out


def merge(one: Transform, two: Transform) -> Transform:
    """Transform of both sets: the interleave of their orders, refined a symbol at a time.

    ``before[j]`` says how many suffixes of ``two`` come before the jth of ``one``: the
    interleave. It begins with suffixes of no symbols, all equal, ``one`` first. A pass
    lengthens all suffixes by the symbol before them: those of ``two`` that then come
    before a suffix c + x of ``one`` are those with a symbol under c, and of those with c
    the ones that came before x. Neither side is sorted again: their own orders
    (``last``, ``step``) are read as they are.
    """
    n, m = len(one.rows), len(two.rows)
    cols = len(one.last)
    before = np.zeros(n, np.int64)
    last, step = [np.empty(0)] * cols, [np.empty(0)] * cols
    z = own = None

    def interleave():
        own = np.arange(n) + before
        z = np.zeros(n + m, bool)
        z[own] = True
        return z, own

    z, own = interleave()
    for o in reversed(range(cols)):
        last[o] = _woven(z, own, one.last[o], two.last[o])
        came = np.empty(m, np.int64)  # where the suffix at each new place of two was
        came[two.step[o]] = np.arange(m)
        c = two.last[o][came]  # ascending
        run = np.cumsum(np.append(0, c[1:] != c[:-1])) if m else came
        place = run * (m + 1) + came  # ascending, too
        low, high = np.searchsorted(c, one.last[o], "left"), np.searchsorted(c, one.last[o], "right")
        there = low < high
        now = low.astype(np.int64)
        now[there] = np.searchsorted(place, run[low[there]] * (m + 1) + before[there], "left")
        z0, own0 = z, own
        before = np.empty(n, np.int64)
        before[one.step[o]] = now
        z, own = interleave()
        step[o] = _woven(z0, own0, own[one.step[o]].astype(np.int32), np.flatnonzero(~z)[two.step[o]].astype(np.int32))
    return Transform(last, step, _woven(z, own, one.rows, two.rows))


def merge_all(shards: list[Transform]) -> Transform:
    while len(shards) > 1:
        pairs = zip(shards[::2], shards[1::2], strict=False)
        shards = [merge(a, b) for a, b in pairs] + (shards[-1:] if len(shards) % 2 else [])
    return shards[0]


def _least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of values[a + 1 .. b] for each pair a < b."""
    size = b - a
    out, level, table = np.empty(len(a), values.dtype), 0, values
    while True:
        # a window of 2 ** level from each end covers sizes up to twice that
        some = np.flatnonzero((size >> level) == 1)
        if len(some):
            w = 1 << level
            out[some] = np.minimum(table[a[some] + 1], table[b[some] + 1 - w])
        if not (size >> (level + 1)).any():
            return out
        w = 1 << level
        table = np.minimum(table[:-w], table[w:])
        level += 1


def common_symbols(t: Transform) -> np.ndarray:
    """Symbols that each whole string shares with the one before it, from the passes.

    Two neighbours with the same first symbol have one more than the least in common
    between their rests, one place further on.
    """
    n = len(t.rows)
    common = np.zeros(n, np.int32)
    for o in reversed(range(len(t.last))):
        came = np.empty(n, np.int64)
        came[t.step[o]] = np.arange(n)
        c = t.last[o][came]
        same = np.flatnonzero(c[1:] == c[:-1]) + 1
        longer = np.zeros(n, np.int32)
        if len(same):
            longer[same] = 1 + _least_between(common, came[same - 1], came[same])
        common = longer
    return common


def merge_shards(group: np.ndarray, sym: np.ndarray, shards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Strings in order of group and symbols, and the bytes that neighbours have in common.

    -1: neighbours of different groups.
    """
    whole = np.concatenate([group[:, None].astype(np.uint64), sym], axis=1)
    t = merge_all([shard_transform(whole, s) for s in shards])
    common = common_symbols(t).astype(np.int64)
    order, width = t.rows, sym.shape[1]
    out = np.full(len(order), -1, np.int64)
    inner = np.flatnonzero(common > 0)
    k = common[inner] - 1  # without the group
    out[inner] = 8 * k
    cut = inner[k < width]
    k = k[k < width]
    x = sym[order[cut], k] ^ sym[order[cut - 1], k]
    for b in range(1, 8):  # equal leading bytes of the symbols that differ
        out[cut] += x < (np.uint64(1) << np.uint64(64 - 8 * b))
    return order, out


def repeated_starts(group: np.ndarray, before: list[bytes], after: list[bytes], near: np.ndarray, far: np.ndarray, length: int) -> list[np.ndarray]:
    """For each anchor, the distances d in near..far whose string occurs at another anchor."""
    m = len(group)
    shards = [np.arange(i, min(i + SHARD, m)) for i in range(0, m, SHARD)]
    r_order, r_common = merge_shards(group, symbols(after, length), shards)
    l_order, l_common = merge_shards(group, symbols([b[::-1] for b in before], length), shards)
    hit: list[list[int]] = [[] for _ in range(m)]
    r_id, l_id = np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(int(near.min()), int(far.max()) + 1):
        own = np.flatnonzero((near <= d) & (d <= far))
        if len(own) < 2:
            continue
        r_id[r_order] = np.cumsum(r_common < length - d)
        l_id[l_order] = np.cumsum(l_common < d)
        both = r_id[own] * (m + 1) + l_id[own]
        order = np.argsort(both, kind="stable")
        s = both[order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= same[1:].copy()
        for i in own[order[same]].tolist():
            hit[i].append(d)
    return [np.array(x, np.int64) for x in hit]


def _runs(d: np.ndarray) -> list[tuple[int, int]]:
    if not len(d):
        return []
    cut = np.flatnonzero(np.diff(d) != 1)
    return list(zip(d[np.append(0, cut + 1)].tolist(), d[np.append(cut, len(d) - 1)].tolist(), strict=True))


RANGES = "doc_id long, tkey long, s int, e int"


def surroundings(docs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """Each class's bytes, cut from the text of the anchor that stands for it."""
    wanted = classes.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("gram", "n", "kinds", "a", "lo", "hi")).alias("cut"))
    text = F.encode("text", "utf-8")
    return (
        docs.join(wanted, ["doc_id", "tkey"])
        .dropDuplicates(["doc_id", "tkey"])
        .select("doc_id", "tkey", text.alias("raw"), F.explode("cut").alias("c"))
        .select("c.gram", "c.n", "c.kinds", "doc_id", "tkey", "c.a", "c.lo", "c.hi", F.expr(f"substring(raw, c.lo + 1, c.hi - c.lo + {length})").alias("body"))
    )


def merged_ranges(found: DataFrame, length: int) -> DataFrame:
    """Repeated starts of single classes, from the merge within each gram."""

    def resolve(rows: list[tuple]) -> pa.RecordBatch:
        gram = np.array([r[0] for r in rows])
        a, lo, hi = (np.array([r[i] for r in rows]) for i in (4, 5, 6))
        before = [r[7][: x] for r, x in zip(rows, (a - lo).tolist(), strict=True)]
        after = [r[7][x :] for r, x in zip(rows, (a - lo).tolist(), strict=True)]
        got = repeated_starts(np.unique(gram, return_inverse=True)[1], before, after, a - hi, a - lo, length)
        out = [(r[2], r[3], r[4] - y, r[4] - x) for r, d in zip(rows, got, strict=True) if r[1] == 1 for x, y in _runs(d)]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "tkey", "s", "e"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if size >= MERGE_BYTES and row[0] != rows[-1][0]:
                    yield resolve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[7])
        if rows:
            yield resolve(rows)

    return found.repartition("gram").sortWithinPartitions("gram", "doc_id", "a").mapInArrow(run, RANGES)


def counted_ranges(found: DataFrame, length: int) -> DataFrame:
    """The same for hot grams: each string's digest, counted over all classes of all of them."""

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for _, n, doc, key, a, lo, hi, body in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                k = hi - lo + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(body[p : p + length], a - lo - p) for p in range(k)], pa.binary()), pa.array([doc] * k, pa.int64()), pa.array([key] * k, pa.int64()), pa.array(range(lo, hi + 1), pa.int32()), pa.array([n] * k, pa.int64())],
                    names=["digest", "doc_id", "tkey", "s", "n"],
                )

    each = found.mapInArrow(run, "digest binary, doc_id long, tkey long, s int, n long")
    twice = each.groupBy("digest").agg(F.sum("n").alias("times")).where("times > 1")
    return each.where("n = 1").join(twice, "digest").select("doc_id", "tkey", "s", F.col("s").alias("e"))


def ranges(docs: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """(doc_id, tkey, cut): each text's starts s..e of strings that occur elsewhere too."""
    marked = stored(anchors(docs, length), "anchors")
    classes = marked.groupBy("gram", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tkey", "a", "lo", "hi")).alias("rep"))
    shared = stored(classes.select("gram", "ctx", "n", "rep.*"), "classes")
    swept(docs.sparkSession)
    grams = shared.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1")
    full = marked.join(shared.where("n > 1").select("gram", "ctx"), ["gram", "ctx"]).select("doc_id", "tkey", F.col("lo").alias("s"), F.col("hi").alias("e"))
    loose = shared.join(grams.where("kinds > 1").select("gram", "kinds"), "gram")
    bodies = stored(surroundings(docs, loose.select("gram", "n", "kinds", "doc_id", "tkey", "a", "lo", "hi"), length), "surroundings")
    swept(docs.sparkSession)
    few = merged_ranges(bodies.where(F.col("kinds") <= hot).drop("kinds"), length)
    lots = counted_ranges(bodies.where(F.col("kinds") > hot).drop("kinds"), length)
    found = full.unionByName(few).unionByName(lots)
    out = stored(found.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("s", "e")).alias("cut")), "ranges")
    discard(marked, shared, bodies)
    swept(docs.sparkSession)
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage int"


def dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = False, words: int = passages.PASSAGE) -> DataFrame:
    """Per row the digest of what is left; ``with_text`` adds kept (binary).

    shares_passage (0/1): does the text hold ``words`` words in a row that another document
    holds too? Such a passage can be shorter than ``length`` bytes; it is told, not removed.
    """
    rows = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tkey", F.xxhash64("text"))
    # a null doc_id stands as -1 in anchors
    keyed = rows.withColumn("doc", F.coalesce("doc_id", F.lit(-1)))
    plain = keyed.select(F.col("doc").alias("doc_id"), "tkey", "text")
    told = passages.shared(plain, words).select(F.col("doc_id").alias("doc"), "tkey", F.lit(1).alias("shares"))
    swept(docs.sparkSession)
    marks = ranges(plain, length).withColumnRenamed("doc_id", "doc").join(told, ["doc", "tkey"], "full")
    both = keyed.join(marks, ["doc", "tkey"], "left").select("doc_id", "text", "cut", F.coalesce("shares", F.lit(0)).alias("shares"))

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, text, cut, shares in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                kept, at, spans, removed = [], 0, 0, 0
                for s, e in sorted((c["s"], c["e"] + length) for c in cut or ()):
                    if s > at or not spans:
                        kept.append(raw[at:s])
                        spans += 1
                        removed += e - s
                        at = e
                    elif e > at:
                        removed += e - at
                        at = e
                kept.append(raw[at:])
                left = b"".join(kept)
                for col, v in zip(out, (doc, len(raw), removed, spans, hashlib.sha256(left).hexdigest(), shares, left), strict=True):
                    col.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary())
            k = 7 if with_text else 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:k], types[:k], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage", "kept"][:k])

    return both.mapInArrow(run, RESULT + (", kept binary" if with_text else ""))


def op1_bwt_merge_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
