"""Sharding by Hilbert-curve order: quantise metadata, sort by curve index, cut runs.

Everything is DataFrame code. A curve step is a look-up in a small state table, so
the curve index is one fold over the bit planes of the quantised dimensions.

Edge cases: a null text has size 16 and the CRC of the empty string; null metadata
gets its own bucket (0); a row without doc_id is a row like any other, the first of its
cell; ties in the order go by doc_id, CRC and size, and rows alike in all three are
interchangeable; repeated rows are rows of their own and get slots of their own; a text of
any length is read for its size and CRC only; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waygraph.llm.common import free, only

OVERHEAD = 16
#: Sub-buckets of a curve cell, so that no cell, however full, is ranked by one task.
SUB = 1024


@lru_cache
def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """Digit and next state for each (state, corner) of a Hilbert curve in ``dims`` dimensions.

    A state is (entry corner, axis). Child cells follow the reflected Gray code seen
    through that state; states are numbered as they are first met from (0, 0).
    """
    full = (1 << dims) - 1

    def left(x: int, n: int) -> int:
        n %= dims
        return ((x << n) | (x >> (dims - n))) & full

    def right(x: int, n: int) -> int:
        return left(x, dims - n % dims)

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def ungray(g: int) -> int:
        i = 0
        while g:
            i, g = i ^ g, g >> 1
        return i

    def ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    def entry(i: int) -> int:
        return 0 if i == 0 else gray(2 * ((i - 1) // 2))

    def turn(i: int) -> int:
        if i == 0:
            return 0
        return ones(i - 1 if i % 2 == 0 else i) % dims

    number, queue = {(0, 0): 0}, [(0, 0)]
    digit, following = [], []
    for e, d in queue:
        for corner in range(1 << dims):
            i = ungray(right(corner ^ e, d + 1))
            nxt = (e ^ left(entry(i), d + 1), (d + turn(i) + 1) % dims)
            if nxt not in number:
                number[nxt] = len(queue)
                queue.append(nxt)
            digit.append(i)
            following.append(number[nxt])
    return digit, following


def curve_index(coords: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of integer coordinates of ``bits`` bits each."""
    dims = len(coords)
    digit, following = curve_tables(dims)
    digits = F.array(*[F.lit(x) for x in digit])
    states = F.array(*[F.lit(x) for x in following])
    corners = F.array(
        *[
            sum(
                (F.shiftright(c, bit).bitwiseAND(F.lit(1)) * (1 << k) for k, c in enumerate(coords)),
                F.lit(0),
            ).cast("int")
            for bit in reversed(range(bits))
        ]
    )
    return F.aggregate(
        corners,
        F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("at")),
        lambda acc, c: F.struct(
            F.get(states, acc["state"] * (1 << dims) + c).alias("state"),
            (acc["at"] * (1 << dims) + F.get(digits, acc["state"] * (1 << dims) + c)).alias("at"),
        ),
        lambda acc: acc["at"],
    )


def curve_path(dims: int, bits: int) -> list[tuple[int, ...]]:
    """All cells in curve order (plain Python, for tests)."""
    digit, following = curve_tables(dims)
    out = {}
    for cell in product(range(1 << bits), repeat=dims):
        state = at = 0
        for b in reversed(range(bits)):
            c = sum(((x >> b) & 1) << k for k, x in enumerate(cell))
            at = (at << dims) | digit[state * (1 << dims) + c]
            state = following[state * (1 << dims) + c]
        out[at] = cell
    return [out[i] for i in sorted(out)]


def _number(name: Column, skip: int) -> Column:
    """The seven bytes after the first ``skip`` as a number, in the order of names."""
    return F.conv(F.rpad(F.hex(F.substring(name.cast("binary"), skip + 1, 7)), 14, "0"), 16, 10).cast("long")


def name_cuts(rows: DataFrame, column: str, bits: int) -> tuple[int, list[int]]:
    """Bytes that all names begin with, and at most 2**bits - 2 numbers that part the distinct names evenly."""
    ends = rows.agg(F.min(column), F.max(column)).first()
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in ends]
    skip = len(os.path.commonprefix(raw))
    top = (1 << bits) - 1
    names = rows.select(_number(F.col(column), skip).alias("n")).where("n IS NOT NULL").distinct()
    cuts = names.agg(F.percentile_approx("n", [i / top for i in range(1, top)], 10000)).first()[0]
    return skip, sorted(set(cuts or []))


def buckets(rows: DataFrame, bits: int) -> list[Column]:
    """Quantised metadata in its own order: source, language, log size. Nulls go to bucket 0.

    Neighbouring buckets hold neighbouring names, so a file's range of names is narrow.
    """
    top = (1 << bits) - 1

    def name(column: str) -> Column:
        skip, cuts = name_cuts(rows, column, bits)
        if not cuts:
            return F.when(F.col(column).isNull(), 0).otherwise(1)
        number = _number(F.col(column), skip)  # the same expression each time and outside any branch: evaluated once a row
        return F.coalesce(sum(((F.lit(c) < number).cast("int") for c in cuts), F.lit(1)), F.lit(0))

    # about three buckets for each doubling of the size
    size = F.least(F.lit(top), F.floor(F.log2(F.col("size").cast("double")) * 1.25).cast("int"))
    return [name("source"), name("lang"), size]


def shard(docs: DataFrame, shards: int = 40, bits: int = 5, key: bool = False) -> DataFrame:
    """Rows of ``docs`` with shard and slot under law ``rows``: counts differ by one at most.

    The rows' order is (curve index, sub-bucket, doc_id, text CRC). A row's place in
    it is the rows in earlier cells (a table of at most 2**(3 * bits) cells) plus
    those in earlier sub-buckets of its cell (at most ``SUB``) plus its rank in its
    sub-bucket; shard and slot follow from the place and the total alone. ``key`` adds
    text_key, the text's hash.
    """
    rows = only(docs, "doc_id", "text", "source", "lang").select(
        "doc_id",
        "source",
        "lang",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"),
    )
    rows = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        *(["text_key"] if key else []),
        curve_index(buckets(rows, bits), bits).alias("curve"),
    ).withColumn("sub", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SUB)).cast("int"))
    # one exchange: counting and ranking both read it
    rows = rows.repartition("curve", "sub")

    subs = rows.groupBy("curve", "sub").agg(F.count("*").alias("n"))
    cells = subs.groupBy("curve").agg(F.sum("n").alias("cell_n"))
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    # bounded by the number of curve cells, not by the input
    cells = cells.select(
        "curve",
        F.coalesce(F.sum("cell_n").over(before), F.lit(0)).alias("cell_at"),
        F.sum("cell_n").over(everywhere).alias("total"),
    )
    within = Window.partitionBy("curve").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        subs.withColumn("sub_at", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(cells, "curve")
        .select("curve", "sub", (F.col("cell_at") + F.col("sub_at")).alias("start"), "total")
    )
    rank = F.row_number().over(Window.partitionBy("curve", "sub").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("rank", rank).join(starts, ["curve", "sub"])
    place = F.col("start") + F.col("rank") - 1
    k = F.expr(f"cast(((start + rank - 1) * {shards}) div total as int)")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        k.alias("shard"),
        (place - F.ceil(k * F.col("total") / F.lit(shards)).cast("long")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("curve").alias("curve_index"),
        *(["text_key"] if key else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, bits: int = 5, parts: int = 8) -> None:
    """All rows of ``docs``, with their columns, in their shards: one folder each, files in curve order.

    Rows are known by doc_id and text (null-safe); rows alike in both are one another's
    copies, so it doesn't matter which of them gets which slot. ``parts``: files of a shard.
    """
    shard_, slot, key, nth, own_key, own_nth, doc = free(docs, "shard", "slot", "key_", "nth_", "own_key_", "own_nth_", "doc_")
    hash_ = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    # the nth row of those with the same doc_id and text
    rows = docs.withColumn(own_key, hash_).withColumn(own_nth, F.row_number().over(Window.partitionBy("doc_id", own_key).orderBy(F.lit(0))))
    at = shard(docs, shards, bits, key=True)
    at = at.select(
        F.col("doc_id").alias(doc),
        F.col("text_key").alias(key),
        F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("shard", "slot")).alias(nth),
        F.col("shard").alias(shard_),
        F.col("slot").alias(slot),
    )
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own_key) == F.col(key)) & (F.col(own_nth) == F.col(nth))
    both = rows.join(at, same).select(*[F.col(f"`{c}`") for c in docs.columns], shard_, slot)
    both.repartitionByRange(shards * parts, shard_, slot).sortWithinPartitions(shard_, slot).write.partitionBy(shard_).parquet(path)


def op6_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
