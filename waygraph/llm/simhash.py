"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are dealt into parts of correlated bits. If two fingerprints differ in at
most tau bits, then for thresholds that sum to tau - m + 1 over m parts (-1: the part is
not looked at) some part differs in at most its threshold. Which parts, and which
thresholds, is a dynamic programme on the candidate pairs that each choice would give,
counted over all fingerprints. Fingerprints that share a probe key of a part are compared
exactly, and each group of them gives links that connect what it connects.

Only distinct fingerprints are probed, so equal texts cost nothing after the first. A
group of more than ``GROUP`` fingerprints is compared in pairs of blocks, each a task's.

Edge cases: a null or wordless text has fingerprint zero and links like any other; a row
without doc_id takes part but gives no component id; repeated rows are rows of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.llm import alike
from waygraph.llm.common import free, only, stored, swept
from waygraph.operators.graph import connected_components

BITS, SEED = 64, 42
GROUP = 8192
SMALL = 16
#: Bits that a probe looks at, at least; with fewer it would compare all with all.
LEAST_BITS = 8
#: Seconds for a compared pair and for a probe key, roughly; only their ratio matters.
PAIR_COST, KEY_COST = 4e-9, 2e-6


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit i is 1 if it is set in over half the shingles' XXH64 (repeats included)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both: ASCII only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=False)], np.uint64)
    half = len(hashes)
    count = np.zeros(BITS, np.int64)
    for at in range(0, half, 1 << 16):  # 64 bytes a shingle
        block = hashes[at : at + (1 << 16)]
        count += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > half, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and node, what counts as one text: fp."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps), pa.array(fps)], names=["doc_id", "fp", "node"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long, node long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often each two bits are set together: 64 x 64 numbers."""

    def run(batches):
        total, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            b = _bits(batch.column("fp").to_numpy()).astype(np.float32)
            total += len(b)
            for at in range(0, len(b), 1 << 15):
                both += b[at : at + (1 << 15)].T @ b[at : at + (1 << 15)]
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(j, -1).astype(np.int32)), pa.array(np.append(both[i, j], total).astype(np.int64))],
            names=["i", "j", "n"],
        )

    rows = fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, total = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["i"] < 0:
            total = r["n"]
        else:
            both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["n"]
    return total, both


def deal(total: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of equal width; each grows by the bit that is most correlated with it."""
    p = np.diag(both) / max(total, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(total, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        part = [max(left, key=lambda b: (corr[b, list(left)].sum(), -b))]
        left.discard(part[0])
        while len(part) < size:
            nxt = max(left, key=lambda b: (corr[b, part].mean(), -b))
            part.append(nxt)
            left.discard(nxt)
        parts.append(sorted(part))
    return parts


def _value(bits: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(bits), np.int64)
    for k, b in enumerate(part):
        out |= bits[:, b].astype(np.int64) << k
    return out


def collisions(fps: DataFrame, plans: dict[int, list[list[int]]]) -> dict[tuple[int, int], float]:
    """Pairs with equal value, for each part of each plan, counted over all fingerprints."""
    flat = [(m, k, part) for m, parts in plans.items() for k, part in enumerate(parts)]

    def run(batches):
        for batch in batches:
            bits = _bits(batch.column("fp").to_numpy())
            for at, (_, _, part) in enumerate(flat):
                values, n = np.unique(_value(bits, part), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), at, np.int32)), pa.array(values), pa.array(n.astype(np.int64))], names=["part", "value", "n"])

    rows = (
        fps.select("fp")
        .mapInArrow(run, "part int, value long, n long")
        .groupBy("part", "value")
        .agg(F.sum("n").cast("double").alias("n"))
        .groupBy("part")
        .agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
        .collect()
    )
    return {flat[r["part"]][:2]: r["pairs"] for r in rows}


def part_cost(total: int, pairs: float, ratios: np.ndarray, threshold: int) -> float:
    """Cost of probing one part at a threshold; ratios: odds that a bit differs in a pair.

    At threshold t the keys are the part with each t bits left out, so a pair meets once
    for every choice that covers its differing bits.
    """
    if threshold < 0:
        return 0.0
    w = len(ratios)
    if threshold > w - LEAST_BITS:  # too few bits left to tell fingerprints apart
        return float("inf")
    keys, met = 1.0, 1.0
    for t in range(threshold):
        keys *= (w - t) / (t + 1)
    if threshold:
        e = np.zeros(threshold + 1)
        e[0] = 1
        for r in ratios:
            e[1:] += e[:-1] * (1 + r)
        met = e[threshold]  # sum over left-out sets of the product of (1 + r)
    return KEY_COST * total * keys + PAIR_COST * pairs * met


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up with the given sum at the least cost, by dynamic programming.

    ``costs[i][t + 1]`` is part i's cost at threshold t.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (cost, chosen) in best.items():
            for at, c in enumerate(row):
                key, new = done + at - 1, (cost + c, [*chosen, at - 1])
                if key not in step or new < step[key]:
                    step[key] = new
        best = step
    return best[total]


def choose(fps: DataFrame, tau: int) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds of the cheapest plan of two to six parts."""
    total, both = bit_counts(fps)
    plans = {m: deal(total, both, m) for m in range(2, 7)}
    pairs = collisions(fps, plans)
    p = np.diag(both) / max(total, 1)
    differ = np.clip(2 * p * (1 - p), 1e-9, 0.5)
    odds = differ / (1 - differ)
    found = []
    for m, parts in plans.items():
        need = tau - m + 1
        costs = [[part_cost(total, pairs.get((m, k), 0.0), odds[part], t) for t in range(-1, tau + 1)] for k, part in enumerate(parts)]
        cost, chosen = allocate(costs, need)
        found.append((cost, m, chosen))
    _, m, chosen = min(found)
    return plans[m], chosen


def probe_bits(parts: list[list[int]], thresholds: list[int]) -> list[list[int]]:
    """The bits that each probe looks at: a part without each choice of as many bits as its threshold."""
    return [[b for b in part if b not in out] for part, t in zip(parts, thresholds, strict=True) if t >= 0 for out in combinations(part, t)]


def probe_keys(fps: DataFrame, probes: list[list[int]]) -> DataFrame:
    """(fp, node, probe, value): the value of each probe's bits."""

    def run(batches):
        for batch in batches:
            fp, node = batch.column("fp").to_numpy(), batch.column("node").to_numpy()
            for at in range(0, len(fp), 1 << 14):
                block, own = fp[at : at + (1 << 14)], pa.array(node[at : at + (1 << 14)])
                bits = _bits(block)
                for k, part in enumerate(probes):
                    yield pa.RecordBatch.from_arrays([pa.array(block), own, pa.array(np.full(len(block), k, np.int32)), pa.array(_value(bits, part))], names=["fp", "node", "probe", "value"])

    return fps.select("fp", "node").mapInArrow(run, "fp long, node long, probe int, value long")


def _forest(fp: np.ndarray, block: np.ndarray, tau: int) -> tuple[list[int], list[int]]:
    """Links that connect what is connected in a group; blocks differ: only across them."""
    label = np.arange(len(fp))
    across = (block != block[0]).any()
    a, b = [], []
    for i in range(len(fp)):
        near = np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= tau
        if across:
            near &= block[i + 1 :] != block[i]
        others = label[i + 1 :][near]
        if len(others) and (others != label[i]).any():
            for other in np.unique(others[others != label[i]]):
                j = i + 1 + int(np.flatnonzero(near & (label[i + 1 :] == other))[0])
                a.append(i)
                b.append(j)
                label[label == other] = label[i]
    return a, b


def _first_meeting(differ: np.ndarray, probe: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Is ``probe`` the first of the probes at which a pair with these differing bits meets?"""
    met = np.full(len(differ), len(masks), np.int64)
    for k in range(len(masks) - 1, -1, -1):
        met[(differ & masks[k]) == 0] = k
    return met == probe


def links(keys: DataFrame, tau: int, probes: list[list[int]], group: int = GROUP) -> DataFrame:
    """Links (u, v) of nodes that share a probe key and differ in at most ``tau`` bits.

    Small groups give all their links, larger ones a spanning forest of them. A pair that
    meets at several probes is linked at the first: there it is connected.
    """
    masks = np.array([sum(1 << b for b in p) for p in probes], np.uint64)
    sizes = keys.groupBy("probe", "value").agg(F.count("*").alias("n")).where(F.col("n") > group)
    blocks = F.coalesce(F.ceil(F.col("n") / F.lit(group / 2)).cast("int"), F.lit(1))
    dealt = (
        keys.join(sizes, ["probe", "value"], "left")
        .withColumn("k", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        # each two blocks meet, and each block meets itself
        .select("fp", "node", "probe", "block", F.xxhash64("probe", "value", F.least("block", "other"), F.greatest("block", "other")).alias("key"))
    )

    def flush(key, fp, node, probe, block):
        if not len(key):
            return None
        u, v = [], []

        def put(a, b):
            good = _first_meeting(fp[a] ^ fp[b], probe[a], masks)
            u.append(node[a[good]])
            v.append(node[b[good]])

        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(cut)
        few = np.flatnonzero(np.repeat(size <= SMALL, size))
        k, f = key[few], fp[few]
        for o in range(1, min(SMALL, len(k))):
            hit = np.flatnonzero((k[o:] == k[:-o]) & (np.bitwise_count(f[o:] ^ f[:-o]) <= tau))
            put(few[hit + o], few[hit])
        for at, count in zip(cut[:-1][size > SMALL], size[size > SMALL], strict=True):
            a, b = _forest(fp[at : at + count], block[at : at + count], tau)
            put(np.array(a, np.int64) + at, np.array(b, np.int64) + at)
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
        return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], names=["u", "v"])

    def run(batches):
        rest = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        for batch in batches:
            cols = tuple(batch.column(c).to_numpy() for c in ("key", "fp", "node", "probe", "block"))
            cols = tuple(np.concatenate((x, y.view(np.uint64) if i == 1 else y)) for i, (x, y) in enumerate(zip(rest, cols, strict=True)))
            last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last group may go on
            if last and (out := flush(*(c[:last] for c in cols))) is not None:
                yield out
            rest = tuple(c[last:] for c in cols)
        if (out := flush(*rest)) is not None:
            yield out

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def components(docs: DataFrame, tau: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fp and component_id (least doc_id reachable over links) for every row."""
    rows = stored(fingerprints(docs, width), "simhash")
    nodes = stored(rows.groupBy("node", "fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    parts, thresholds = choose(nodes, tau)
    probes = probe_bits(parts, thresholds)
    found = connected_components(links(probe_keys(nodes, probes), tau, probes))
    named = nodes.join(found, nodes["node"] == found["id"], "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = stored(named.join(roots, "root").select("node", "component_id"), "simhash-components")
    return rows.join(by_node, "node").select("doc_id", "fp", "component_id")


def proposals(docs: DataFrame, tau: int = 3, width: int = 5) -> DataFrame:
    """(u, v): keys of texts whose fingerprints over ``width``-word shingles are linked."""
    # copies are told apart after the fingerprint, so that no text is moved
    rows = fingerprints(docs.select(alike.text_key().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), width).dropDuplicates(["doc_id"])
    nodes = stored(rows.select("fp", F.col("doc_id").alias("node")), "simhash-texts")
    parts, thresholds = choose(nodes, tau)
    probes = probe_bits(parts, thresholds)
    return links(probe_keys(nodes, probes), tau, probes)


def one_of_each(docs: DataFrame, similarity: float = 0.8, width: int = 5, by_fingerprint: bool = False) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of least doc_id.

    Texts are linked whose ``width``-word shingle sets have this Jaccard similarity. The
    SimHash probes propose most of them; as few differing bits miss copies that are cut or
    lengthened, an exact set join (``alike``) finds the others, and decides on all.
    ``by_fingerprint``: texts that ``components`` links (fingerprints of 3-word shingles, 3
    differing bits) are in one group too, whatever the set join says. A row is known by doc_id
    and text, so texts that share a doc_id are told apart; a group without any doc_id keeps
    one row too.
    """
    doc, key, own = free(docs, "doc_", "key_", "own_")
    near = {"linked": proposals(docs, width=3)} if by_fingerprint else {"proposed": proposals(docs, width=width)}
    rows = docs.select("doc_id", alike.text_key().alias("node"))
    named = rows.join(alike.groups(docs, similarity, width, **near), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    kept = named.groupBy("root").agg(first).select(F.col("first.doc_id").alias(doc), F.col("first.node").alias(key))
    same = (alike.text_key() == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(doc))
    kept = stored(kept, "near-kept")
    swept(docs.sparkSession)
    one = docs.withColumn(own, alike.text_key()).join(kept, same, "left_semi").dropDuplicates([own])
    return one.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_simhash_pigeonhole(spark, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
