"""Toxicity by classifier chains: each category's model also sees the earlier categories.

The categories run from part to whole: ``insult`` (a marker word occurs in a toxic
text), ``severe`` (markers are dense in it), ``toxic`` (the label, which decides). Only
the last is labelled; the first two are read off the training rows' labels and the
markers found there. Models are logistic, over words and word beginnings. A model further
down the chain is trained on out-of-fold probabilities of the earlier ones, so that it
learns how far to trust them.

Fitting takes at most ``TRAIN_ROWS`` labelled rows (those of least hash) and ``TERMS``
features; scoring covers every row and its whole text.

Edge cases: a null or wordless text has only the intercepts' probability and, like
everything when no row or only one class is labelled, is not toxic; repeated rows get equal scores, and a
probability of just the threshold is toxic; a row without doc_id is scored like any other
but trains nothing; a text of any length is scored whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygraph.llm.common import only, stored

TRAIN_ROWS, TERMS, FOLDS = 8000, 512, 5
CATEGORIES = ("insult", "severe", "toxic")
WORD = re.compile(r"[^\W\d_]+")
MIN_HEAD, MAX_HEAD = 3, 8
CACHE = 300_000
#: Words longer than this count as the term of their beginning only.
LONG = 64


def terms(word: str) -> list[str]:
    """A word's features: itself (marked by =) and its beginnings."""
    return [f"={word[:LONG]}", *(word[:n] for n in range(MIN_HEAD, min(MAX_HEAD, len(word) - 1) + 1))]


def counted(text: str | None) -> tuple[Counter, int]:
    words = WORD.findall((text or "").lower())
    return Counter(words), len(words)


def vocabulary(sample: DataFrame, size: int) -> list[str]:
    """Terms that mark toxic rows: greatest z of the difference in document frequency."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # terms: null counts the rows
        yes, no = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                found = {t for w in counted(text)[0] for t in terms(w)}
                (yes if y else no).update(found)
                (yes if y else no)[None] += 1
        keys = list(yes.keys() | no.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([yes[k] for k in keys], pa.int64()), pa.array([no[k] for k in keys], pa.int64())], names=["term", "yes", "no"])

    found = stored(sample.select("text", "y").mapInArrow(run, "term string, yes long, no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")), "terms")
    total = found.where("term IS NULL").first()
    if total is None or not total["yes"] or not total["no"]:
        return []
    n1, n0 = float(total["yes"]), float(total["no"])
    share = (F.col("yes") + F.col("no")) / (n1 + n0)
    z = (F.col("yes") / n1 - F.col("no") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-9)
    best = found.where("term IS NOT NULL").withColumn("z", z).where("z > 3").orderBy(F.col("z").desc(), "term").limit(size)
    return [r["term"] for r in best.collect()]


def _matrix(sample: DataFrame, vocab: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (count / sqrt(words + 1)), labels and fold numbers of the bounded sample."""
    place = {t: i for i, t in enumerate(vocab)}

    def run(batches):
        for batch in batches:
            at, value = [], []
            for text in batch.column("text").to_pylist():
                words, n = counted(text)
                row: Counter = Counter()
                for w, k in words.items():
                    for t in terms(w):
                        if t in place:
                            row[place[t]] += k
                at.append(list(row))
                value.append([k / math.sqrt(n + 1) for k in row.values()])
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("fold"), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float64()))], names=["y", "fold", "at", "value"])

    rows = sample.select("text", "y", "fold").mapInArrow(run, "y int, fold int, at array<int>, value array<double>").collect()
    rows.sort(key=lambda r: (r["fold"], r["y"], r["at"], r["value"]))
    x = np.zeros((len(rows), len(vocab)), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["value"]
    return x, np.array([r["y"] for r in rows], np.float64), np.array([r["fold"] for r in rows])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 3.0) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by adaptive gradient steps on standardised columns."""
    n = max(len(y), 1)
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), -10.0 if not len(y) or y.max() == 0 else 10.0
    scale = x.std(axis=0) + 1e-6
    xs = x / scale
    w, b = np.zeros(x.shape[1]), math.log(y.mean() / (1 - y.mean()))
    gw, gb = np.full(x.shape[1], 1e-3), 1e-3
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(xs @ w.astype(np.float32) + b))) - y
        g = xs.T @ e.astype(np.float32) / n + ridge * w / n
        gw += g * g
        gb += e.mean() ** 2
        w = w - 0.3 * g / np.sqrt(gw)
        b -= 0.3 * e.mean() / math.sqrt(gb)
    return w / scale, float(b)


def _proba(x: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50)))


def categories(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Targets of the chain, from the labels and how dense the marker terms are."""
    mass = x.sum(axis=1)
    toxic = y > 0
    middle = np.median(mass[toxic]) if toxic.any() else 0.0
    return np.stack([toxic & (mass > 0), toxic & (mass > middle), toxic], axis=1).astype(float)


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each category: weights of terms, of earlier categories' probabilities, intercept."""
    targets, chain = categories(x, y), []
    earlier = np.zeros((len(y), 0), np.float32)
    for c in range(targets.shape[1]):
        full = np.hstack([x, earlier])
        held = np.zeros(len(y))
        for f in np.unique(fold):
            out = fold == f
            held[out] = _proba(full[out], *logistic(full[~out], targets[~out, c]))
        w, b = logistic(full, targets[:, c])
        chain.append((w[: x.shape[1]], w[x.shape[1] :], b))
        earlier = np.hstack([earlier, held[:, None].astype(np.float32)])
    return chain


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TERMS) -> dict:
    """The fitted chain, as plain numbers."""
    chosen = only(labels, "doc_id", "toxic").where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it can be broadcast
    sample = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # a repeated row is one training row
    sample = sample.dropDuplicates(["doc_id"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).cast("int").alias("y"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"))
    sample = stored(sample, "toxicity-sample")
    vocab = vocabulary(sample, size)
    if not vocab:
        return {"weights": {}, "links": [[0.0] * c for c in range(len(CATEGORIES))], "bias": [-10.0] * len(CATEGORIES)}
    chain = fit_chain(*_matrix(sample, vocab))
    return {
        "weights": {t: tuple(float(w[i]) for w, _, _ in chain) for i, t in enumerate(vocab)},
        "links": [v.tolist() for _, v, _ in chain],
        "bias": [b for _, _, b in chain],
    }


class Scorer:
    """Probabilities of a text; what a word adds to each sum is kept."""

    def __init__(self, model: dict):
        self.model, self.known = model, {}

    def word(self, w: str):
        if len(self.known) >= CACHE:
            self.known.clear()
        weights = self.model["weights"]
        hit = [weights[t] for t in terms(w) if t in weights]
        self.known[w[:LONG] if len(w) > LONG else w] = got = tuple(map(sum, zip(*hit, strict=True))) if hit else None
        return got

    def __call__(self, text: str | None) -> list[float]:
        words, n = counted(text)
        sums, known = [0.0] * len(self.model["bias"]), self.known
        for w, k in words.items():
            add = known[w] if w in known else self.word(w)
            if add:
                for c, v in enumerate(add):
                    sums[c] += k * v
        out: list[float] = []
        for s, link, b in zip(sums, self.model["links"], self.model["bias"], strict=True):
            z = s / math.sqrt(n + 1) + b + sum(a * p for a, p in zip(link, out, strict=True))
            out.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
        return out


def score(docs: DataFrame, model: dict, keep: bool = False, threshold: float = 0.5) -> DataFrame:
    """doc_id, a probability for each category, and toxic (0/1).

    ``keep``: instead the rows of ``docs`` that are not toxic, with their columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            p = np.array([scorer(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(CATEGORIES))
            toxic = p[:, -1] >= threshold
            if keep:
                yield batch.filter(pa.array(~toxic))
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(p[:, c]) for c in range(p.shape[1])), pa.array(toxic.astype(np.int32))],
                names=["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"],
            )

    if keep:
        return docs.mapInArrow(run, docs.schema)
    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, " + "".join(f"p_{c} double, " for c in CATEGORIES) + "toxic int")


def op3_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
