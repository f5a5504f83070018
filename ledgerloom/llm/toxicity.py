"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document's features are the hashed 3- to 5-grams of its distinct lower-cased words
(ends marked), counted once for each word. Each feature is scaled by the log ratio of
the smoothed shares of toxic and of other training documents that have it, drawn
towards 0 by some standard errors, which leaves the features that are sure to tell the classes
apart. Logistic regression on the scaled features is fitted with numpy by full-batch Adam with an L2 penalty.
How many standard errors is chosen from ``SURE`` by cross-validation in ``FOLDS`` parts of the
training rows alone: the least balanced error, then the least balanced log loss.

The fit takes a bounded sample of labelled rows: up to ``CAP`` documents of each
class, of every length. Spark counts documents by fold, bucket and class and tests which features are sure; the driver gets
the sums of those (at most 2**``BITS`` rows) and then the sample's counts of them, never texts.
Scores cover every row and whole texts; null and empty texts get the intercept's
score. With one class or none in training every score is the class share (0.0 without
labels). Repeated rows are scored alike; equal inputs give equal models however they are
partitioned; extra columns are not read by ``score``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .subwords import LONG, WordMemo, in_pieces, ngrams, training_sample

ORDERS, BITS = (3, 4, 5), 20
#: Most documents of a class in the training sample.
CAP = 2000
EPOCHS, RATE, PENALTY, SMOOTH = 60, 0.05, 2e-4, 4.0
#: Strengths to choose from, and parts of the cross-validation.
SURE, FOLDS = (2.0, 3.0, 4.0), 3
SLICE_BYTES = 2 << 20
#: Features in one step of a sum on the driver.
BLOCK = 1 << 16


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def grams_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, in order, and how many of its distinct words have each n-gram."""
    return np.unique(ngrams(sorted(words_of(text)), ORDERS, BITS)[0], return_counts=True)


def sure_counts(sample: DataFrame, docs: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """The buckets, in order, whose ratio is sure in the whole sample or without one fold, and their documents [fold, class, bucket].
    Spark sums and tests them, so the driver gets the sure ones only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            got = [grams_of(t)[0] for t in part.column("text").to_pylist()]
            group = part.column("fold").to_numpy() * 2 + part.column("y").to_numpy()
            both, n = np.unique(np.repeat(group.astype(np.int64), list(map(len, got))) << BITS | np.concatenate([*got, np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((both & (1 << BITS) - 1).astype(np.int32)), pa.array((both >> BITS).astype(np.int32)), pa.array(n)], ["bucket", "part", "n"])

    names = [[f"n{k}{c}" for c in (0, 1)] for k in range(FOLDS)]
    sums = [F.sum(F.when(F.col("part") == k * 2 + c, F.col("n")).otherwise(0)).cast("int").alias(names[k][c]) for k in range(FOLDS) for c in (0, 1)]
    tests = F.lit(False)
    for left_out in (None, *range(FOLDS)):
        used = [k for k in range(FOLDS) if k != left_out]
        classes = docs[used].sum(axis=0)
        if classes.all():
            share = float(classes[1] / classes.sum())
            toxic, other = (sum((F.col(names[k][c]) for k in used), F.lit(SMOOTH * p)) for c, p in ((1, share), (0, 1 - share)))
            gap = F.abs(F.log(toxic / share) - F.log(other / (1 - share)))
            tests |= gap > sure * F.sqrt(1 / toxic + 1 / other)
    found = sample.mapInArrow(run, "bucket int, part int, n bigint").groupBy("bucket").agg(*sums).where(tests).toArrow().sort_by("bucket")
    counts = np.array([found.column(n).to_numpy() for both in names for n in both]).reshape(FOLDS, 2, -1)
    return found.column("bucket").to_numpy(), counts


def ratios(counts: np.ndarray, docs: np.ndarray, sure: float) -> np.ndarray:
    """Log-count ratio of each bucket from documents [class, bucket] and [class], drawn towards 0 by ``sure`` standard errors."""
    share = docs[1] / docs.sum()
    toxic, other = counts[1] + SMOOTH * share, counts[0] + SMOOTH * (1 - share)  # pseudo-counts in the classes' proportion
    ratio = np.log(toxic / share) - np.log(other / (1 - share))
    # only what is sure of a ratio counts: the many features that tell nothing would outweigh a few clear ones in long texts
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - sure * np.sqrt(1 / toxic + 1 / other))


def told_features(sample: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """(y, fold, row, number, count) of the sample's documents in order of id: ``number`` is a place in ``wanted``, buckets in order."""
    sent = sample.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << BITS, -1, np.int32)
        number[sent.value] = np.arange(len(sent.value))
        for part in slices(batches, "text", SLICE_BYTES):
            found = [(number[a], c) for a, c in map(grams_of, part.column("text").to_pylist())]
            lists = [pa.array([x[n >= 0].astype(np.int32) for n, x in both], pa.list_(pa.int32())) for both in ([(n, n) for n, _ in found], found)]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("y"), part.column("fold"), *lists], ["key", "y", "fold", "numbers", "counts"])

    got = sample.mapInArrow(run, "key string, y int, fold int, numbers array<int>, counts array<int>").toArrow()
    order = pc.sort_indices(got.column("key"))
    y, fold = (got.column(c).take(order).to_numpy() for c in ("y", "fold"))
    sizes = pc.list_value_length(got.column("numbers")).take(order).to_numpy()
    number, count = (got.column(c).take(order).combine_chunks().flatten().to_numpy() for c in ("numbers", "counts"))
    return y.astype(np.float64), fold, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), number, count


def blocks(n: int) -> Iterator[slice]:
    return (slice(at, at + BLOCK) for at in range(0, n, BLOCK))


def summed(row: np.ndarray, number: np.ndarray, count: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Sum of count times weight for each of ``n`` documents, in blocks, so that no temporary is as long as the features."""
    return sum((np.bincount(row[at], count[at] * w[number[at]], n) for at in blocks(len(row))), np.zeros(n))


def regression(y: np.ndarray, used: np.ndarray, row: np.ndarray, number: np.ndarray, count: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each bucket (its ratio times its coefficient) and the intercept from the ``used`` documents, both classes weighing the same."""
    width = len(ratio)
    told = used[row] & (ratio != 0)[number]
    row, number, count = row[told], number[told], count[told]
    w, b = np.zeros(width), 0.0
    toxic = y[used].mean()
    balance = used * np.where(y == 1, 0.5 / toxic, 0.5 / (1 - toxic)) / used.sum()
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, EPOCHS + 1):
        z = summed(row, number, count, ratio * w, len(y)) + b
        slope = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * balance
        g = ratio * sum((np.bincount(number[at], count[at] * slope[row[at]], width) for at in blocks(len(row))), np.zeros(width)) + PENALTY * w
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w = w - rate * m / (np.sqrt(v) + 1e-8)
        b = b - rate * mb / (np.sqrt(vb) + 1e-8)
    return w * ratio, float(b)


def validated(counts: np.ndarray, docs: np.ndarray, y: np.ndarray, fold: np.ndarray, row: np.ndarray, number: np.ndarray, count: np.ndarray) -> float:
    """The strength of ``SURE`` with the least balanced error on the folds left out."""
    results = []
    for sure in SURE:
        error = loss = 0.0
        for k in range(FOLDS):
            out = fold == k
            rest = docs.sum(axis=0) - docs[k]
            if not rest.all() or not out.any():
                continue
            w, b = regression(y, ~out, row, number, count, ratios(counts.sum(axis=0) - counts[k], rest, sure))
            z = (summed(row, number, count, w, len(y)) + b)[out]
            weight = np.where(y[out] == 1, 0.5 / max(docs[:, 1].sum(), 1), 0.5 / max(docs[:, 0].sum(), 1))
            error += ((z >= 0) != (y[out] == 1)) @ weight
            loss += np.logaddexp(0, np.where(y[out] == 1, -z, z)) @ weight
        results.append((round(error, 9), loss, sure))
    return min(results)[2]


def fit(sample: DataFrame) -> dict:
    """Weight of each bucket, the intercept and the strength chosen, from (doc_id, text, y)."""
    keyed = sample.select(F.col("doc_id").cast("string").alias("key"), "text", "y", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    docs = np.zeros((FOLDS, 2))
    for r in keyed.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect():
        docs[r["fold"], r["y"]] = r["n"]
    classes = docs.sum(axis=0)
    if not classes.all():
        share = classes[1] / max(classes.sum(), 1)
        return {"weights": np.zeros(1 << BITS, np.float32), "bias": float(np.log((share + 1e-6) / (1 - share + 1e-6))), "sure": None}
    wanted, counts = sure_counts(keyed, docs, min(SURE))
    y, fold, row, number, count = told_features(keyed, wanted)
    sure = validated(counts, docs, y, fold, row, number, count)
    weights = np.zeros(1 << BITS, np.float32)
    weights[wanted], bias = regression(y, np.ones(len(y), bool), row, number, count, ratios(counts.sum(axis=0), classes, sure))
    return {"weights": weights, "bias": bias, "sure": sure}


def scorer(model: dict) -> Callable[[list[str | None]], np.ndarray]:
    """Scores of lists of texts, for use in a task; words seen before cost one look-up."""
    weights, bias = model["weights"], model["bias"]

    def of(words: list[str]) -> np.ndarray:
        bucket, owner = ngrams(words, ORDERS, BITS)
        return np.bincount(owner, weights[bucket], len(words))[:, None]

    memo = WordMemo(of, 1)

    def alone(text: str) -> float:
        """A long text's sum: its words are many and mostly new, so they are figured in pieces and not remembered."""
        words = list(words_of(text))
        return np.sort(np.concatenate(in_pieces(of, words))[:, 0]).sum() if words else 0.0

    def scored(texts: list[str | None]) -> np.ndarray:
        memo.begin()
        long = {k: alone(t) for k, t in enumerate(texts) if t and len(t) >= LONG}
        short = (words_of(None if k in long else t) for k, t in enumerate(texts))
        used = [np.fromiter(map(memo.__getitem__, words), np.int64, len(words)) for words in short]
        rows = memo.settle()[:, 0]
        z = np.array([long.get(k, 0.0) + np.sort(rows[u]).sum() for k, u in enumerate(used)]) + bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    return scored


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score double) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = scorer(sent.value)
        for part in slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scored(part.column("text").to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def passed(docs: DataFrame, model: dict, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``least``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = scorer(sent.value)
        for part in slices(batches, text_col, SLICE_BYTES):
            yield part.filter(pa.array(scored(part.column(text_col).to_pylist()) < least))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame) -> dict:
    """The model of the labelled rows that are not held out."""
    return fit(training_sample(docs, labels, "toxic", ~held_out(), CAP))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows that are not held out and score all documents: (doc_id, held_out, score, predicted)."""
    model = learned(docs, labels)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
