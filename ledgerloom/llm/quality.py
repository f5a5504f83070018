"""Quality: supervised subword embeddings, averaged per document, with a softmax output.

Every word of a text adds its own hashed vector and those of its character 2- to
4-grams (ends marked, case kept), and every two adjacent words the hashed vector of their
bigram, whose hash is the xor of the two words' hashes (so order doesn't matter, and a word
next to itself falls on one bucket whatever the word). The average of all is the document's
vector, and a softmax over two classes scores it. Vectors and output weights are
learned together by stochastic gradient descent in numpy, one document a step.

The fit takes a bounded sample of labelled rows: up to ``CAP`` documents of each class,
of every length. Their hashed counts (not texts) come to the driver: at most 2**``BITS`` for each
document. Scores cover every row and whole texts. Because the output is linear in the vectors, tasks
get one number for each hash bucket and keep sums for words seen before.

Null and empty texts have no features and get the bias's score. With one class or none
in training every score is the class share (0.0 without labels). Repeated rows score
alike; empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices
from .subwords import LONG, WordMemo, in_pieces, ngrams, training_sample, word_hashes

ORDERS, BITS, WIDTH = (2, 3, 4), 17, 8
#: Most documents of a class in the training sample.
CAP = 2000
EPOCHS, RATE, SEED = 6, 1.0, 5
SLICE_BYTES = 2 << 20


def words_of(text: str | None) -> list[str]:
    return (text or "").split()


def hashes_of(words: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    return word_hashes(codes, np.fromiter(map(len, words), np.int64, len(words))) if words else np.zeros(0, np.uint64)


def bigrams(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the bigrams of words with these hashes."""
    return (mix64(hashes[1:] ^ hashes[:-1]) >> np.uint64(64 - BITS)).astype(np.int64)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    words = words_of(text)
    found, times = np.unique(np.concatenate([ngrams(words, ORDERS, BITS, whole=True)[0], bigrams(hashes_of(words))]), return_counts=True)
    return found.astype(np.int32), times.astype(np.int32)


def features(sample: DataFrame) -> DataFrame:
    """(key, y, buckets, counts) of the sample's documents, computed in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            found = [counted(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("y"), pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.int32()))], ["key", "y", "buckets", "counts"])

    return sample.select(F.col("doc_id").cast("string").alias("key"), "text", "y").mapInArrow(run, "key string, y int, buckets array<int>, counts array<int>")


def fit(sample: DataFrame) -> dict:
    """One number for each bucket (its vector times the difference of the output weights) and the bias."""
    got = features(sample).toArrow().sort_by("key")  # parts come in any order: by id, equal inputs give equal models
    y = got.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return {"weights": np.zeros(1 << BITS, np.float32), "bias": float(np.log((share + 1e-9) / (1 - share + 1e-9)))}
    lists, counts = got.column("buckets").combine_chunks(), got.column("counts").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
    bucket, times = lists.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.float32)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    output, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    share = np.array([0.5 / max((y == 0).mean(), 1e-9), 0.5 / max((y == 1).mean(), 1e-9)])
    total, step = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for d in rng.permutation(len(y)):
            rate = RATE * (1 - step / total) * share[y[d]]
            step += 1
            at, many = bucket[ends[d] : ends[d + 1]], times[ends[d] : ends[d + 1]]
            if not len(at):
                continue
            own = vectors[at]
            weight = many / many.sum()
            mean = weight @ own
            logit = output @ mean + bias
            p = np.exp(logit - logit.max())
            slope = p / p.sum()
            slope[y[d]] -= 1
            back = slope @ output
            output -= (rate * slope)[:, None] * mean[None, :]
            bias -= 0.1 * rate * slope
            # the step of a vector goes by the root of its share: rare cues of long documents learn as well
            vectors[at] = own - (rate * np.sqrt(weight))[:, None] * back[None, :]
    return {"weights": (vectors @ (output[1] - output[0])).astype(np.float32), "bias": float(bias[1] - bias[0])}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score double) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value["weights"].astype(np.float64), sent.value["bias"]

        def of(words: list[str]) -> np.ndarray:
            bucket, owner = ngrams(words, ORDERS, BITS, whole=True)
            return np.stack([np.bincount(owner, weights[bucket], len(words)), np.bincount(owner, minlength=len(words)), hashes_of(words).view(np.float64)], axis=1)

        def alone(text: str) -> float:
            """A long text's mean: its words are figured in pieces, each with the last hash of the one before, and not remembered."""
            words, total, many, last = words_of(text), 0.0, 0, np.zeros(0, np.uint64)
            for rows in in_pieces(of, words):
                hashes = np.concatenate([last, np.ascontiguousarray(rows[:, 2]).view(np.uint64)])
                pairs, last = bigrams(hashes), hashes[-1:]
                total, many = total + rows[:, 0].sum() + weights[pairs].sum(), many + rows[:, 1].sum() + len(pairs)
            return total / many if many else 0.0

        memo = WordMemo(of, 3)
        for part in slices(batches, "text", SLICE_BYTES):
            memo.begin()
            texts = part.column("text").to_pylist()
            long = {k: alone(t) for k, t in enumerate(texts) if t and len(t) >= LONG}
            words = [words_of(None if k in long else t) for k, t in enumerate(texts)]
            used = [np.fromiter(map(memo.__getitem__, w), np.int64, len(w)) for w in words]
            rows = memo.settle()
            hashes = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
            out = np.zeros(len(used))
            for k, ids in enumerate(used):
                if k in long:
                    out[k] = long[k]
                    continue
                pairs = bigrams(hashes[ids])
                many = rows[ids, 1].sum() + len(pairs)
                out[k] = (rows[ids, 0].sum() + weights[pairs].sum()) / many if many else 0.0
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out + bias, -500, 500))))], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows that are not held out and score all documents: (doc_id, held_out, score, predicted)."""
    model = fit(training_sample(docs, labels, "quality", ~held_out(), CAP))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
