"""Hashed character n-grams of words, for the two text classifiers; vectorised over many words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, table

PRIME = np.uint64(0x100000001B3)


def ngrams(words: list[str], orders: tuple[int, ...], bits: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each ``<word>`` (and of the word itself if ``whole``), and the index of the word each belongs to."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), lengths)
    shift = np.uint64(64 - bits)
    buckets, owners = [], []
    for n in orders:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        value = np.full(m, n, np.uint64)
        for j in range(n):
            value = value * PRIME + codes[j : j + m]
        inside = owner[:m] == owner[n - 1 :]
        buckets.append((mix64(value[inside]) >> shift).astype(np.int64))
        owners.append(owner[:m][inside])
    if whole and len(words):
        buckets.append((word_hashes(codes, lengths) >> shift).astype(np.int64))
        owners.append(np.arange(len(words)))
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def word_hashes(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    return mix64(np.add.reduceat(mix64(codes + (place.astype(np.uint64) << np.uint64(32))), starts))


#: Words whose n-grams are held at once; characters of a text from which on its words aren't kept in a memo.
PIECE, LONG = 1 << 14, 1 << 20


def in_pieces(of: Callable[[list[str]], np.ndarray], words: list[str]) -> list[np.ndarray]:
    """Figures of many words, a piece at a time: n-grams take some hundred bytes a word, the figures a few."""
    return [of(words[at : at + PIECE]) for at in range(0, len(words), PIECE)]


class WordMemo(dict):
    """Numbers words by first use; ``of`` computes a row of figures for new ones. It starts anew once its words take ``most`` bytes."""

    #: Bytes that a word takes besides its characters.
    ENTRY = 170

    def __init__(self, of: Callable[[list[str]], np.ndarray], width: int, most: int = 24 << 20) -> None:
        super().__init__()
        self.of, self.width, self.most = of, width, most
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.rows, self.held = np.zeros((0, self.width)), 0
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def begin(self) -> None:
        if self.held > self.most:
            self.forget()

    def settle(self) -> np.ndarray:
        """Rows of all words; call it after the words of a slice are looked up."""
        if self.new:
            self.held += sum(map(len, self.new)) + self.ENTRY * len(self.new)
            self.rows = np.concatenate([self.rows, *in_pieces(self.of, self.new)])
            self.new = []
        return self.rows


def training_sample(docs: DataFrame, labels: DataFrame, label: str, kept: Column, cap: int) -> DataFrame:
    """(doc_id, text, y), as a table: at most ``cap`` documents of each class, those with the least hash of doc_id among the labelled ids that
    ``kept`` admits. Null labels, ids and texts take no part; a doc_id labelled twice counts once, as its larger label; of several
    documents with one id the one with the least hash of its text counts. Texts of every length take part."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & kept).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.xxhash64(F.lit(label), "doc_id")
    # a share of about 1.5 * cap ids goes into the ordering, so that what tasks send to the limit doesn't grow with the labels
    near = F.pmod(place, F.lit(1 << 30)) < F.lit(1 << 30) * F.coalesce(F.create_map(*[F.lit(x) for y, n in sizes.items() for x in (y, min(1.0, (1.5 * cap + 100) / n))])[F.col("y")], F.lit(0.0)) if sizes else F.lit(False)
    chosen = [marks.where((F.col("y") == y) & near).orderBy(F.pmod(place, F.lit(1 << 30)), "doc_id").limit(cap) for y in (0, 1)]
    chosen = table(chosen[0].unionByName(chosen[1]), "chosen")  # at most 2 * cap ids: small enough to broadcast, so no text is shuffled
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return table(found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("y").alias("y")), "sample")
