"""Ranked lexical search: the best documents for each item, found by branch and bound over max trees.

One pass over the texts keeps, for each document, its length and the counts of those terms
that occur in some item (the postings, as a table); document frequencies and totals are
aggregates of it. Tasks then read the postings and cut them into blocks of documents. In a
block, documents are laid out by length, and a tree of ranges stands above them: for every
term each range has the largest impact that the term reaches in it, and each parent the
largest of its children. A range's bound for an item is the sum over the item's terms; no
document below scores more. The search descends best-first: the range with the highest
bound is opened next, a lowest range is scored exactly, and it ends when the highest bound
is below the item's last kept score. Ranges whose bound equals that score are opened as
well, since a tie goes to the smaller id.

Work stays bounded: a block has at most ``POSTINGS`` postings, so ranges are fewer the longer
documents are; a task keeps the best of each item over all its blocks, so later blocks are cut off
early, and hands on ``k`` rows for each item. To make that cut good from the start, the one
document in ``FIRST`` whose id hashes lowest are searched first: the last score kept there is a lower bound of
the final one, so nothing that could be returned is lost, and few rows reach the merge.
Items come in blocks of about ``ITEMS`` items or ``TERMS`` terms (dealt by hash; one longer item makes a longer block); a block's terms
are what is broadcast, and every block reads the documents once.

Null texts have no terms. Documents without a term of an item score 0 and aren't returned. A null
doc_id comes last among equal scores. Repeated rows rank each; an item that is repeated is
answered each time. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import named, ragged, release, slices, table

#: Results for an item; documents of a lowest range; children of a range; postings of a block; items and terms searched at once; share searched first.
K, LEAF, FANOUT, POSTINGS, ITEMS, TERMS, FIRST = 50, 32, 16, 1 << 20, 2048, 1 << 17, 64
SLICE_BYTES = 4 << 20
#: Terms of a text in bytes of UTF-8, once A-Z are lower-cased (fixed value): bytes of characters beyond ASCII belong to terms.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LAST = np.iinfo(np.int64).max
#: Arrow turns these columns of a posting row into arrays.
POSTED = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
FOUND = "item int, doc_id bigint, score bigint"


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode("utf-8", "replace").lower())  # bytes.lower touches A-Z only


@dataclass(frozen=True)
class Items:
    """A block of items: (id, distinct term numbers) of each, and the number of every term."""

    ids: list
    terms: list[np.ndarray]
    number: dict[bytes, int]


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """Blocks of items, whatever their number: they are written with their sizes, dealt to ranges of bounded size, and collected block by block."""
    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(found, pa.list_(pa.binary()))], names=["id", "terms"])

    rows = items.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text")).mapInArrow(size, "id bigint, terms array<binary>")
    rows = table(rows.withColumn("place", F.xxhash64("id", "terms")), "items")
    n, terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-terms // TERMS))  # dealt by hash, so a block is near its bound
    for b in range(blocks):
        held = rows.where(F.pmod("place", F.lit(blocks)) == b).drop("place").orderBy(F.asc_nulls_last("id")).collect()
        number: dict[bytes, int] = {}
        numbers = [np.array([number.setdefault(bytes(t), len(number)) for t in r["terms"]], np.int64) for r in held]
        if held:
            yield Items([r["id"] for r in held], numbers, number)
    release(rows)


def postings(docs: DataFrame, block: Items, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: its length and the counts of the terms that some item has."""
    number = docs.sparkSession.sparkContext.broadcast(block.number)  # about TERMS terms, see item_blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, lengths, terms, counts, sizes = [], [], [], [], [0]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = terms_of(text)
                if found:
                    ids.append(doc_id)
                    lengths.append(len(found))
                    seen = Counter(filter(known.__contains__, found))
                    terms.extend(map(known.__getitem__, seen))
                    counts.extend(seen.values())
                    sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))], names=["doc_id", "n", "terms", "counts"])

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text")).mapInArrow(count, POSTED)


def ragged_max(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array, and the largest value of each."""
    if not len(keys):
        return keys, values
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.maximum.reduceat(values, starts)


class MaxTree:
    """Max trees of all terms over one block of documents: level 0 has ranges of ``LEAF`` documents, each level above ``FANOUT`` ranges of the one below."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int) -> None:
        self.starts, self.term, self.impact = np.searchsorted(doc, np.arange(n_docs + 1)), term, impact  # postings by document
        self.n_docs = n_docs
        ranges, width = doc // LEAF, -(-n_docs // LEAF)
        order = np.lexsort((ranges, term))
        keys, best = ragged_max(term[order] * width + ranges[order], impact[order])
        self.levels = [(keys, keys % width, best, width)]
        while width > FANOUT:
            old, width = width, -(-width // FANOUT)
            keys, inside, best, _ = self.levels[-1]
            keys, best = ragged_max(keys // old * width + inside // FANOUT, best)
            self.levels.append((keys, keys % width, best, width))

    def bounds(self, level: int, first: int, terms: np.ndarray) -> np.ndarray:
        """Bounds of up to ``FANOUT`` ranges of a level from ``first`` on: sums over ``terms`` of their largest impacts."""
        keys, inside, best, width = self.levels[level]
        last = min(first + FANOUT, width)
        start = np.searchsorted(keys, terms * width + first)
        at = ragged(start, np.searchsorted(keys, terms * width + last) - start)
        sums = np.zeros(last - first, np.int64)
        np.add.at(sums, inside[at] - first, best[at])
        return sums

    def scores(self, leaf: int, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of a lowest range's documents; ``wanted`` marks the item's terms."""
        first, last = leaf * LEAF, min(leaf * LEAF + LEAF, self.n_docs)
        at = self.starts[first : last + 1]
        part = np.zeros(at[-1] - at[0] + 1, np.int64)
        np.cumsum(self.impact[at[0] : at[-1]] * wanted[self.term[at[0] : at[-1]]], out=part[1:])
        return np.diff(part[at - at[0]])


class Best:
    """The k best (score, id) of one item, and the least score that may still enter."""

    def __init__(self, k: int, least: int) -> None:
        self.k, self.least, self.heap = k, max(1, least), []

    def offer(self, score: int, doc_id: int) -> None:
        entry = (score, -doc_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)
        if len(self.heap) == self.k:
            self.least = max(self.least, self.heap[0][0])


def search(tree: MaxTree, ids: np.ndarray, terms: np.ndarray, wanted: np.ndarray, best: Best) -> int:
    """Best-first descent for one item; returns the number of lowest ranges that were scored."""
    opened, top = 0, len(tree.levels) - 1
    heap = [(-b, top, r) for r, b in enumerate(tree.bounds(top, 0, terms).tolist()) if b >= best.least]
    heapq.heapify(heap)
    while heap:
        bound, level, at = heapq.heappop(heap)
        if -bound < best.least:  # an equal bound may hide a tie with a smaller id, so only lower ones end the search
            break
        if level:
            first = at * FANOUT
            for r, b in enumerate(tree.bounds(level - 1, first, terms).tolist(), first):
                if b >= best.least:
                    heapq.heappush(heap, (-b, level - 1, r))
        else:
            opened += 1
            scores = tree.scores(at, wanted)
            for r in np.flatnonzero(scores >= best.least).tolist():
                best.offer(int(scores[r]), int(ids[at * LEAF + r]))
    return opened


def lengths_scaled(n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """A document's length against the mean, in hundredths and halved, plus 50; exact integers beyond 64 bits too."""
    if int(n.max(initial=0)) * 50 * n_docs < LAST:
        return 50 + 50 * n * n_docs // all_terms
    return np.array([50 + 50 * int(x) * n_docs // all_terms for x in n], np.int64)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, lengths, postings of each, terms, counts) of blocks of ``POSTINGS`` postings; one longer document stands alone."""
    held, size = [], 0

    def joined():
        return tuple(np.concatenate([h[i] for h in held]) for i in range(5))

    for batch in batches:
        ids = batch.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
        n = batch.column("n").to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        terms = batch.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        counts = batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        while start < len(ids):
            stop = max(int(np.searchsorted(ends, ends[start] + POSTINGS - size, side="right")) - 1, start if held else start + 1)
            if stop > start:
                held.append((ids[start:stop], n[start:stop], np.diff(ends[start : stop + 1]), terms[ends[start] : ends[stop]], counts[ends[start] : ends[stop]]))
                size += int(ends[stop] - ends[start])
            if stop < len(ids):
                yield joined()
                held, size = [], 0
            start = stop
    if held:
        yield joined()


def best_found(posted: DataFrame, block: Items, weights: np.ndarray, n_docs: int, all_terms: int, least: list[int], k: int) -> DataFrame:
    """(item, doc_id, score): the best k of each item in every task's share of the postings, none below ``least``."""
    known = posted.sparkSession.sparkContext.broadcast((block.terms, weights, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, floor = known.value
        best = [Best(k, x) for x in floor]
        wanted = np.zeros(len(weight), bool)
        for ids, n, sizes, terms, counts in blocks_of(batches):
            order = np.argsort(n, kind="stable")  # documents of like length share ranges, which makes bounds tight
            place = np.empty(len(n), np.int64)
            place[order] = np.arange(len(n))
            doc = np.repeat(place, sizes)
            by_doc = np.argsort(doc, kind="stable")
            doc, terms, counts = doc[by_doc], terms[by_doc], counts[by_doc]
            scaled = lengths_scaled(n[order], n_docs, all_terms)[doc]
            tree = MaxTree(doc, terms, weight[terms] * (1_000_000_000 * counts // (1000 * counts + 20 * scaled)), len(n))
            for item, b in zip(items, best, strict=True):
                wanted[item] = True
                search(tree, ids[order], item, wanted, b)
                wanted[item] = False
        rows = [(i, -d, s) for i, b in enumerate(best) for s, d in b.heap]
        for at in range(0, len(rows), 1 << 16):
            part = rows[at : at + (1 << 16)]
            yield pa.record_batch([pa.array([r[0] for r in part], pa.int32()), pa.array([None if r[1] == LAST else r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64())], names=["item", "doc_id", "score"])

    return posted.mapInArrow(run, FOUND)


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def answer_block(docs: DataFrame, block: Items, id_col: str, text_col: str, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of one block of items, as a table."""
    spark = docs.sparkSession
    posted = table(postings(docs, block, id_col, text_col), "postings")
    n_docs, all_terms = posted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = posted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()  # TERMS rows at most
    df = np.zeros(len(block.number), np.int64)
    df[[r["t"] for r in held]] = [r["df"] for r in held]
    weights = np.array([math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * d + 1))) for d in df.tolist()], np.int64)
    first = posted.where(F.pmod(F.xxhash64("doc_id"), F.lit(FIRST)) == 0)
    sure = top(best_found(first, block, weights, n_docs, all_terms, [1] * len(block.ids), k), k).where(F.col("rank") == k)
    least = [1] * len(block.ids)
    for r in sure.select("item", "score").collect():  # one row for each item of the block
        least[r["item"]] = r["score"]
    found = top(best_found(posted, block, weights, n_docs, all_terms, least, k), k)
    numbers = spark.createDataFrame([(i, x) for i, x in enumerate(block.ids)], "item int, item_id bigint")
    done = table(found.join(F.broadcast(numbers), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "answers")  # ITEMS rows at most
    release(posted)
    return done


def answers(docs: DataFrame, items: DataFrame, k: int = K, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0."""
    done = [answer_block(docs, block, doc_col, text_col, k) for block in item_blocks(items, item_col, text_col)]
    if not done:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


#: DuckDB SQL for ``answers`` over ``documents`` and ``benchmark``.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS MATERIALIZED (SELECT row_, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
lens AS (SELECT row_, sum(tf)::BIGINT AS n FROM tf GROUP BY row_),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM lens),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, docs),
q AS (SELECT DISTINCT row_, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row_, * FROM benchmark)),
s AS (SELECT q.row_ AS item, item_id, tf.row_, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // l))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN lens ON lens.row_ = tf.row_, total GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""
