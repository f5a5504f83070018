"""Byte-level BPE encoding and decoding with a given rank file; nothing is trained.

Each match of the split pattern becomes a row of byte tokens. Rows are put into
buckets by length, padded to one matrix per bucket, and every round merges in each
row the leftmost pair of least rank. Pair ranks come from an open-addressing hash
table in numpy; finished rows are compacted away. A match of over ``WIDEST`` bytes
would make a matrix of quadratic cost, so those few go through an exact heap merge
(the results are equal; a test holds both against each other).

Nulls encode as empty texts; empty texts give no ids. Repeated rows and ties need
no rule: every row is encoded by itself. Extra columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, ragged, slices

#: Bytes of text in one slice, bytes of a memo before it starts anew, cells of a matrix, longest row of a matrix.
SLICE_BYTES, MEMO_BYTES, CELLS, WIDEST = 1 << 20, 24 << 20, 1 << 19, 2048
#: Bytes that an entry of a memo takes besides its text.
ENTRY_BYTES = 160
NONE = np.int32(np.iinfo(np.int32).max)
EMPTY = np.int64(-1)
_SPACES = re.compile(r"\s\s")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def slot_of(keys: np.ndarray, mask: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & mask


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hash table from (left id, right id) to the id of their concatenation."""
    keys, values = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                values.append(rank)
    keys, values = np.array(keys, np.int64), np.array(values, np.int32)
    size = 1 << max(4, int(len(keys) * 4).bit_length())
    held, ids = np.full(size, EMPTY), np.full(size, NONE)
    slots, todo = slot_of(keys, size - 1), np.arange(len(keys))
    while todo.size:
        at = slots[todo]
        free = np.flatnonzero(held[at] == EMPTY)
        at, first = np.unique(at[free], return_index=True)
        put = todo[free[first]]
        held[at], ids[at] = keys[put], values[put]
        todo = np.setdiff1d(todo, put, assume_unique=True)
        slots[todo] = (slots[todo] + 1) & (size - 1)
    return held, ids


def build_model(path: str) -> dict:
    """What tasks need of a rank file, as arrays; its size is bounded by the vocabulary's."""
    ranks = read_ranks(path)
    by_id = sorted((rank, token) for token, rank in ranks.items())
    lengths = np.zeros(by_id[-1][0] + 1, np.int64)
    for rank, token in by_id:
        lengths[rank] = len(token)
    held, ids = pair_table(ranks)
    return {"data": b"".join(token for _, token in by_id), "lengths": lengths, "held": held, "ids": ids}


class Merger:
    """Encodes lists of pattern matches."""

    def __init__(self, model: dict) -> None:
        self.lengths = model["lengths"]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.held, self.ids = model["held"], model["ids"]
        data = model["data"]
        self.whole = {data[s : s + n]: i for i, (s, n) in enumerate(zip(self.starts.tolist(), self.lengths.tolist(), strict=True)) if n}
        self.of_byte = np.array([self.whole.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.of_byte < 0).any():
            raise ValueError("the rank file lacks single bytes")

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each merged pair, NONE where there is none or one side is padding (-1)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        mask = len(self.held) - 1
        slots = slot_of(keys, mask)
        found = self.held[slots]
        out = np.where(found == keys, self.ids[slots], NONE)
        todo = np.flatnonzero((found != keys) & (found != EMPTY))
        while todo.size:
            slots[todo] = (slots[todo] + 1) & mask
            found = self.held[slots[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.ids[slots[todo[hit]]]
            todo = todo[~hit & (found != EMPTY)]
        return out

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        """Merge every row of a padded id matrix until no pair is left; padding is -1 and stays at the right."""
        out, place = np.full_like(rows, -1), np.arange(len(rows))
        width = rows.shape[1]
        ranks = self.ranks_of(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), width - 1)
        while len(rows):
            at = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            best = ranks[every, at]
            live = best != NONE
            if not live.all():
                done = ~live
                out[place[done], : rows.shape[1]] = rows[done]
                rows, ranks, place, at, best = rows[live], ranks[live], place[live], at[live], best[live]
                if not len(rows):
                    break
                every = every[: len(rows)]
            columns = np.arange(rows.shape[1] - 1)
            later = columns[None, :] > at[:, None]
            rows = np.where(later, rows[:, 1:], rows[:, :-1])
            rows[every, at] = best
            if rows.shape[1] == 1:
                out[place, :1] = rows
                break
            ranks = np.where(later[:, :-1], ranks[:, 1:], ranks[:, :-1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.ranks_of(rows[before, at[before] - 1], rows[before, at[before]])
            after = np.flatnonzero(at < ranks.shape[1])
            ranks[after, at[after]] = self.ranks_of(rows[after, at[after]], rows[after, at[after] + 1])
        return out

    def long_row(self, data: bytes) -> np.ndarray:
        """The same merges for one very long match, by a heap over a linked list."""
        ids = self.of_byte[np.frombuffer(data, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.ranks_of(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(rank, i, ids[i], ids[i + 1]) for i, rank in enumerate(first) if rank != NONE]
        heapq.heapify(heap)
        memo: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = (ids[i], ids[j])
            if pair not in memo:
                memo[pair] = int(self.ranks_of(np.array([pair[0]], np.int32), np.array([pair[1]], np.int32))[0])
            if memo[pair] != NONE:
                heapq.heappush(heap, (memo[pair], i, *pair))

        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the matches, one match after the other, and how many each has."""
        n = len(matches)
        whole = np.fromiter(map(self.whole.get, matches, repeat(-1)), np.int64, n)
        lengths = np.fromiter(map(len, matches), np.int64, n)
        starts = np.cumsum(lengths) - lengths
        data = self.of_byte[np.frombuffer(b"".join(matches), np.uint8)]
        known = np.flatnonzero(whole >= 0)
        members, sizes, found = [known], [np.ones(len(known), np.int64)], [whole[known].astype(np.int32)]
        for k in np.flatnonzero((whole < 0) & (lengths > WIDEST)):
            ids = self.long_row(matches[k])
            members.append(np.array([k]))
            sizes.append(np.array([len(ids)]))
            found.append(ids)
        rest = np.flatnonzero((whole < 0) & (lengths > 0) & (lengths <= WIDEST))
        bits = np.ceil(np.log2(np.maximum(lengths[rest], 2))).astype(np.int64)
        for b in np.unique(bits):
            width = 1 << int(b)
            bucket = rest[bits == b]
            for at in range(0, len(bucket), step := max(1, CELLS // width)):
                part = bucket[at : at + step]
                rows = np.full((len(part), width), -1, np.int32)
                rows[np.arange(width)[None, :] < lengths[part][:, None]] = data[ragged(starts[part], lengths[part])]
                merged = self.matrix(rows)
                kept = merged >= 0
                members.append(part)
                sizes.append(kept.sum(axis=1))
                found.append(merged[kept])
        where, size, flat = np.concatenate(members), np.concatenate(sizes), np.concatenate(found)
        begin = np.zeros(n, np.int64)
        count = np.zeros(n, np.int64)
        begin[where], count[where] = np.cumsum(size) - size, size
        return flat[ragged(begin, count)], count


class Numbered(dict):
    """Numbers each new key by order of first use."""

    def __missing__(self, key: str) -> int:
        at = self[key] = len(self)
        return at


class Memo:
    """Ids of text chunks seen so far. A chunk runs up to the next space, so that its matches do not depend on its neighbours
    (true while no two white-space characters meet); other texts are split by the pattern as a whole."""

    def __init__(self, merger: Merger, pattern: str) -> None:
        self.merger, self.find = merger, regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.place, self.held = Numbered(), 0
        self.flat, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and how many each has."""
        if self.held > MEMO_BYTES:
            self.clear()
        known = len(self.place)
        get = self.place.__getitem__
        uses: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            before = len(uses)
            if not text:
                continue
            if _SPACES.search(text) or "\0" in text:
                uses.extend(map(get, self.find(text)))
            else:
                uses.extend(map(get, filter(None, text.replace(" ", "\0 ").split("\0"))))
            counts[k] = len(uses) - before
        new = list(islice(self.place, known, None))
        if new:
            self.held += sum(map(len, new)) + ENTRY_BYTES * len(new)
            found = list(map(self.find, new))
            names: dict[str, int] = {}
            which = np.array([names.setdefault(m, len(names)) for chunk in found for m in chunk], np.int64)
            flat, sizes = self.merger.encode([m.encode() for m in names])
            ids = flat[ragged((np.cumsum(sizes) - sizes)[which], sizes[which])]
            ends = np.concatenate([[0], np.cumsum(sizes[which])])
            bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
            self.flat = np.concatenate([self.flat, ids])
            self.lengths = np.concatenate([self.lengths, np.diff(ends[bounds])])
        used = np.array(uses, np.int64)
        lengths = self.lengths[used]
        ids = self.flat[ragged((np.cumsum(self.lengths) - self.lengths)[used], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


def encoded(memo: Memo, part: pa.RecordBatch) -> pa.ListArray:
    """The ids of each text of a slice."""
    ids, counts = memo.texts([x or "" for x in part.column("text").to_pylist()])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))


def decoded(model: dict, lists: pa.ListArray) -> pa.Array:
    """The bytes that each list of ids stands for, from the ids and the vocabulary alone."""
    lengths = model["lengths"]
    starts, data = np.cumsum(lengths) - lengths, np.frombuffer(model["data"], np.uint8)
    counts = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], np.int64)
    ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if ids.size and (ids.min() < 0 or ids.max() >= len(lengths) or not lengths[ids].all()):
        raise ValueError("an id is not in the vocabulary")
    sizes = lengths[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
    found = data[ragged(starts[ids], sizes)]
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(found)]).cast(pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every row; ``path`` is a rank file, read on the driver and sent to tasks as arrays. With ``back``
    also ``data`` binary, what the ids decode to: both directions in one pass, so that a core runs one Python worker."""
    model = docs.sparkSession.sparkContext.broadcast(build_model(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(Merger(model.value), pattern)
        for part in slices(batches, "text", SLICE_BYTES):
            lists = encoded(memo, part)
            columns = [part.column("doc_id"), lists] + ([decoded(model.value, lists)] if back else [])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "data"][: len(columns)])

    picked = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, ids array<int>" + (", data binary" if back else ""))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, data binary): the bytes that the ids stand for. A null list decodes as an empty one; an id outside the vocabulary is an error."""
    model = coded.sparkSession.sparkContext.broadcast({k: v for k, v in build_model(path).items() if k in ("data", "lengths")})
    kind = coded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), decoded(model.value, batch.column("ids"))], ["doc_id", "ids", "data"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, data binary")


@cache
def default_vocabulary() -> tuple[str, str]:
    """Path and split pattern of the production vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def digests(docs: DataFrame) -> DataFrame:
    """Encode and decode with the production vocabulary; one row of digests for each document."""
    path, pattern = default_vocabulary()
    both = encode(docs, path, pattern, back=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("data"), 256).alias("decoded_sha256"))
