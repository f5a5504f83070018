"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A text's elements are its shingles of five lower-cased words, weighted by how often they
occur: 1 + ``SPREAD`` * (1 - 1/count). Every element is a Poisson process with its weight as rate:
arrivals come in exponential steps and each falls on one register; a register keeps the
element that arrives first. An element stops as soon as its next arrival is later than
the latest register's, so long texts cost little more than one arrival an element. The
share of equal registers estimates the probability Jaccard of two weighted shingle
sets (``estimated``). Registers are cut into bands; texts that share a band are candidates, and
two texts are linked if the Jaccard similarity of their shingle sets is 0.8 or more, computed
exactly on 32-bit shingle hashes.

Candidates go by weighted sets and links by plain ones. Weights lie between 1 and
1 + ``SPREAD``, so each term of the probability Jaccard is at least 1/(1 + ``SPREAD``) of that of
plain sets: a pair of similarity 0.8 has a probability Jaccard of at least 0.8/1.05 = 0.762 whatever
lines repeat, and with independent registers shares no band with probability
(1 - 0.762**4)**24 = 5 in 100,000 at most; where counts are alike (1 - 0.8**4)**24 = 3 in a million.

Groups may be huge, so pairs within a band are never listed. First each member of a
band is compared with the band's most central member only, and linked texts become
components. Bands that then still hold several components go on: all members outside
a band's largest component are compared with all its members, in cells of bounded size
(``CELL`` shingles a side) whose intersections are one matrix product; a cell gives back
only the links that join two components. So no candidate is dropped and the classes are
those of all links among candidates. Texts equal up to case and white space are one node from the start.
Small sides of joins are written as tables first, so that both sides of every join on a key that may
be hot are plain exchanges, which AQE splits. Tables of bands and nodes grow with the input, so they are
merged by shuffle at every size and not broadcast while they happen to be small.

A node is named by a 64-bit hash of its words; two texts meet in it by chance with
probability n*n/2**65. Null texts and texts without words have no shingles and stand
alone; texts of fewer than five words have one shingle. Repeated rows are copies of each
other. Classes are named by their least doc_id (null only if all ids in it are null).
Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, named, packed, ragged, release, slices, table, unpacked
from .subwords import word_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: How much more than 1 the weight of a shingle may be that occurs more than once.
SPREAD = 0.05
REGISTERS = BANDS * ROWS
SLICE_BYTES, MEMO_BYTES, WORD_BYTES, CELL, COLUMNS = 2 << 20, 24 << 20, 170, 1 << 18, 2048
ODD = np.uint64(0x9E6C63D0876A9A47)


class Words(dict):
    """64-bit hashes of words, by number of first use."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.new, self.held = np.zeros(0, np.uint64), [], 0

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def begin(self) -> None:
        if self.held > MEMO_BYTES:
            self.clear()
            self.hashes, self.held = np.zeros(0, np.uint64), 0

    def settle(self) -> np.ndarray:
        if self.new:
            self.held += sum(map(len, self.new)) + WORD_BYTES * len(self.new)
            codes = np.frombuffer("".join(self.new).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
            self.hashes = np.concatenate([self.hashes, word_hashes(codes, np.fromiter(map(len, self.new), np.int64, len(self.new)))])
            self.new = []
        return self.hashes


def shingles(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 32-bit shingles, the document each belongs to and how often it occurs there, from all documents' word hashes."""
    padded = np.where(lengths > 0, np.maximum(lengths, WORDS), 0)
    words = np.zeros(int(padded.sum()), np.uint64)
    words[ragged(np.cumsum(padded) - padded, lengths)] = flat
    many = np.maximum(padded - WORDS + 1, 0)
    start = ragged(np.cumsum(padded) - padded, many)
    mixed = np.zeros(len(start), np.uint64)
    for j in range(WORDS):
        mixed = mixed * np.uint64(0x100000001B3) + words[start + j]
    owner = np.repeat(np.arange(len(lengths), dtype=np.uint64), many)
    both, counts = np.unique(owner << np.uint64(32) | mix64(mixed) >> np.uint64(32), return_counts=True)
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.int64), counts


def registers(elements: np.ndarray, owner: np.ndarray, weights: np.ndarray, docs: int) -> np.ndarray:
    """ProbMinHash registers [document, register] of all documents' weighted elements; those without elements keep zeros."""
    held = np.full(docs * REGISTERS, np.inf)
    name = np.zeros(docs * REGISTERS, np.uint32)
    seed = mix64(elements.astype(np.uint64) + ODD)
    now = np.zeros(len(elements))
    live, step = np.arange(len(elements)), 0
    latest = np.full(docs, np.inf)
    while live.size:
        draw = mix64(seed[live] + np.uint64(step * int(ODD) & (1 << 64) - 1))
        now[live] -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[live]
        slot = owner[live] * REGISTERS + (mix64(draw) % np.uint64(REGISTERS)).astype(np.int64)
        early = now[live] < held[slot]
        slot, from_ = slot[early], live[early]
        np.minimum.at(held, slot, now[from_])
        won = held[slot] == now[from_]
        name[slot[won]] = elements[from_[won]]
        some = np.unique(owner[live])
        latest[some] = held.reshape(docs, REGISTERS)[some].max(axis=1)
        live = live[now[live] < latest[owner[live]]]
        step += 1
    return name.reshape(docs, REGISTERS)


def estimated(names_a: np.ndarray, names_b: np.ndarray) -> np.ndarray:
    """The probability Jaccard of pairs of weighted sets, estimated by the share of equal registers."""
    return (names_a == names_b).mean(axis=-1)


def bands_of(names: np.ndarray) -> np.ndarray:
    out = np.zeros((len(names), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * ODD
    for j in range(ROWS):
        out = mix64(out ^ (names[:, j::ROWS].astype(np.uint64) + np.uint64(j << 32)))
    return out.view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, content, node, shingles, bands) of every row: content is a 64-bit hash of the exact text, node one of its words; node is null where there are none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for part in slices(batches, "text", SLICE_BYTES):
            memo.begin()
            texts = [(t or "").lower().split() for t in part.column("text").to_pylist()]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            ids = np.fromiter((memo[w] for words in texts for w in words), np.int64, int(lengths.sum()))
            flat = memo.settle()[ids]
            place = ragged(np.zeros(len(texts), np.int64), lengths).astype(np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(flat + mix64(place)))])
            ends = np.cumsum(lengths)
            node = mix64(sums[ends] - sums[ends - lengths] + lengths.astype(np.uint64) * ODD).view(np.int64)
            elements, owner, counts = shingles(flat, lengths)
            bands = bands_of(registers(elements, owner, 1 + SPREAD * (1 - 1 / counts), len(texts)))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("content"),
                    pa.array(node, mask=lengths == 0),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(elements.view(np.int32))),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel())),
                ],
                ["doc_id", "content", "node", "shingles", "bands"],
            )

    text = named(text_col).cast("string")
    picked = docs.select(named(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("content"))
    return picked.mapInArrow(run, f"doc_id {kind}, content bigint, node bigint, shingles array<int>, bands array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that links (a, b) reach. Labels spread along links and jump to their labels' labels until none changes."""
    both = table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        far = nearer.select(F.col("node").alias("_n"), F.col("label").alias("_far"))
        moved = table(nearer.join(far, F.col("label") == F.col("_n"), "left").select("node", "old", F.least("label", "_far").alias("label")), "labels")
        release(labels)
        done = moved.where(F.col("old") != F.col("label")).isEmpty()
        labels = moved.drop("old")
        labels._ledgerloom_path = moved._ledgerloom_path
        if done:
            release(both)
            return labels.select("node", F.col("label").alias("component"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of (a, b) whose shingle sets have a Jaccard similarity of ``SIMILARITY`` or more."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    n, m = F.size("sa"), F.size("sb")
    near = F.least(n, m) >= F.greatest(n, m) * SIMILARITY
    common = F.when(near, F.size(F.array_intersect("sa", "sb"))).otherwise(0)
    return met.select("a", "b", n.alias("n"), m.alias("m"), common.alias("common")).where(F.col("common") >= (F.col("n") + F.col("m") - F.col("common")) * SIMILARITY).select("a", "b")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: products of 0/1 matrices over the shingles that both sides have."""
    a, b = np.concatenate(left), np.concatenate(right)
    rows_a, rows_b = np.repeat(np.arange(len(left)), list(map(len, left))), np.repeat(np.arange(len(right)), list(map(len, right)))
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(shared):
        return out
    at_a, at_b = np.searchsorted(shared, a), np.searchsorted(shared, b)
    in_a = shared[np.minimum(at_a, len(shared) - 1)] == a
    in_b = shared[np.minimum(at_b, len(shared) - 1)] == b
    at_a, rows_a, at_b, rows_b = at_a[in_a], rows_a[in_a], at_b[in_b], rows_b[in_b]
    order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    at_a, rows_a, at_b, rows_b = at_a[order_a], rows_a[order_a], at_b[order_b], rows_b[order_b]
    for low in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - low)
        parts = []
        for at, rows, n in ((at_a, rows_a, len(left)), (at_b, rows_b, len(right))):
            lo, hi = np.searchsorted(at, [low, low + width])
            matrix = np.zeros((n, width), np.float32)
            matrix[rows[lo:hi], at[lo:hi] - low] = 1
            parts.append(matrix)
        out += parts[0] @ parts[1].T
    return out


def joined_in(cell: pa.Table) -> pa.Table:
    """Links between components that a cell's strays and members have: as few as join the same components."""
    stray = cell.column("stray").to_numpy(zero_copy_only=False)
    part = cell.column("component").to_numpy()
    sets = cell.column("shingles").combine_chunks()
    offsets, values = sets.offsets.to_numpy(), sets.values.to_numpy()
    each = [values[lo:hi] for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
    rows, columns = np.flatnonzero(stray), np.flatnonzero(~stray)
    found: list[tuple[int, int]] = []
    if len(rows) and len(columns):
        common = overlaps([each[i] for i in rows], [each[i] for i in columns])
        sizes = np.diff(offsets).astype(np.float32)
        linked = common >= (sizes[rows][:, None] + sizes[columns][None, :] - common) * SIMILARITY
        linked &= part[rows][:, None] != part[columns][None, :]
        i, j = np.nonzero(linked)
        pairs = np.unique(np.sort(np.stack([part[rows[i]], part[columns[j]]], axis=1), axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := root.setdefault(x, x)) != x:
                root[x] = x = root[y]
            return x

        for a, b in pairs.tolist():
            p, q = top(a), top(b)
            if p != q:
                root[p] = q
                found.append((a, b))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def rest_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components that still meet in a band, from (band, node, component)."""
    sized = members.join(sets.select("node", F.size("shingles").alias("size")), "node")
    parts = sized.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("n", "component"))
    bands = parts.groupBy("band").agg(most.alias("most"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("all")).where(F.col("parts") > 1)
    bands = bands.join(parts.select("band", F.col("component").alias("main"), F.col("size").alias("held")), "band").where(F.col("main") == F.col("most.component"))
    cells = lambda size: F.ceil(size / CELL).cast("int")
    bands = bands.select("band", "main", cells(F.col("all") - F.col("held")).alias("stray_cells"), cells(F.col("all")).alias("member_cells"))
    met = members.join(table(bands, "open-bands"), "band")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    strays = met.where(F.col("component") != F.col("main")).select("band", "node", "component", F.lit(True).alias("stray"), F.pmod(F.xxhash64("node"), "stray_cells").cast("int").alias("i"), upto(F.col("member_cells")).alias("j"))
    others = met.select("band", "node", "component", F.lit(False).alias("stray"), upto(F.col("stray_cells")).alias("i"), F.pmod(F.xxhash64("node", F.lit(1)), "member_cells").cast("int").alias("j"))
    placed = strays.unionByName(others).join(sets.hint("merge"), "node")
    return placed.groupBy("band", "i", "j").applyInArrow(joined_in, "a bigint, b bigint")


def classes_of_nodes(rows: DataFrame) -> DataFrame:
    """(node, component) of the nodes that share a band with another one, from a table of ``signatures``."""
    each = rows.where(F.col("node").isNotNull()).select("node", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("lo") != F.col("hi")).select("band", "n")
    members = table(each.join(table(shared, "shared").hint("merge"), "band").groupBy("band", "node").agg(F.max("n").alias("n")), "members")
    weights = table(members.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    sets = table(rows.select("node", "shingles").join(weights.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    central = table(members.join(weights, "node").groupBy("band").agg(F.max(F.struct("weight", "node")).alias("c")).select("band", F.col("c.node").alias("b")), "central")
    pairs = members.select("band", F.col("node").alias("a")).join(central, "band").where(F.col("a") != F.col("b")).select("a", "b").distinct()
    first = components(verified(pairs, sets))
    known = table(weights.select("node").join(first, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")
    placed = table(members.select("band", "node").join(known, "node"), "placed")
    second = components(rest_links(placed, sets))
    onward = second.select(F.col("node").alias("component"), F.col("component").alias("onward"))
    found = table(known.join(onward, "component", "left").select("node", F.coalesce("onward", "component").alias("component")), "classes")
    for done in (shared, members, weights, sets, central, first, known, placed, second):
        release(done)
    return found


def classified(rows: DataFrame) -> DataFrame:
    """(doc_id, content, node, class_id, class_content, class_size) of every row of a table of ``signatures``: the least (id, content) of its
    class, nulls last, and the rows in it. Counts go by node first, so that copies of one text are a number and not rows of one key."""
    found = classes_of_nodes(rows)
    least = lambda id_, content: F.min(F.struct(id_.isNull().alias("none"), id_.alias("id"), content.alias("content")))
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(least(F.col("doc_id"), F.col("content")).alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = table(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "least", "n"), "nodes")
    sizes = table(nodes.groupBy("component").agg(F.min("least").alias("least"), F.sum("n").alias("class_size")), "sizes")
    told = table(nodes.select("node", "component").join(sizes, "component").select("node", F.col("least.id").alias("class_id"), F.col("least.content").alias("class_content"), "class_size"), "told")
    alone = F.col("node").isNull()
    return rows.select("doc_id", "content", "node").join(told, "node", "left").select(
        "doc_id", "content", "node", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("content")).otherwise(F.col("class_content")).alias("class_content"), F.when(alone, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"),
    )


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size) of every row: class_size counts rows, class_id is the least doc_id among them."""
    return classified(table(signatures(docs, id_col, text_col), "signatures")).select("doc_id", "class_id", "class_size")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the least id (null ids last), then the least hash of its text, then of its other
    columns. Rows go by id and text together, so that a repeated id drops no other text. Rows without words all stay."""
    known = table(classified(table(signatures(docs, id_col, text_col), "signatures")).where(F.col("class_size") > 1), "multiple")
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("content") == F.col("class_content"))
    repeated = table(known.where(first).groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("doc_id", "content"), "repeated")
    gone = table(known.where(~first).select("doc_id", "content").distinct().unionByName(repeated), "dropped")
    rows = packed(docs, id=named(id_col), content=F.xxhash64(named(text_col).cast("string")))

    def same(other: DataFrame) -> tuple[DataFrame, Column]:
        renamed = other.select(F.col("doc_id").alias("other_id"), F.col("content").alias("other_content"))
        return renamed, F.col("id").eqNullSafe(F.col("other_id")) & (F.col("content") == F.col("other_content"))

    kept = rows.join(*same(gone.hint("merge")), "left_anti").select("row")
    whole = F.to_json("row") if "map<" in docs.schema.simpleString() else F.col("row")  # maps can't be hashed
    one = rows.join(*same(repeated), "left_semi").groupBy("id", "content").agg(F.min_by("row", F.xxhash64(whole)).alias("row")).select("row")
    return kept.unionByName(one).select(*unpacked(docs))
