"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node, so copies cost nothing. The graph starts coarse: ``ORDERS`` sorted orders by
the signs of random projections, cut into blocks of ``BLOCK`` vectors, give each node the nearest
of its blocks, which are few of its true neighbours. NN-descent makes the graph good: in
each round every node's neighbours, forward and nearest reverse ones, meet; all pairs
among them with a new member are compared, and each node keeps its ``K`` nearest. A
round is a few Spark joins and one shuffle by node; a task sees one node's neighbours,
at most ``FORWARD + BACK``, at a time, and nodes that no new neighbour reached send nothing.
Rounds go on until less than a share of ``CHANGED`` of the edges is new; a node's sorted
distances only ever fall, so they end.

Vectors travel between nodes as half-precision numbers, scaled by the table's largest
component; a graph edge's length is that of the rounded vectors. Searches and results use the
original vectors in double precision.

A query starts from the nearest of ``ENTRIES`` entry points (chosen by hash) and from its own
node if it is in the graph, and repeatedly expands the nodes of its beam that weren't
expanded yet, until the beam of the ``BEAM`` nearest holds none. A node that left a beam is
farther than all in it and can't return, so this ends too. All queries advance in one join a
round. The README gives the recall measured against brute force.

Vectors that are null or zero, hold null or non-finite components, or have a length other
than the most frequent one take no part. Ties go to the smaller id. A repeated id with
equal vectors counts once. Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, table

#: Neighbours kept; forward and reverse ones that meet in NN-descent; reverse ones that a search may follow.
K, FORWARD, BACK, REVERSE = 32, 24, 20, 32
ORDERS, BLOCK, SIGNS, SEED = 3, 128, 24, 11
#: NN-descent ends when a round changes less than this share of the edges.
CHANGED = 0.02
ENTRIES, STARTS, BEAM = 256, 8, 256
PART_ROWS = 8192


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull()).where(fine)
    most = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("v") == (most["n"] if most else 0))


def distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances [..., row of x, row of y]."""
    square = (x * x).sum(-1)[..., :, None] + (y * y).sum(-1)[..., None, :] - 2 * x @ np.swapaxes(y, -1, -2)
    return np.sqrt(np.maximum(square, 0))


def halved(nodes: DataFrame) -> DataFrame:
    """(node, code, h): each vector's signs as a number for every order, and its half-precision bytes."""
    first = nodes.agg(F.max(F.size("v")).alias("dims"), F.max(F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))).alias("most")).first()
    dims, most = first["dims"] or 1, first["most"] or 1.0
    planes = np.random.default_rng(SEED).standard_normal((ORDERS, SIGNS, dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v")) / most
                codes = [(x @ plane.T > 0) @ (1 << np.arange(SIGNS)[::-1]) for plane in planes]
                h = [row.tobytes() for row in x.astype(np.float16)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(list(np.stack(codes, 1))), pa.array(h, pa.binary())], ["node", "code", "h"])

    return nodes.mapInArrow(run, "node bigint, code array<bigint>, h binary")


def points_of(column: pa.Array) -> np.ndarray:
    """The vectors of a column of half-precision bytes."""
    width = len(column[0].as_py()) // 2
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, width).astype(np.float32)


def nearest_in_blocks(halves: DataFrame, order: int, parts: int) -> DataFrame:
    """(u, w, d): the ``K`` nearest of each node within its block of one sorted order."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = -(-batch.num_rows // BLOCK)
            for lo, hi in ((batch.num_rows * i // count, batch.num_rows * (i + 1) // count) for i in range(count)):
                ids, x = batch.column("node").to_numpy()[lo:hi], points_of(batch.column("h").slice(lo, hi - lo))
                d = gaps(x, x).astype(np.float64)
                np.fill_diagonal(d, np.inf)
                k = min(K, len(ids) - 1)
                if k < 1:
                    continue
                at = np.argpartition(d, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(ids[at].ravel()), pa.array(np.take_along_axis(d, at, 1).ravel())], ["u", "w", "d"])

    keyed = halves.select("node", F.col("code")[order].alias("code"), "h")
    return keyed.repartitionByRange(parts, "code", "node").sortWithinPartitions("code", "node").mapInArrow(near, "u bigint, w bigint, d double")


def kept(edges: DataFrame) -> DataFrame:
    """The ``K`` nearest (u, w, d, fresh) of each u; a pair that comes more than once counts as its oldest."""
    single = edges.groupBy("u", "w").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("u").orderBy("d", "w"))
    return single.withColumn("place", place).where(F.col("place") <= K).drop("place")


def met(graph: DataFrame, forward: int, reverse: int) -> DataFrame:
    """(v, u, fresh): who meets at each node: its ``forward`` nearest neighbours and the ``reverse`` nearest of those it is a neighbour of."""

    def nearest(edges: DataFrame, most: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("v").orderBy("d", "u"))
        return edges.withColumn("place", place).where(F.col("place") <= most).select("v", "u", "fresh")

    ahead = graph.select(F.col("u").alias("v"), F.col("w").alias("u"), "d", "fresh")
    return nearest(ahead, forward).unionByName(nearest(graph.select(F.col("w").alias("v"), "u", "d", "fresh"), reverse))


def compared(groups: DataFrame) -> DataFrame:
    """Pairs (u, w, d) among the members (v, u, fresh, far, x) of each v, sorted by v: those with a fresh member that
    are nearer than u's farthest neighbour."""

    def of(v: np.ndarray, u: np.ndarray, fresh: np.ndarray, far: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        heads = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        sizes = np.diff(np.append(heads, len(v)))
        width = int(sizes.max())
        row = np.repeat(np.arange(len(heads)), sizes)
        place = np.arange(len(v)) - np.repeat(heads, sizes)
        ids, new, most = np.full((len(heads), width), -1, np.int64), np.zeros((len(heads), width), bool), np.full((len(heads), width), -1.0)
        points = np.zeros((len(heads), width, x.shape[1]), np.float32)
        real = np.zeros((len(heads), width), bool)
        ids[row, place], new[row, place], most[row, place], points[row, place], real[row, place] = u, fresh, far, x, True
        d = gaps(points, points).astype(np.float64)
        fit = real[:, :, None] & real[:, None, :] & (new[:, :, None] | new[:, None, :]) & (ids[:, :, None] != ids[:, None, :]) & (d < most[:, :, None])
        g, i, j = np.nonzero(fit)
        return pa.RecordBatch.from_arrays([pa.array(ids[g, i]), pa.array(ids[g, j]), pa.array(d[g, i, j])], ["u", "w", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("v", "u", "fresh", "far")) + (points_of(batch.column("x")),)
            if left is not None:
                now = tuple(np.concatenate(pair) for pair in zip(left, now, strict=True))
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last node may go on in the next batch
            left = tuple(a[cut:] for a in now)
            for lo in range(0, cut, 4096):  # heads of pieces are moved to where a node begins
                begin = int(np.searchsorted(now[0][:cut], now[0][lo])) if lo else 0
                end = int(np.searchsorted(now[0][:cut], now[0][lo + 4096])) if lo + 4096 < cut else cut
                if end > begin:
                    yield of(*(a[begin:end] for a in now))
        if left is not None and len(left[0]):
            yield of(*left)

    return groups.mapInArrow(run, "u bigint, w bigint, d double")


def graph_of(nodes: DataFrame, changed: float = CHANGED, rounds: int | None = None) -> DataFrame:
    """(u, w, d, fresh) of the neighbour graph of (node, v), as a table in the shared folder. ``rounds`` ends it early, to show what the start is worth."""
    halves = table(halved(nodes), "halves")
    parts = max(1, -(-halves.count() // PART_ROWS))
    edges = nearest_in_blocks(halves, 0, parts)
    for order in range(1, ORDERS):
        edges = edges.unionByName(nearest_in_blocks(halves, order, parts))
    graph, done = table(kept(edges.withColumn("fresh", F.lit(True))), "graph"), 0
    while rounds is None or done < rounds:
        far = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) < K, F.lit(float("inf"))).otherwise(F.max("d")).alias("far"))
        points = halves.join(far, F.col("node") == F.col("u")).select("u", "far", F.col("h").alias("x"))
        meeting = met(graph, FORWARD, BACK).groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
        news = F.max("fresh").over(Window.partitionBy("v"))  # at most FORWARD + BACK rows
        groups = meeting.withColumn("news", news).where("news").select("v", "u", "fresh").join(points, "u").select("v", "u", "fresh", "far", "x")
        found = compared(groups.repartition("v").sortWithinPartitions("v"))
        merged = graph.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True)))
        better = table(kept(merged), "graph")
        release(graph)
        graph, done = better, done + 1
        count = graph.agg(F.count(F.lit(1)).alias("all"), F.count_if("fresh").alias("fresh")).first()
        if count["fresh"] <= count["all"] * changed:
            break
    release(halves)
    return graph


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """Beams (q, node, d) of the queries (q, own, v): ``own`` is the query's node if it is in the graph, else null."""
    session = nodes.sparkSession
    reach = table(met(graph, K, REVERSE).select(F.col("v").alias("node"), F.col("u").alias("next")).distinct(), "reach")
    entries = nodes.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).toArrow()  # a bounded number of rows
    ids, points = entries.column("node").to_numpy(), matrix(entries.column("v").combine_chunks()) if len(entries) else np.zeros((0, 0))
    sent = session.sparkContext.broadcast((ids, points))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, p = sent.value
        for batch in batches:
            if not batch.num_rows or not len(at):
                continue
            d = gaps(matrix(batch.column("v")), p)
            k = min(BEAM, len(at))
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            q = np.repeat(batch.column("q").to_numpy(), k)
            done = np.tile(np.arange(k) >= STARTS, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(at[near].ravel()), pa.array(done)], ["q", "node", "done"])

    asked = queries.select("q", "v")
    first = asked.mapInArrow(begin, "q bigint, node bigint, done boolean").unionByName(queries.where(F.col("own").isNotNull()).select("q", F.col("own").alias("node"), F.lit(False).alias("done")))
    first = first.groupBy("q", "node").agg(F.min("done").alias("done"))

    def measured(pairs: DataFrame) -> DataFrame:
        return pairs.join(nodes, "node").join(asked.select("q", F.col("v").alias("qv")), "q").select("q", "node", distance(F.col("v"), F.col("qv")).alias("d"), "done")

    best = F.row_number().over(Window.partitionBy("q").orderBy("d", "node"))
    beam = table(measured(first).withColumn("place", best).where(F.col("place") <= BEAM).drop("place"), "beam")
    while not (open_ := beam.where(~F.col("done"))).isEmpty():
        new = open_.select("q", "node").join(reach, "node").select("q", F.col("next").alias("node")).distinct().join(beam.select("q", "node"), ["q", "node"], "left_anti")
        merged = beam.withColumn("done", F.lit(True)).unionByName(measured(new.withColumn("done", F.lit(False))))
        nearer = table(merged.withColumn("place", best).where(F.col("place") <= BEAM).drop("place"), "beam")
        release(beam)
        beam = nearer
    release(reach)
    return beam.select("q", "node", "d")


def neighbours(vectors: DataFrame, is_query: Column, top: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (on the column ``id``) admits, the ``top`` nearest found among all other rows."""
    rows = table(usable(vectors, id_col, vec_col).groupBy("v", "id").agg(F.count(F.lit(1)).alias("n")).drop("n"), "vectors")
    copies = rows.groupBy("v").agg(F.min("id").alias("node"))
    nodes = table(copies.select("node", "v"), "nodes")
    members = table(rows.join(nodes, "v").select("node", "id"), "members")
    graph = graph_of(nodes)
    queries = table(members.where(is_query).join(nodes, "node").select(F.col("id").alias("q"), F.col("node").alias("own"), "v"), "queries")
    beam = search(queries, nodes, graph)
    # a node's copies are equally near: its top + 1 least ids are enough
    least = members.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("place") <= top + 1).select("node", "id")
    listed = beam.join(least, "node").where(F.col("id") != F.col("q"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    ranked = listed.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("d").alias("score"))


def production(vectors: DataFrame) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 100."""
    return neighbours(vectors, F.col("id") % 100 == 0)
