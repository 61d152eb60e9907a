"""Approximate nearest neighbours by inner product: NN-descent builds a graph, queries search it greedily."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .vectors import matrix, usable

#: Neighbours kept per node, reverse neighbours taken along, rounds of descent, and random orders of the start.
K, REVERSE, ROUNDS, STARTS, BLOCK = 24, 24, 4, 4, 384
#: Best candidates that a query keeps, nodes it expands in a hop, hops.
POOL, FRONT, HOPS = 256, 64, 6
#: Nodes of one task of the graph, and of one task of the start.
NODES, START_NODES = 4_000, 20_000
#: Nodes that all queries look at first, how many of them a query keeps, so that none ends with fewer, and how many it walks from besides its own.
ENTRIES, KEPT, DOORS = 1024, 64, 16


def quantise(x: np.ndarray) -> np.ndarray:
    """Rows as a scale and one byte per component: enough to build the graph and to walk in it."""
    scale = (np.abs(x).max(axis=1, keepdims=True) / 127).astype("<f4")
    body = np.rint(x / np.maximum(scale, 1e-30)).clip(-127, 127).astype(np.int8)
    return np.concatenate((scale.view(np.int8).reshape(len(x), 4), body), axis=1)


def restore(packed: list[bytes] | bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(packed if isinstance(packed, bytes) else b"".join(packed), np.int8).reshape(-1, width)
    return raw[:, 4:].astype(np.float32) * raw[:, :4].copy().view("<f4")


def _best(owner: np.ndarray, other: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, for each owner the ``most`` with the highest score, sorted by owner."""
    order = np.lexsort((other, -score, owner))
    owner, other, score = owner[order], other[order], score[order]
    # the same pair has the same score, and stands side by side
    first = np.r_[True, (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])] if len(owner) else np.zeros(0, bool)
    owner, other, score = owner[first], other[first], score[first]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
    rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
    keep = rank < most
    return owner[keep], other[keep], score[keep]


def _edge_batches(owner: np.ndarray, other: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(owner), 100_000):
        s = slice(lo, lo + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(owner[s]), pa.array(other[s]), pa.array(score[s].astype(np.float32))], ["node", "other", "score"])


EDGE = "node long, other long, score float"


def _project(width: int, turns: int, seed: int):
    """Each node once for every random projection, with its value in it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = restore(b.column(1).to_pylist(), width)
            rng = np.random.default_rng(seed)
            for turn in range(turns):
                value = x @ rng.standard_normal(x.shape[1]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), turn, np.int32)), pa.array(value), b.column(0), b.column(1)], ["turn", "value", "node", "packed"])

    return each


def _start(width: int):
    """Nodes that a random projection of the whole table sorts alike are compared in blocks; a partition holds a range of one projection or the border of two."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        turn, value, node = (np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(3))
        x = restore(b"".join(v for b in parts for v in b.column(3).to_pylist()), width)
        found = []
        for t in np.unique(turn):
            inside = np.flatnonzero(turn == t)
            order = inside[np.lexsort((node[inside], value[inside]))]
            for lo in range(0, len(order), BLOCK):
                at = order[lo : lo + BLOCK]
                if len(at) < 2:
                    continue
                s = x[at] @ x[at].T
                np.fill_diagonal(s, -np.inf)
                k = min(K, len(at) - 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                found.append((np.repeat(node[at], k), node[at][top].ravel(), np.take_along_axis(s, top, axis=1).ravel()))
        if found:
            yield from _edge_batches(*_best(*(np.concatenate(c) for c in zip(*found, strict=True)), K))

    return each


def _merge(most: int):
    """Edges of a partition that holds all of its owners' edges: the best of each owner."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if parts:
            yield from _edge_batches(*_best(*(np.concatenate(c) for c in zip(*parts, strict=True)), most))

    return each


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[bytes]]]:
    """Columns of a whole partition sorted by the first one: numbers, and the packed vectors last."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in parts]) for i in range(parts[0].num_columns - 1)]
    packed = [v for b in parts for v in b.column(parts[0].num_columns - 1).to_pylist()]
    order = np.argsort(columns[0], kind="stable")
    yield [c[order] for c in columns], [packed[i] for i in order]


def _local_join(width: int):
    """At each node its neighbours meet: whoever is nearer to another than that one's worst neighbour becomes a candidate."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (at, other, worst), packed in _groups(batches):
            x = restore(packed, width)
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            found, held = [], 0
            for s, e in zip(starts.tolist(), np.r_[starts[1:], len(at)].tolist(), strict=True):
                score = x[s:e] @ x[s:e].T
                score[other[s:e][:, None] == other[s:e][None]] = -np.inf
                a, b = np.nonzero(score > worst[s:e][:, None])
                found.append((other[s:e][a], other[s:e][b], score[a, b]))
                held += len(a)
                if held > 2_000_000:
                    found, held = [_best(*(np.concatenate(c) for c in zip(*found, strict=True)), K)], 0
            yield from _edge_batches(*_best(*(np.concatenate(c) for c in zip(*found, strict=True)), K))

    return each


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node with its neighbours' numbers and vectors in one row."""
    for (at, other), packed in _groups(batches):
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        ends = np.r_[starts[1:], len(at)]
        for lo in range(0, len(starts), 500):
            spans = list(zip(starts[lo : lo + 500].tolist(), ends[lo : lo + 500].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[[s for s, _ in spans]]), pa.array([other[s:e].astype("<i8").tobytes() for s, e in spans], pa.binary()), pa.array([b"".join(packed[s:e]) for s, e in spans], pa.binary())], ["node", "others", "vectors"]
            )


def with_reverse(graph: DataFrame, salt: int) -> DataFrame:
    """Edges and, for each node, up to ``REVERSE`` of those that lead to it: one for each slot that a hash gives them, so that no node gathers more."""
    slot = F.pmod(F.xxhash64("node", "other", F.lit(salt)), F.lit(REVERSE))
    back = graph.groupBy(F.col("other").alias("at"), slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("node", F.lit(salt)).alias("h"), "node"))["node"].alias("to"))
    return graph.select(F.col("node").alias("at"), F.col("other").alias("to")).union(back.select("at", "to")).distinct()


def build(spark: SparkSession, points: DataFrame, width: int, scratch: Scratch, n: int) -> DataFrame:
    """The neighbour graph ``(node, other, score)`` of ``points(node, packed)``, and rounds of neighbours of neighbours.

    It starts from nodes that random projections put side by side. Each projection sorts the whole table anew, so that the ranges that tasks hold overlap and no part of the
    graph stays apart. Beyond ``START_NODES`` the start is further from the nearest, and every doubling gets one more round. In every round each node's neighbours and reverse neighbours meet at it by a join with their vectors, and the candidates go to their nodes, at most K a task.
    """
    parts = partitions(spark, n, NODES)
    turns = points.mapInArrow(_project(width, STARTS, 1), "turn int, value float, node long, packed binary")
    graph = turns.repartitionByRange(max(1, STARTS * n // START_NODES), "turn", "value", "node").mapInArrow(_start(width), EDGE)
    graph = scratch.write(graph.repartition(parts, "node").mapInArrow(_merge(K), EDGE))
    for r in range(ROUNDS + (max(1, n // START_NODES) - 1).bit_length()):
        worst = graph.groupBy("node").agg(F.when(F.count("*") >= K, F.min("score")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
        body = points.join(worst, "node", "left").select(F.col("node").alias("to"), F.coalesce("worst", F.lit(float("-inf")).cast("float")).alias("worst"), "packed")
        meeting = with_reverse(graph, r).join(body, "to").select("at", "to", "worst", "packed")
        found = meeting.repartition(parts, "at").mapInArrow(_local_join(width), EDGE)
        new = scratch.write(graph.union(found).repartition(parts, "node").mapInArrow(_merge(K), EDGE))
        scratch.drop(graph)
        graph = new
    return graph


def _expand(width: int):
    """What a query sees from a node: the node's neighbours with their scores for it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for b in batches:
            for q, query, others, vectors in zip(*(c.to_pylist() for c in b.columns), strict=True):
                other = np.frombuffer(others, "<i8")
                found.append((np.full(len(other), q), other, restore(vectors, width) @ restore(query, width)[0]))
                held += len(other)
            if held > 1_000_000:
                found, held = [_best(*(np.concatenate(c) for c in zip(*found, strict=True)), POOL)], 0
        if found:
            yield from _edge_batches(*_best(*(np.concatenate(c) for c in zip(*found, strict=True)), POOL))

    return each


def _enter(width: int, shared, most: int):
    """The shared entry points that score best for each query."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, packed = shared.value
        x, k = restore(packed, width), min(most, len(node))
        for b in batches:
            if not b.num_rows:
                continue
            query = b.column(0).to_numpy()
            s = restore(b.column(1).to_pylist(), width) @ x.T
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            yield from _edge_batches(np.repeat(query, k), node[top].ravel(), np.take_along_axis(s, top, axis=1).ravel())

    return each


def search(spark: SparkSession, graph: DataFrame, points: DataFrame, queries: DataFrame, width: int, scratch: Scratch, n: int, least: int) -> DataFrame:
    """``(query, node)``: the pool of each query node after a greedy walk.

    A query enters at its own node and at the best of ``ENTRIES`` nodes that all share, of which its pool keeps ``least`` at least: one that starts in a small part of the graph still finds as many.
    All queries walk at once: in a hop each expands its ``FRONT`` best nodes that it hasn't yet, by a join with the nodes' packed neighbourhoods, and keeps the best ``POOL``. Walks end after ``HOPS``, or when none has a node left to expand.
    """
    parts = partitions(spark, n, NODES)
    hood = with_reverse(graph, 99).join(points.select(F.col("node").alias("to"), "packed"), "to").select("at", "to", "packed")
    hood = scratch.write(hood.repartition(parts, "at").mapInArrow(_pack, "node long, others binary, vectors binary"))
    asked = scratch.write(queries.join(points, queries.query == points.node).select("query", F.col("packed").alias("vector")))
    kept = max(KEPT, 2 * least)
    doors = points.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(max(ENTRIES, 4 * kept)).collect()
    shared = spark.sparkContext.broadcast((np.array([r["node"] for r in doors], np.int64), b"".join(bytes(r["packed"]) for r in doors)))
    own = asked.select(F.col("query").alias("node"), F.col("query").alias("other"), F.lit(float("inf")).cast("float").alias("score"))
    pool = scratch.write(own.union(asked.select("query", "vector").mapInArrow(_enter(width, shared, kept), EDGE)))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "other"))
    done = front = scratch.write(pool.withColumn("r", rank).where(F.col("r") <= DOORS + 1).select(F.col("node").alias("query"), "other").distinct())
    for _ in range(HOPS):
        seen = front.join(asked, "query").join(hood, F.col("other") == hood.node).select("query", "vector", "others", "vectors").mapInArrow(_expand(width), EDGE)
        pool = scratch.write(pool.union(seen).repartition(parts, "node").mapInArrow(_merge(max(POOL, kept) + 1), EDGE))
        left = pool.join(done.select(F.col("query").alias("node"), "other"), ["node", "other"], "left_anti")
        front = scratch.write(left.withColumn("r", rank).where(F.col("r") <= FRONT).select(F.col("node").alias("query"), "other"))
        done = done.union(front)
        if not front.limit(1).count():
            break
    return pool.where("node <> other").select(F.col("node").alias("query"), F.col("other").alias("node")).distinct()


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 20_000):
            s = b.slice(lo, 20_000)
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(np.einsum("ij,ij->i", matrix(s.column(2)), matrix(s.column(3))))], ["query", "node", "score"])


def nearest(spark: SparkSession, rows: DataFrame, is_query: F.Column, most: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query`` marks, the ``most`` rows with the largest inner product that a greedy search finds, or all others if they are fewer.

    Graph and walk use one byte a component; the pool is scored in double precision on the original vectors. Equal vectors are one node of the graph, of which the smallest ids
    answer; the query itself never does. Ties go to the smaller id. Vectors that are null, empty, zero or hold null or non-finite components and null ids take no part. Vectors of different lengths have
    no inner product; each length is a table of its own with its own graph. Rows with equal ids are rows of their own, other columns are left out, whatever their names. An empty table gives no rows.
    """
    r = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable("v") & F.col("vec_id").isNotNull())
    out = None
    for (d,) in r.groupBy(F.size("v").alias("d")).agg(F.max("asks").alias("asks")).where("asks").select("d").orderBy("d").collect():
        found = _nearest(spark, r.where(F.size("v") == d), d, most)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _nearest(spark: SparkSession, r: DataFrame, d: int, most: int) -> DataFrame:
    """``nearest`` of rows ``(vec_id, v, asks)`` of one length."""
    scratch = Scratch(spark, "ann")
    width = d + 4
    r = r.withColumns({"k1": F.xxhash64(F.lit(1), "v"), "k2": F.xxhash64(F.lit(2), "v")})
    nodes = r.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.max("asks").alias("asks"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.write(nodes)
    n = nodes.count()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = quantise(matrix(b.column(1))) if b.num_rows else np.zeros((0, width), np.int8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in q], pa.binary())], ["node", "packed"])

    points = scratch.write(nodes.select("node", "v").mapInArrow(packed, "node long, packed binary"))
    if n > 1:
        graph = build(spark, points, width, scratch, n)
        pairs = search(spark, graph, points, nodes.where("asks").select(F.col("node").alias("query")), width, scratch, n, most)
    else:
        pairs = spark.createDataFrame([], "query long, node long")
    # a query's own copies are found without a walk
    pairs = pairs.union(nodes.where("asks and n > 1").select("node", "node"))
    body = nodes.select("node", "v")
    both = pairs.join(body.select(F.col("node").alias("query"), F.col("v").alias("vq")), "query").join(body, "node").select("query", "node", "vq", "v")
    scored = scratch.write(both.mapInArrow(_exact, "query long, node long, score double"))

    named = r.select("vec_id", "asks", "k1", "k2").join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).withColumn("row", F.monotonically_increasing_id())
    named = scratch.write(named.select("vec_id", "asks", "node", "row"))
    # the smallest ids of a node: of a partition first, then of all
    slots = F.row_number().over(Window.partitionBy("node", F.pmod(F.xxhash64("row"), F.lit(64))).orderBy("vec_id", "row"))
    few = named.withColumn("s", slots).where(F.col("s") <= most + 1)
    first = F.row_number().over(Window.partitionBy("node").orderBy("vec_id", "row"))
    few = scratch.write(few.withColumn("s", first).where(F.col("s") <= most + 1).select("node", "vec_id", "row"))
    node_rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    # a node stands for one id at least, but nodes of equal score may have any order of ids
    depth = F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))
    close = scored.withColumns({"i": node_rank, "depth": depth}).where(F.col("depth") <= most + 1)
    found = close.join(few, "node").select("query", "score", "vec_id", "row")
    asks = named.where("asks").select(F.col("node").alias("query"), F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"))
    answer = asks.join(found, "query").where("row <> query_row")
    order = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return answer.withColumn("rank", order).where(F.col("rank") <= most).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
