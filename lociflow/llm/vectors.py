"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, null_key, partitions
from .components import components

#: Code bits, segments of the code, and rows of one partition of the segment tables.
BITS, SEGMENTS, TABLE_ROWS = 64, 4, 400_000
WIDTH = BITS // SEGMENTS
#: Bits of a label's digest in the key of a bucket; labels that share them are told apart afterwards.
LABEL_BITS = np.int64((1 << 45) - 1)


def usable(col: str) -> F.Column:
    """Whether an array column holds a vector: not null or empty, no null or non-finite component, not all zero."""
    c = F.col(col)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.size(c) > 0, F.lit(False)) & F.coalesce(F.forall(c, fine), F.lit(False)) & F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: no bit of a cosine changes, and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None]) if len(x) else x


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(sample: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 5, most_mean: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """``(mean, projection)`` of iterative quantisation: principal directions, turned so that signs lose as little as possible.

    With fewer dimensions than bits the remaining bits come from further random turns of the same directions. The mean is taken off only if it is short: then an angle hardly grows. From vectors that
    share a direction nothing is taken, as near what they share even small angles would turn into any angle; their codes are alike, and what is alike is compared exactly.
    """
    rng = np.random.default_rng(seed)
    unit = unit_rows(sample)
    mean = unit.mean(axis=0)
    if np.linalg.norm(mean) > most_mean:
        mean = np.zeros_like(mean)
    x = unit - mean
    d = x.shape[1]
    values, directions = np.linalg.eigh(x.T @ x / max(len(x), 1))
    columns = []
    left = bits
    while left > 0:
        k = min(left, d)
        w = directions[:, ::-1][:, :k]
        turn = np.linalg.qr(rng.standard_normal((k, k)))[0]
        v = x @ w
        for _ in range(rounds):
            u, _, t = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ t).T
        columns.append(w @ turn)
        left -= k
    return mean, np.concatenate(columns, axis=1)


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """64-bit codes of the rows of x."""
    return np.packbits((unit_rows(x) - mean) @ projection >= 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _entries(mean: np.ndarray, projection: np.ndarray):
    """Each vector under its own value of every segment and under all values one bit away."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate(([0], 1 << np.arange(WIDTH))).astype(np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                s = b.slice(lo, 2000)
                cls, label = s.column(0).to_numpy(), s.column(1).to_numpy().astype(np.int64)
                code = codes(matrix(s.column(2)), mean, projection)
                for seg in range(SEGMENTS):
                    value = ((code >> np.uint64(WIDTH * seg)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
                    key = ((((label & LABEL_BITS) << 2 | seg) << WIDTH)[:, None] | (value[:, None] ^ flips)).ravel()
                    n = len(flips)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(code.view(np.int64), n)), pa.array(np.repeat(cls, n))], ["key", "code", "cls"])

    return each


def first_meeting(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether this bucket is the first of those in which two codes meet: in their nearest possible segment order, at the smallest common key."""
    seg = (key >> WIDTH) & 3
    value = (key & ((1 << WIDTH) - 1)).astype(np.uint64)
    x = a ^ b
    mask = np.uint64((1 << WIDTH) - 1)
    first = np.full(len(a), -1, np.int64)
    for s in reversed(range(SEGMENTS)):
        first[np.bitwise_count((x >> np.uint64(WIDTH * s)) & mask) <= 2] = s
    shift = (WIDTH * seg).astype(np.uint64)
    u, v = (a >> shift) & mask, (b >> shift) & mask
    differ = u ^ v
    low = differ & (~differ + np.uint64(1))
    apart = np.bitwise_count(differ)
    meet = np.where(apart == 2, np.minimum(u ^ low, u ^ low ^ differ), np.minimum(u, v))
    return (first == seg) & (meet == value)


def _pairs(most: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        key, code, cls = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(key, kind="stable")
        key, code, cls = key[order], code[order].view(np.uint64), cls[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        wide = ends - starts > 64

        def found(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            near = np.bitwise_count(code[i] ^ code[j]) <= most
            i, j = i[near], j[near]
            once = first_meeting(code[i], code[j], key[i])
            i, j = cls[i[once]], cls[j[once]]
            for lo in range(0, len(i), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(i[lo : lo + 100_000]), pa.array(j[lo : lo + 100_000])], ["a", "b"])

        end_of = np.repeat(ends, ends - starts)
        at, step = np.flatnonzero(~np.repeat(wide, ends - starts)), 1
        while len(at):
            at = at[at + step < end_of[at]]
            yield from found(at, at + step)
            step += 1
        for s, e in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
            for i in range(s, e, 1024):
                for j in range(i, e, 1024):
                    p, q = np.meshgrid(np.arange(i, min(i + 1024, e)), np.arange(j, min(j + 1024, e)), indexing="ij")
                    upper = p < q
                    yield from found(p[upper], q[upper])

    return each


def _cosines(least: float):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 20_000):
                s = b.slice(lo, 20_000)
                x, y = scaled(matrix(s.column(2))), scaled(matrix(s.column(3)))
                cosine = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                keep = np.flatnonzero(cosine >= least)
                yield pa.RecordBatch.from_arrays([s.column(0).take(pa.array(keep)), s.column(1).take(pa.array(keep)), pa.array(cosine[keep])], ["a", "b", "cosine"])

    return each


def near_duplicates(spark: SparkSession, rows: DataFrame, least: float = 0.93, most_bits: int = 18, sample: int = 20_000, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row: vectors of one label with cosine of at least ``least``.

    Iterative quantisation learns a rotation on the ``sample`` vectors with the smallest hash of their id and gives every vector a 64-bit code. Multi-index tables hold each code under its value, and under all
    values one bit away, of four 16-bit segments, so that codes meet if they differ in at most two bits of a segment: always up to 11 bits in all, and nearly
    always up to ``most_bits``. What meets is compared on the whole code, once, and then by cosine in double precision on the original vectors.

    Equal vectors of a label are one entry with a count: they are linked without being paired. Vectors that are null, empty, zero or hold null or non-finite components, null labels and null ids
    link with nothing. Labels may be of any type. Vectors of different lengths have no cosine; each length is a table of its own with its own rotation. Rows with equal ids are rows of their own, other
    columns are left out, whatever their names. A component's id is the smallest vec_id in it. An empty table gives no rows.
    """
    scratch = Scratch(spark, "vectors")
    r = rows.select(F.col(id_col).alias("vec_id"), null_key(label_col).alias("label"), F.col(label_col).isNotNull().alias("labelled"), F.col(vec_col).cast("array<double>").alias("v"))
    r = r.withColumn("ok", usable("v") & F.col("labelled") & F.col("vec_id").isNotNull())
    keyed = r.withColumns({"k1": F.xxhash64(F.lit(1), "label", "v"), "k2": F.xxhash64(F.lit(2), "label", "v")})
    own = keyed.select("vec_id", "ok", F.when(F.col("ok"), F.col("k1")).alias("k1"), F.when(F.col("ok"), F.col("k2")).alias("k2"))
    classes = keyed.where("ok").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = scratch.write(classes.withColumns({"cls": F.monotonically_increasing_id(), "d": F.size("v"), "lab": F.xxhash64("label")}))
    parts = partitions(spark, classes.count() * SEGMENTS * (WIDTH + 1), TABLE_ROWS)

    links = None
    for (d,) in classes.groupBy("d").count().where("count > 1").select("d").orderBy("d").collect():
        own_length = classes.where(F.col("d") == d)
        learned = own_length.orderBy(F.xxhash64("least_id"), "least_id").limit(sample).select("v").toPandas()["v"]
        mean, projection = learn(np.array(learned.tolist(), np.float64))
        entries = own_length.select("cls", "lab", "v").mapInArrow(_entries(mean, projection), "key long, code long, cls long")
        pairs = entries.repartition(parts, "key").mapInArrow(_pairs(most_bits), "a long, b long")
        body = own_length.select("cls", "label", "v")
        both = pairs.join(body.select(F.col("cls").alias("a"), F.col("label").alias("la"), F.col("v").alias("va")), "a").join(body.select(F.col("cls").alias("b"), F.col("label").alias("lb"), F.col("v").alias("vb")), "b")
        found = scratch.write(both.where("la = lb").select("a", "b", "va", "vb").mapInArrow(_cosines(least), "a long, b long, cosine double"))
        links = found if links is None else links.union(found)
    if links is None:
        links = spark.createDataFrame([], "a long, b long, cosine double")

    counts = classes.select(F.col("cls").alias("other"), F.col("n").alias("n_other"))
    ends = links.select(F.col("a").alias("cls"), F.col("b").alias("other")).union(links.select("b", "a"))
    degree = ends.join(counts, "other").groupBy("cls").agg(F.sum("n_other").alias("linked"))
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    named = classes.select("cls", "k1", "k2", "n", "least_id").join(roots, classes.cls == roots.node, "left").withColumn("root", F.coalesce("root", "cls")).drop("node")
    smallest = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(degree, "cls", "left").join(smallest, "root").select("k1", "k2", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = own.join(named, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id").cast("long")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
