"""SimHash near-duplicates: word-shingle fingerprints linked by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Unions, partitions, released
from .components import components

#: Rows of one partition of the segment tables.
TABLE_ROWS = 600_000
#: Texts whose shingles are counted to tell common ones, and how many of these are told at most.
SAMPLE, COMMON = 5_000, 100_000
#: Entries that meet at once with their texts' sketches, or eight for each text if that is more; beyond it the buckets are taken in turns.
MOST_ENTRIES = 500_000
#: Compressed texts that meet at once in the buckets, or one for each text if that is more.
MOST_TEXTS = 50_000
#: Buckets above this size are split once more by the bytes of the other segment.
WIDE = 2048


def _digests(text: bytes, words_each: int, seed: int) -> bytes:
    """XXH64 of every word shingle of a text, one after the other."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    n = len(words)
    if not n:
        return b""
    joined = b" ".join(words)
    k = min(words_each, n)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: n - k]]
    return b"".join([xxh64_digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[k - 1 :], strict=True)])


def _majority(hashes: bytes) -> int:
    """64 bits, of which one is set if it is set in over half of the hashes."""
    m = len(hashes) // 8
    if not m:
        return 0
    # Eight one-byte counters share a machine word; 255 hashes can't overflow them.
    lanes = np.unpackbits(np.frombuffer(hashes, np.uint8)).view(np.uint64).reshape(m, 8)
    sums = np.add.reduceat(lanes, np.arange(0, m, 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > m).tobytes(), "big")


def fingerprint(text: bytes, words_each: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text: a bit is set if it is set in over half of the XXH64 hashes of the word shingles."""
    return _majority(_digests(text, words_each, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp long)`` of every row; a null text counts as empty and has fingerprint zero.

    A-Z are lower-cased, words are runs of characters other than ASCII white space; texts with fewer words than a shingle
    hash the whole word sequence. Repeated rows and ids are kept.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", words_each, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(each, f"doc_id {kind}, fp long")


def _distinct(hashes: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(hashes, np.int64))


def shingle_hashes(text: bytes, words_each: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in ascending order."""
    return _distinct(_digests(text, words_each, seed))


def odd_sketch(h: np.ndarray) -> bytes:
    """Bits that tell of which remainders there is an odd number of hashes: about a bit for each, a power of two of them.

    Two sets differ in at least as many elements as their sketches in bits, once the longer one is folded to the length of the shorter.
    """
    size = min(max(64, 1 << max(0, len(h) - 1).bit_length()), 1 << 14)
    return np.packbits(np.bincount(h & (size - 1), minlength=size).astype(np.uint8) & 1).tobytes()


def sketched_difference(a: bytes, b: bytes) -> int:
    """Of two sets, given by their sketches, the least number of elements that only one of them has."""
    if len(a) > len(b):
        a, b = b, a
    x = np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, len(a) // 8), axis=0) if len(a) < len(b) else np.frombuffer(b, np.uint64)
    return int(np.bitwise_count(x ^ np.frombuffer(a, np.uint64)).sum())


def _prefix(words_each: int, least: float, shared):
    """Of every text its fingerprint, the number of its shingles, their sketch and the first of them, rare ones before common ones: two texts with a similarity of at least ``least`` have one of these in common."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = shared.value
        for b in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
            fp, size, sketch, first = [], [], [], []
            for t in b.column(3).to_pylist():
                hashes = _digests(t, words_each, 42)
                fp.append(_majority(hashes))
                h = _distinct(hashes)
                size.append(len(h))
                sketch.append(odd_sketch(h))
                if len(h) and len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.argsort(np.where(common[at] == h, rank[at], 0), kind="stable")]
                first.append(h[: len(h) - math.ceil(least * len(h) - 1e-9) + 1].tobytes() if len(h) else bytes(8))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(sketch, pa.binary()), pa.array(first, pa.binary())], ["t1", "t2", "doc_id", "fp", "n", "sketch", "first"])

    return each


#: Entries of texts under their prefix shingles that go to one shard, as bytes of key, text, number of shingles and place.
ENTRIES = "shard int, packed binary"
ENTRY = np.dtype([("key", "<i8"), ("rep", "<i8"), ("n", "<i4"), ("place", "<i4")])


def _prefix_entries(shards: int):
    """The entries of many texts at once, in one compressed row for each shard."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)

        def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            x = np.concatenate(held)
            shard = (x["key"].view(np.uint64) % np.uint64(shards)).astype(np.int32)
            order = np.lexsort((x["key"], shard))
            x, shard = x[order], shard[order]
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            rows = [press.compress(_apart(part)) for part in np.split(x, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(shard[starts]), pa.array(rows, pa.binary())], ["shard", "packed"])

        held, size = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                s = b.slice(lo, 1000)
                first = [np.frombuffer(x, np.int64) for x in s.column(2).to_pylist()]
                count = np.array([len(x) for x in first], np.int64)
                x = np.empty(count.sum(), ENTRY)
                x["key"], x["rep"], x["n"] = np.concatenate(first), np.repeat(s.column(0).to_numpy(), count), np.repeat(s.column(1).to_numpy(), count)
                x["place"] = np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
                held.append(x)
                size += len(x)
                if size > 1_000_000:
                    yield from out(held)
                    held, size = [], 0
        if held:
            yield from out(held)

    return each


def _apart(x: np.ndarray) -> bytes:
    """Entries sorted by key: of each column all first bytes, then all second ones and so on; keys as steps from one to the next."""
    columns = [np.diff(x["key"].view(np.uint64), prepend=np.uint64(0)), *(np.ascontiguousarray(x[c]) for c in ENTRY.names[1:])]
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(x), -1).T).tobytes() for c in columns)


def _together(packed: bytes) -> np.ndarray:
    n = len(packed) // ENTRY.itemsize
    x, at = np.empty(n, ENTRY), 0
    for c in ENTRY.names:
        width = ENTRY[c].itemsize
        x[c] = np.ascontiguousarray(np.frombuffer(packed, np.uint8, n * width, at).reshape(width, n).T).view(ENTRY[c]).ravel()
        at += n * width
    x["key"] = np.cumsum(x["key"].view(np.uint64), dtype=np.uint64).view(np.int64)
    return x


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of a partition whose key another text has too."""
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    parts = [_together(unpress.decompress(p)) for b in batches for p in b.column(1).to_pylist()]
    if parts:
        x = np.concatenate(parts)
        del parts
        x = x[np.argsort(x["key"], kind="stable")]
        same = x["key"][1:] == x["key"][:-1]
        x = x[np.r_[False, same] | np.r_[same, False]]
        for lo in range(0, len(x), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[c][lo : lo + 100_000])) for c in ENTRY.names], ["key", "rep", "n", "place"])


def _not_ruled_out(least: float):
    """Pairs that may be similar by their sketches; none that is gets lost."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = (b.column(2).to_numpy() + b.column(3).to_numpy()) * (1 - least) / (1 + least) + 1e-6
            differ = np.array([sketched_difference(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], np.int64)
            yield b.select([0, 1]).filter(pa.array(differ <= n))

    return each


def _fits(least: float, n: np.ndarray, place: np.ndarray, root: np.ndarray):
    """Which pairs of entries are of different components and not too different in size and place."""

    def fits(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        # what the pair can share from here on must be enough; of the first shingle they share this is exact
        can = np.minimum(n[p] - place[p], n[q] - place[q])
        need = least / (1 + least) * (n[p] + n[q]) - 1e-9
        return (root[p] != root[q]) & ((n[p] + n[q] == 0) | (can >= need))

    return fits


def _columns(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    key, rep, n, place, root = (np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(5))
    return key, rep, n.astype(np.int64), place.astype(np.int64), root


def _neighbours(least: float, orders: tuple[int, ...]):
    """Pairs of texts of different components that are neighbours in a bucket in one of the given orders, and not too different in size and place."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        key, rep, n, place, root = _columns(parts)
        del parts
        fits = _fits(least, n, place, root)
        found = []
        for order in orders:
            by = n if not order else (rep.view(np.uint64) + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
            sort = np.lexsort((rep, by, key))
            p, q = sort[:-1], sort[1:]
            met = (key[p] == key[q]) & fits(p, q)
            found.append((rep[p[met]], rep[q[met]]))
        u, v = (np.concatenate(x) for x in zip(*found, strict=True))
        both = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), axis=1), axis=0)
        for lo in range(0, len(both), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(both[lo : lo + 100_000, 0].copy()), pa.array(both[lo : lo + 100_000, 1].copy())], ["u", "v"])

    return each


def _not_ruled_out_in_buckets(least: float, key: np.ndarray, rep: np.ndarray, n: np.ndarray, place: np.ndarray, root: np.ndarray, text: np.ndarray, sketches: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of all pairs of entries in a bucket those of different components that neither size, place nor sketches rule out, and the bits in which their sketches differ; each pair of texts once in a yield. ``text`` is the number of an entry's sketch."""
    fits = _fits(least, n, place, root)
    # the sketch of each text once, in rows of equal length
    width = np.array([len(x) // 8 for x in sketches])
    line = np.empty(len(sketches), np.int64)
    tables = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        line[at], tables[w] = np.arange(len(at)), np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint64).reshape(-1, w)

    def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        a, b = text[p], text[q]
        swap = width[a] > width[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        for v in np.unique(width[a]).tolist():
            for w in np.unique(width[b[width[a] == v]]).tolist():
                at = np.flatnonzero((width[a] == v) & (width[b] == w))
                for lo in range(0, len(at), 1 + (1 << 20) // w):
                    some = at[lo : lo + 1 + (1 << 20) // w]
                    folded = np.bitwise_xor.reduce(tables[w][line[b[some]]].reshape(len(some), -1, v), axis=1)
                    out[some] = np.bitwise_count(tables[v][line[a[some]]] ^ folded).sum(axis=1, dtype=np.int64)
        return out

    def ruled(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, q = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b = text[p], text[q]
        _, once = np.unique(np.minimum(a, b) * len(sketches) + np.maximum(a, b), return_index=True)
        p, q = p[once], q[once]
        differ = differences(p, q)
        can = differ <= (n[p] + n[q]) * (1 - least) / (1 + least) + 1e-6
        return p[can], q[can], differ[can]

    sort = np.lexsort((rep, n, key))
    starts = np.flatnonzero(np.r_[True, key[sort[1:]] != key[sort[:-1]]])
    ends = np.r_[starts[1:], len(key)]
    mixed = np.minimum.reduceat(root[sort], starts) != np.maximum.reduceat(root[sort], starts)
    found, held = [], 0
    for s, e in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
        for i in range(s, e, 512):
            for j in range(i, e, 512):
                x, y = sort[i : min(i + 512, e)], sort[j : min(j + 512, e)]
                p, q = np.nonzero(root[x][:, None] != root[y][None])
                if i == j:
                    p, q = p[p < q], q[p < q]
                p, q = x[p], y[q]
                can = fits(p, q)
                found.append((p[can], q[can]))
                held += int(can.sum())
                if held > 500_000:
                    yield ruled(found)
                    found, held = [], 0
    if found:
        yield ruled(found)


#: Entries of texts that may be similar to a text of another component in the same bucket.
OPEN = "key long, rep long, n int, place int, root long"


def _open_entries(least: float):
    """The entries that have a partner in their bucket which sketches don't rule out: a row for an entry, however many partners it has."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        key, rep, n, place, root = _columns(parts)
        _, first, text = np.unique(rep, return_index=True, return_inverse=True)
        sketches = pa.chunked_array([b.column(5) for b in parts]).take(pa.array(first)).to_pylist()
        del parts
        is_open = np.zeros(len(key), bool)
        for p, q, _ in _not_ruled_out_in_buckets(least, key, rep, n, place, root, text, sketches):
            is_open[p] = is_open[q] = True
        at = np.flatnonzero(is_open)
        for lo in range(0, len(at), 100_000):
            x = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[x], rep[x], n[x].astype(np.int32), place[x].astype(np.int32), root[x])], ["key", "rep", "n", "place", "root"])

    return each


def _links_in_buckets(words_each: int, least: float):
    """Links that connect what similar texts in the buckets of a partition connect: at most one less than there are components.

    Pairs that sketches don't rule out are taken closest first, and none whose texts hang together already. Shingles are compared by their hashes, and a link is verified on the texts.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        unpress = zstandard.ZstdDecompressor()
        key, rep, n, place, root = _columns(parts)
        nodes, first, text = np.unique(rep, return_index=True, return_inverse=True)
        packed = pa.chunked_array([b.column(5) for b in parts]).take(pa.array(first)).to_pylist()
        del parts
        hashes = [shingle_hashes(unpress.decompress(t), words_each) for t in packed]
        _, group = np.unique(root[first], return_inverse=True)
        up = list(range(len(nodes)))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        links = []
        for p, q, differ in _not_ruled_out_in_buckets(least, key, rep, n, place, root, text, [odd_sketch(h) for h in hashes]):
            closest = np.argsort(differ / np.maximum(n[p] + n[q], 1), kind="stable")
            for a, b in zip(text[p[closest]].tolist(), text[q[closest]].tolist(), strict=True):
                x, y = top(group[a]), top(group[b])
                if x == y:
                    continue
                g, h = hashes[a], hashes[b]
                common = len(np.intersect1d(g, h, assume_unique=True))
                if common >= least * (len(g) + len(h) - common) and _alike(unpress.decompress(packed[a]), unpress.decompress(packed[b]), words_each, least):
                    up[max(x, y)] = min(x, y)
                    links.append((a, b))
        if links:
            u, v = nodes[np.array(links, np.int64)].T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return each


def _alike(a: bytes, b: bytes, words_each: int, least: float) -> bool:
    """Whether the distinct word shingles of two texts have a Jaccard similarity of at least ``least``."""

    def shingles(text: bytes) -> set[bytes]:
        words = text.lower().split()
        k = min(words_each, len(words))
        return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()

    p, q = shingles(a), shingles(b)
    common = len(p & q)
    return common >= least * (len(p) + len(q) - common)


def _similar(words_each: int, least: float):
    """Pairs whose distinct word shingles have a Jaccard similarity of at least ``least``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for b in batches:
            keep = [_alike(unpress.decompress(x.as_py()), unpress.decompress(y.as_py()), words_each, least) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return each


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for b in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
        yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([press.compress(t) for t in b.column(2).to_pylist()], pa.binary())], ["t1", "t2", "text"])


def similar_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, least: float = 0.8) -> DataFrame:
    """``(t1, t2, rep, component, stays)`` of every distinct text: texts linked by a similarity of at least ``least`` share the smallest of their ids.

    SimHash by multi-index hashing comes first: texts whose fingerprints differ in at most three bits are the first candidates. What fingerprints miss or a forest of their links leaves apart is
    found by an exact prefix-filter join: of a text's distinct shingles of ``words_each`` words, ordered from rare to common, the first n - ceil(least * n) + 1 are entered; two texts as similar as ``least``
    share one of them. The order comes from the counts of a sample, which decides how long buckets are and not what is found. Candidates whose sketches differ in more bits than similar texts
    have different shingles are none; every other one is verified by the exact Jaccard similarity of the texts unless both already hang together by verified links: neighbours in each bucket in
    two orders first, so that large groups grow together, then all pairs that are left. Of these no row is made: sketches meet in the buckets and tell which entries have a partner that they
    don't rule out, then the compressed texts of such entries meet there, some buckets at a time, and each partition yields a spanning forest of the links that it has verified.
    ``t1`` and ``t2`` are two digests of the text, ``rep`` is the smallest id among its copies, null if none has an id, and ``component`` the smallest in the group. ``stays`` marks one text of
    each group: that with the smallest id, and where ids are null or equal with the smallest digests. Null texts count as empty; an empty table gives no rows.
    """
    scratch = Scratch(spark, "similar")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.withColumns({"t1": F.xxhash64(F.lit(1), "text"), "t2": F.xxhash64(F.lit(2), "text")})

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(lo, 100) for b in batches for lo in range(0, b.num_rows, 100)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_hashes(t, words_each) for t in b.column(0).to_pylist()]))], ["h"])

    sample = rows.where(F.pmod(F.xxhash64("t1", "t2"), F.lit(max(1, docs.count() // SAMPLE))) == 0).select("text")
    often = sample.mapInArrow(released(hashes), "h long").groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).toPandas().sort_values("h")
    shared = spark.sparkContext.broadcast((often["h"].to_numpy(np.int64), often["count"].to_numpy(np.int64)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    printed = rows.select("t1", "t2", "doc_id", "text").mapInArrow(released(_prefix(words_each, least, shared)), f"t1 long, t2 long, doc_id {kind}, fp long, n int, sketch binary, first binary")
    one = printed.groupBy("t1", "t2").agg(F.min("doc_id").alias("least_id"), F.first(F.struct("fp", "n", "sketch", "first")).alias("p"))
    heads = scratch.write(one.select("t1", "t2", "least_id", "p.*").withColumn("rep", F.monotonically_increasing_id()))
    n = heads.count()
    parts = partitions(spark, 70 * n, TABLE_ROWS)
    entries = heads.select("rep", "n", "first").mapInArrow(released(_prefix_entries(parts)), ENTRIES).repartition(parts, "shard")
    entries = scratch.write(entries.mapInArrow(released(_met), "key long, rep long, n int, place int"))
    keys = scratch.write(heads.drop("first"))
    scratch.drop(heads)
    end = lambda c: keys.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    turns = math.ceil(entries.count() / max(MOST_ENTRIES, 8 * n)) or 1

    def placed(own: DataFrame) -> DataFrame:
        return own.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", "place", F.coalesce("root", "rep").alias("root"))

    def gathered(ids: DataFrame) -> DataFrame:
        wanted = keys.join(ids, keys.rep == ids.doc_id, "left_semi").select("t1", "t2", F.col("rep").alias("doc_id"))
        packed = rows.select("t1", "t2", "text").mapInArrow(released(_pressed), "t1 long, t2 long, text binary")
        return scratch.write(packed.join(wanted, ["t1", "t2"]).dropDuplicates(["doc_id"]).select("doc_id", "text"))

    verified = true = roots = None
    for step in ("fingerprints", "neighbours"):
        found = near_fingerprints(keys) if step == "fingerprints" else placed(entries).repartition(parts, "key").mapInArrow(released(_neighbours(least, (0, 1))), "u long, v long").distinct()
        found = found if verified is None else found.join(verified, ["u", "v"], "left_anti")
        pairs = scratch.write(found.join(end("u"), "u").join(end("v"), "v").select("u", "v", "n_u", "n_v", "s_u", "s_v").mapInArrow(released(_not_ruled_out(least)), "u long, v long"))
        texts = gathered(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct())
        both = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v")
        links = scratch.write(both.select("u", "v", "a", "b").mapInArrow(released(_similar(words_each, least)), "u long, v long"))
        scratch.drop(texts)
        verified, true = (pairs, links) if verified is None else (verified.union(pairs), true.union(links))
        roots = scratch.write(components(true, scratch))

    def in_turns(table: DataFrame, of: int, made) -> DataFrame:
        tables = [scratch.write(made(table if of == 1 else table.where(F.pmod(F.xxhash64("key"), F.lit(of)) == i))) for i in range(of)]
        return reduce(DataFrame.union, tables)

    sketched = lambda own: placed(own).join(keys.select("rep", "sketch"), "rep").select("key", "rep", "n", "place", "root", "sketch")
    still = in_turns(entries, turns, lambda own: sketched(own).repartition(parts, "key").mapInArrow(released(_open_entries(least)), OPEN))
    texts = gathered(still.select(F.col("rep").alias("doc_id")).distinct())
    with_text = lambda own: own.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("key", "rep", "n", "place", "root", "text")
    turns = math.ceil(still.count() / max(MOST_TEXTS, n)) or 1
    true = true.union(in_turns(still, turns, lambda own: with_text(own).repartition(parts, "key").mapInArrow(released(_links_in_buckets(words_each, least)), "u long, v long")))
    roots = scratch.write(components(true, scratch))
    scratch.drop_all_but(keys, roots)
    named = keys.join(roots, keys.rep == roots.node, "left").select("t1", "t2", F.col("least_id").alias("rep"), F.coalesce("root", "rep").alias("root"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "t1", "t2")).alias("first"))
    found = named.join(first, "root")
    return found.select("t1", "t2", "rep", F.col("first.rep").alias("component"), ((F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))).alias("stays"))


def near_fingerprints(keys: DataFrame, most_bits: int = 3) -> DataFrame:
    """``(u, v)``, u < v: of the texts of ``keys(rep, fp)`` pairs whose fingerprints are equal or differ in at most ``most_bits`` bits, enough to connect all that do."""
    distinct = keys.groupBy("fp").agg(F.min("rep").alias("rep"))
    entries = distinct.mapInArrow(_tables, "key long, probe boolean, fp long, rep long")
    near = entries.repartition(partitions(keys.sparkSession, 36 * distinct.count(), TABLE_ROWS), "key").mapInArrow(released(_spanning(most_bits)), "u long, v long")
    equal = keys.select("fp", F.col("rep").alias("v")).join(distinct, "fp").where("rep <> v").select(F.col("rep").alias("u"), "v")
    return near.union(equal).distinct()


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without those that another row stands for: of each group of copies and near copies the row with the smallest id stays.

    Near copies are found by SimHash and multi-index hashing, verified on the texts, and completed by an exact join (``similar_groups``).

    Where the ids of a group are null, one of its rows stays; of equal rows all but one go. Different texts with one id are texts of their own. Null texts are empty ones. Columns and their names are those of ``docs``.
    """
    groups = similar_groups(spark, docs, id_col, text_col, words_each, least)
    best = groups.where("stays").select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("rep").alias("__rep"))
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    keyed = docs.withColumns({"__t1": F.xxhash64(F.lit(1), body), "__t2": F.xxhash64(F.lit(2), body)})
    stays = keyed.join(best, ["__t1", "__t2"]).where(F.col(id_col).eqNullSafe(F.col("__rep")))
    return stays.dropDuplicates(["__t1", "__t2"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under its own value of both 32-bit segments and under all values one set bit away.

    Of two values one bit apart, exactly one has the bit clear; only that one looks for the other.
    """
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        rep = b.column(1).to_numpy()
        for seg in (0, 1):
            half = ((fp >> np.uint64(32 * seg)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            tag = np.int64(seg) << np.int64(32)
            rows = [(half | tag, np.zeros(len(half), bool), np.arange(len(half)))]
            for bit in range(32):
                clear = np.flatnonzero((half >> bit) & 1 == 0)
                rows.append((half[clear] | tag | (1 << bit), np.ones(len(clear), bool), clear))
            key, probe, at = (np.concatenate(x) for x in zip(*rows, strict=True))
            for lo in range(0, len(key), 100_000):
                s = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(probe[s]), pa.array(fp[at[s]].view(np.int64)), pa.array(rep[at[s]])], ["key", "probe", "fp", "rep"])


def _matches(key: np.ndarray, probe: np.ndarray, fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs in the same bucket, one of them a table entry, that differ in at most ``most`` bits. Sorted by key, then probe."""
    n = len(key)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], n]
    end_of = np.repeat(ends, ends - starts)
    wide = ends - starts > 64
    # narrow buckets: all distances between entries of a bucket, one offset after the other
    at = np.flatnonzero(~np.repeat(wide, ends - starts) & ~probe)
    step = 1
    while len(at):
        at = at[at + step < end_of[at]]
        near = np.bitwise_count(fp[at] ^ fp[at + step]) <= most
        yield at[near], at[near] + step
        step += 1
    for s, e in zip(starts[wide], ends[wide], strict=True):
        t = s + int(np.searchsorted(probe[s:e], True))
        if t == s:
            continue
        if e - s <= WIDE:
            yield from _blocks(np.arange(s, t), np.arange(s, e), fp, most)
            continue
        # two values at most 3 bits apart agree in one of the four bytes of any segment or are one bit apart in each of three
        seg = 1 - int(key[s] >> 32)
        other = (fp[s:e] >> np.uint64(32 * seg)).astype(np.uint32)
        for byte in range(4):
            value = (other >> np.uint32(8 * byte)) & np.uint32(0xFF)
            for v in np.unique(value[: t - s]):
                inside = np.flatnonzero(value == v)
                yield from _blocks(s + inside[inside < t - s], s + inside, fp, most)


def _blocks(a: np.ndarray, b: np.ndarray, fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(a), 1024):
        for j in range(0, len(b), 1024):
            x, y = a[i : i + 1024], b[j : j + 1024]
            p, q = np.nonzero(np.bitwise_count(fp[x][:, None] ^ fp[y][None]) <= most)
            yield x[p], y[q]


def _links(most: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        key, probe, fp, rep = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((probe, key))
        key, probe, fp, rep = key[order], probe[order], fp[order].view(np.uint64), rep[order]
        nodes, at = np.unique(rep, return_inverse=True)
        sets = Unions(len(nodes))
        for a, b in _matches(key, probe, fp, most):
            sets.union(at[a], at[b])
        root = sets.labels()
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["u", "v"])

    return each


def _spanning(most: int):
    """Of the pairs in the buckets of a partition that differ in at most ``most`` bits those that connect what others don't, and few more."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        key, probe, fp, rep = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((probe, key))
        key, probe, fp, rep = key[order], probe[order], fp[order].view(np.uint64), rep[order]
        nodes, at = np.unique(rep, return_inverse=True)
        sets = Unions(len(nodes))
        for a, b in _matches(key, probe, fp, most):
            x, y = sets.roots(at[a]), sets.roots(at[b])
            _, new = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0, return_index=True)
            new = new[x[new] != y[new]]
            sets.union(at[a[new]], at[b[new]])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[a[new]], rep[b[new]])), pa.array(np.maximum(rep[a[new]], rep[b[new]]))], ["u", "v"])

    return each


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, most_bits: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``: documents whose fingerprints are linked, directly or through others, share the smallest id.

    Multi-index hashing: fingerprints within ``most_bits`` (at most 3) bits have a 32-bit segment in which they differ in at
    most one bit. Every distinct fingerprint is entered once under each segment and looks in the Hamming ball of radius
    one around it; what meets in a bucket is verified on all 64 bits. Copies share a fingerprint and are represented by
    their smallest id, so that a group of copies costs one entry. A bucket yields a spanning forest, never all its pairs;
    wide buckets are split by the bytes of the other segment first, which loses nothing up to three bits.
    Rows with a null id keep their row, with a null component unless a linked document has an id. Empty input gives no rows.
    """
    if not 0 <= most_bits <= 3:
        raise ValueError("two segments with balls of radius one find up to three bits")
    scratch = Scratch(spark, "simhash")
    own = scratch.write(fingerprints(docs, id_col, text_col, words_each))
    distinct = scratch.write(own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    n = distinct.count()
    entries = distinct.mapInArrow(_tables, "key long, probe boolean, fp long, rep long")
    links = entries.repartition(partitions(spark, 36 * n, TABLE_ROWS), "key").mapInArrow(released(_links(most_bits)), "u long, v long")
    roots = components(links, scratch)
    named = distinct.join(roots, distinct.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return own.join(named, "fp", "left").select("doc_id", "fp", "component_id")
