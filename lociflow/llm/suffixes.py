"""Repeated long substrings by deep-shallow sorting of a sampled suffix array, and their removal."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, released

#: Depth in bytes to which suffixes are ordered by multikey quicksort; blind tries order the rest.
SHALLOW = 64
#: Window starts handled at once in a text; longer texts go in overlapping pieces.
PIECE = 1 << 18
#: Occurrences of one anchor above which its windows are counted in the cluster instead of in one task.
HOT = 50_000
#: Contexts in one partition of the sort.
CONTEXTS = 60_000

_rng = np.random.default_rng(20_240)
_BYTE = _rng.integers(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, 1 << 16)
        up = np.full(m, _BASE, np.uint64)
        down = np.full(m, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, position, first, last)``: the minimizer of every window of ``length`` bytes inside the pieces of ``buf``.

    A window is represented by the k-byte string in it whose hash is smallest, the leftmost if several are; equal windows have equal
    representatives at equal offsets. ``first`` to ``last`` are the starts of the consecutive windows that share one.
    """
    w, n = length - k + 1, len(buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:n], out=total[1:])
    h = (total[k:] - total[: n - k + 1]) * down[: n - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    grams = len(h)
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    blocks = -(-grams // w)
    pad = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:grams] = v
    pad = pad.reshape(blocks, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = grams - w + 1
    low = np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    fits = ends - starts >= length
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, ends[fits] - length + 1, -1)
    valid = np.cumsum(inside[:windows], dtype=np.int8).astype(bool)
    change = np.ones(windows, bool)
    change[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    final = np.ones(windows, bool)
    final[:-1] = change[1:] | ~valid[1:]
    last = np.flatnonzero(final & valid)
    pos = at[first]
    return h[pos], pos, first, last


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts gathered into buffers of about ``PIECE`` bytes: bytes, index of each piece's text, its offset there, start and end in the buffer."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        sizes = np.array([len(p[2]) for p in held], np.int64)
        ends = np.cumsum(sizes)
        return b"".join(p[2] for p in held), np.array([p[0] for p in held]), np.array([p[1] for p in held]), ends - sizes, ends

    for i, t in enumerate(texts):
        for off in range(0, max(1, len(t) - length + 1), PIECE):
            piece = t[off : off + PIECE + length - 1]
            if size + len(piece) > 2 * PIECE and held:
                yield out()
                held, size = [], 0
            held.append((i, off, piece))
            size += len(piece)
    if held:
        yield out()


ANCHOR = np.dtype([("h", "<i8"), ("pos", "<i8"), ("first", "<i8"), ("last", "<i8")])


def _digest(text: bytes) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    return tuple(np.frombuffer(xxh3_128_digest(text), "<i8").tolist())


def _anchored(length: int, k: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            texts = b.column(2).to_pylist()
            found: dict[int, list[np.ndarray]] = defaultdict(list)
            for buf, who, off, lo, hi in _pieces(texts, length):
                h, pos, first, last = anchors(np.frombuffer(buf, np.uint8), lo, hi, length, k)
                piece = np.searchsorted(hi, first, side="right")
                row = np.empty(len(h), ANCHOR)
                shift = off[piece] - lo[piece]
                row["h"], row["pos"], row["first"], row["last"] = h.view(np.int64), pos + shift, first + shift, last + shift
                cuts = np.searchsorted(piece, np.arange(len(who) + 1))
                for j, i in enumerate(who.tolist()):
                    if cuts[j + 1] > cuts[j]:
                        found[i].append(row[cuts[j] : cuts[j + 1]])
            packed = [_pack(np.concatenate(found[i])) if i in found else b"" for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(packed, pa.binary())], ["t1", "t2", "anchors"]
            )

    return each


def _pack(rows: np.ndarray) -> bytes:
    """Hashes, then first window starts, lengths of their runs and distances to the anchor as 16-bit steps."""
    run, ahead = rows["last"] - rows["first"], rows["pos"] - rows["first"]
    return np.uint32(len(rows)).tobytes() + rows["h"].tobytes() + rows["first"].astype("<u4").tobytes() + run.astype("<u2").tobytes() + ahead.astype("<u2").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    n = int(np.frombuffer(packed, "<u4", 1)[0])
    out = np.empty(n, ANCHOR)
    out["h"] = np.frombuffer(packed, "<i8", n, 4)
    out["first"] = np.frombuffer(packed, "<u4", n, 4 + 8 * n)
    out["last"] = out["first"] + np.frombuffer(packed, "<u2", n, 4 + 12 * n)
    out["pos"] = out["first"] + np.frombuffer(packed, "<u2", n, 4 + 14 * n)
    return out


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text and anchor hash, with the number of its places, at most two."""
    for b in batches:
        ids, m = b.column(0).to_numpy(), b.column(1).to_numpy()
        for lo in range(0, b.num_rows, 500):
            h, c, who = [], [], []
            for i, packed in enumerate(b.column(2).slice(lo, 500).to_pylist()):
                n = int(np.frombuffer(packed, "<u4", 1)[0])
                u, count = np.unique(np.frombuffer(packed, "<i8", n, 4), return_counts=True)
                h.append(u)
                c.append(np.minimum(count * m[lo + i], 2))
                who.append(np.full(len(u), lo + i))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)), pa.array(np.concatenate(c).astype(np.int8)), pa.array(ids[np.concatenate(who)])], ["h", "m", "id"])


PLACE = np.dtype([("id", "<i8"), ("first", "<u4"), ("m", "<i1")])


def _contexts(length: int):
    """The bytes around those anchors whose hash stands elsewhere too; equal ones of a partition meet in one row, with their places."""

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        items = list(held.items())
        for lo in range(0, len(items), 20_000):
            part = items[lo : lo + 20_000]
            places = []
            for _, where in part:
                x = np.empty(len(where), PLACE)
                x[:] = where
                places.append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in part], pa.int64()), pa.array([k[2] for k, _ in part], pa.binary()), pa.array([k[1] for k, _ in part], pa.int16()), pa.array(places, pa.binary()), pa.array([k[3] for k, _ in part], pa.bool_())],
                ["h", "ctx", "ahead", "places", "hot"],
            )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = defaultdict(list)
        n = 0
        for b in batches:
            for i in range(b.num_rows):
                id_, m, text, packed, marks, hot = (c[i].as_py() for c in b.columns)
                a = _unpack(packed)
                a = a[np.isin(a["h"], np.array(marks, np.int64))]
                is_hot = np.isin(a["h"], np.array(hot, np.int64)).tolist()
                for h, pos, f, e, w in zip(a["h"].tolist(), a["pos"].tolist(), a["first"].tolist(), a["last"].tolist(), is_hot, strict=True):
                    held[h, pos - f, text[f : e + length], w].append((id_, f, m))
                n += len(a)
                if n > 100_000:
                    yield from rows(held)
                    held.clear()
                    n = 0
        yield from rows(held)

    return each


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal leading bytes of big-endian 8-byte words."""
    x = a ^ b
    n = np.zeros(len(x), np.int64)
    for s in (32, 16, 8):
        high = x >> np.uint64(64 - s)
        zero = high == 0
        n += np.where(zero, s // 8, 0)
        x = np.where(zero, x << np.uint64(s), x)
    return n + (x == 0)


def deep_shallow_sort(group: np.ndarray, strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """``(order, lcp)``: strings sorted within their groups, and the common prefix of each with the one before it, -1 at a group's start.

    Multikey quicksort takes eight bytes as one character and partitions every segment of equal prefixes by its next character, all
    segments of a level together, down to ``shallow`` bytes. What still shares its prefix there goes through a blind trie. A string that is a prefix of another comes first.
    """
    n = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    words = np.frombuffer(b"".join([s[:shallow].ljust(shallow, b"\0") for s in strings]), ">u8").reshape(n, shallow // 8).astype(np.uint64)
    order = np.argsort(group, kind="stable")
    sorted_group = group[order]
    lcp = np.where(np.r_[True, sorted_group[1:] != sorted_group[:-1]] if n else np.zeros(0, bool), -1, shallow).astype(np.int64)
    same = lambda: np.cumsum(lcp < shallow)  # noqa: E731  the segment of each place
    active = np.arange(n)
    for d in range(shallow // 8):
        segment = same()
        count = np.bincount(segment, minlength=n + 2)
        active = active[count[segment[active]] > 1]
        if not len(active):
            break
        w = words[order[active], d]
        by = np.lexsort((w, segment[active]))
        order[active], w = order[active][by], w[by]
        inner = np.flatnonzero(lcp[active] == shallow)  # places with a predecessor in their segment, which is the active place before
        cut = inner[w[inner] != w[inner - 1]]
        lcp[active[cut]] = 8 * d + _common(w[cut], w[cut - 1])
    # segments that share their first bytes down to the shallow depth
    starts = np.flatnonzero(lcp < shallow)
    ends = np.r_[starts[1:], n]
    for s, e in zip(starts[(ends - starts) > 1].tolist(), ends[(ends - starts) > 1].tolist(), strict=True):
        part = order[s:e].tolist()
        at, common = _blind_trie([strings[i][shallow:] for i in part], size[part].tolist())
        order[s:e] = [part[i] for i in at]
        lcp[s + 1 : e] = np.array(common[1:], np.int64) + shallow
    inner = np.flatnonzero(lcp >= 0)
    lcp[inner] = np.minimum(lcp[inner], np.minimum(size[order[inner]], size[order[inner - 1]]))
    return order, lcp


def _blind_trie(strings: list[bytes], sizes: list[int]) -> tuple[list[int], list[int]]:
    """Sorted places and the common prefix with the one before. Branches hold bit numbers only; a string is compared once, with the leaf it is led to."""
    width = max(map(len, strings))
    bits = 8 * width
    leaves: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(strings):
        leaves[int.from_bytes(s.ljust(width, b"\0"), "big")].append(i)
    values = list(leaves)
    bit, zero, one = [], [], []  # of branches; children: branch number, or ~leaf number
    root = ~0
    for j in range(1, len(values)):
        v, at = values[j], root
        while at >= 0:
            at = one[at] if v >> (bits - 1 - bit[at]) & 1 else zero[at]
        differ = bits - (v ^ values[~at]).bit_length()
        above, at = -1, root
        while at >= 0 and bit[at] < differ:
            above, at = at, one[at] if v >> (bits - 1 - bit[at]) & 1 else zero[at]
        new, right = len(bit), v >> (bits - 1 - differ) & 1
        bit.append(differ)
        zero.append(at if right else ~j)
        one.append(~j if right else at)
        if above < 0:
            root = new
        elif v >> (bits - 1 - bit[above]) & 1:
            one[above] = new
        else:
            zero[above] = new
    order, lcp, stack, common = [], [], [(root, 0)], 0
    while stack:
        at, shared = stack.pop()
        if at >= 0:
            stack.append((one[at], bit[at] // 8))
            stack.append((zero[at], shared))
            continue
        equal = sorted(leaves[values[~at]], key=sizes.__getitem__)
        order += equal
        lcp += [shared] + [width] * (len(equal) - 1)
    return order, lcp


def repeated_ranges(h: np.ndarray, contexts: list[bytes], ahead: np.ndarray, weight: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context the smallest and largest window start in it, from its first byte, whose window occurs in another place; -1 if none does.

    ``h`` groups the contexts, whose anchor stands ``ahead`` bytes from the start; each occurs in ``weight`` places. The strings to the right of the anchors and
    those to the left, reversed, are each sorted. A window that reaches i bytes left of its anchor equals another exactly if both
    agree in i bytes to the left and length - i to the right; both orders give the classes of every depth by counting breaks.
    """
    n = len(contexts)
    right, right_lcp = deep_shallow_sort(h, [c[a:] for c, a in zip(contexts, ahead.tolist(), strict=True)])
    left, left_lcp = deep_shallow_sort(h, [c[:a][::-1] for c, a in zip(contexts, ahead.tolist(), strict=True)])
    most = ahead  # how far windows reach to the left: at most, and at least
    least = ahead - (np.array([len(c) for c in contexts], np.int64) - length)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    place_left, place_right = np.empty(n, np.int64), np.empty(n, np.int64)
    place_left[left], place_right[right] = np.arange(n), np.arange(n)
    for i in range(int(least.min()), int(most.max()) + 1) if n else ():
        on = np.flatnonzero((least <= i) & (i <= most))
        if not len(on):
            continue
        key = np.cumsum(left_lcp < i)[place_left[on]] * np.int64(n + 1) + np.cumsum(right_lcp < length - i)[place_right[on]]
        by = np.argsort(key, kind="stable")
        key = key[by]
        cls = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        twice = np.bincount(cls, weights=weight[on[by]])[cls] >= 2
        hit = on[by[twice]]
        high[hit] = np.maximum(high[hit], ahead[hit] - i)
        low[hit] = ahead[hit] - i  # i grows, so the start falls
    return low, high


def _sorted_ranges(length: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[tuple[int, int, bytes], int] = {}
        at, where = [], []
        for b in batches:
            if b.num_rows:
                key = zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)
                cls = np.array([classes.setdefault(k, len(classes)) for k in key], np.int64)
                packed = b.column(3).to_pylist()
                at.append(np.repeat(cls, [len(p) // PLACE.itemsize for p in packed]))
                where.append(np.frombuffer(b"".join(packed), PLACE))
        if not classes:
            return
        at, where = np.concatenate(at), np.concatenate(where)
        keys = list(classes)
        del classes
        h, ahead = np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64)
        low, high = repeated_ranges(h, [k[2] for k in keys], ahead, np.bincount(at, weights=where["m"].astype(np.int64), minlength=len(keys)), length)
        hit = np.flatnonzero(low[at] >= 0)
        w, c = where[hit], at[hit]
        for lo in range(0, len(hit), 100_000):
            s = slice(lo, lo + 100_000)
            x = w[s]
            first = x["first"].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x["id"].copy()), pa.array(first + low[c[s]]), pa.array(first + high[c[s]] + length)], ["id", "lo", "hi"])

    return each


def _windows(length: int):
    """The windows of hot anchors, each as a 128-bit digest."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ctx, places in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                w = np.frombuffer(places, PLACE)
                digests = np.array([_digest(ctx[s : s + length]) for s in range(len(ctx) - length + 1)], np.int64)
                n = len(digests)
                for lo in range(0, len(w), 1000):
                    x = w[lo : lo + 1000]
                    k = len(x)
                    columns = [np.tile(digests[:, 0], k), np.tile(digests[:, 1], k), np.repeat(x["id"], n), (x["first"].astype(np.int64)[:, None] + np.arange(n)).ravel(), np.repeat(x["m"], n).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["d1", "d2", "id", "lo", "m"])

    return each


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for b in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
        yield b.set_column(2, "packed", pa.array([press.compress(t) for t in b.column(2).to_pylist()], pa.binary()))


def _unpressed(f):
    """``f`` over batches whose column ``packed`` is a compressed text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()

        def plain():
            for b in batches:
                i = b.schema.get_field_index("packed")
                for lo in range(0, b.num_rows, 1000):
                    s = b.slice(lo, 1000)
                    yield s.set_column(i, "text", pa.array([unpress.decompress(x) for x in s.column(i).to_pylist()], pa.binary()))

        yield from f(plain())

    return each


def cut(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the ranges, and the number of maximal removed runs."""
    kept, at, spans = [], 0, 0
    last = -1
    for lo, hi in sorted(ranges):
        if lo > last:
            spans += 1
            kept.append(text[at:lo])
        last = max(last, hi)
        at = last
    kept.append(text[at:])
    return b"".join(kept), spans


def _cut(digest: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t1, t2, texts, ranges = (c.to_pylist() for c in b.columns)
            done = [cut(t, [(r["lo"], r["hi"]) for r in rs]) for t, rs in zip(texts, ranges, strict=True)]
            kept = pa.array([sha256(k).hexdigest() for k, _ in done], pa.string()) if digest else pa.array([k for k, _ in done], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), pa.array([len(t) - len(k) for t, (k, _) in zip(texts, done, strict=True)], pa.int64()), pa.array([s for _, s in done], pa.int64()), kept],
                ["t1", "t2", "n_removed", "n_spans", "kept"],
            )

    return each


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows with their text as bytes and two hashes that stand for it."""
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.withColumns({"__body": body, "__t1": F.xxhash64(F.lit(1), body), "__t2": F.xxhash64(F.lit(2), body)})


def _removals(spark: SparkSession, keyed: DataFrame, length: int, gram: int, hot: int, digest: bool) -> DataFrame:
    """``(t1, t2, n_removed, n_spans, kept)`` for those distinct texts that lose something; ``kept`` as bytes or as their digest."""
    scratch = Scratch(spark, "suffixes")
    d = keyed.select(F.col("__t1").alias("t1"), F.col("__t2").alias("t2"), F.col("__body").alias("text")).where(F.length("text") >= length)
    found = d.mapInArrow(released(_anchored(length, gram)), "t1 long, t2 long, anchors binary")
    texts = found.groupBy("t1", "t2").agg(F.least(F.count("*"), F.lit(2)).cast("tinyint").alias("m"), F.first("anchors").alias("anchors"))
    texts = scratch.write(texts.withColumn("id", F.monotonically_increasing_id()))  # written, and so fixed

    places = texts.select("id", "m", "anchors").mapInArrow(released(_hashes), "h long, m tinyint, id long")
    # one sum holds the number of places and, in the lower bits, that of texts
    seen = places.groupBy("h").agg(F.sum(F.shiftleft(F.col("m").cast("long"), 40) + 1).alias("n"))
    twice = seen.where(F.shiftright("n", 40) >= 2).select("h", (F.col("n").bitwiseAND(F.lit((1 << 40) - 1)) > hot).alias("hot"))
    marks = places.select("h", "id").join(twice, "h").groupBy("id").agg(F.collect_list("h").alias("marks"), F.collect_list(F.when(F.col("hot"), F.col("h"))).alias("hot"))

    pressed = d.mapInArrow(released(_texts), "t1 long, t2 long, packed binary").groupBy("t1", "t2").agg(F.first("packed").alias("packed"))
    marked = texts.join(marks, "id").select("t1", "t2", "id", "m", "anchors", "marks", "hot")
    holders = scratch.write(pressed.join(marked, ["t1", "t2"]))
    scratch.drop(texts)
    contexts = holders.select("id", "m", "packed", "anchors", "marks", "hot").mapInArrow(released(_unpressed(_contexts(length))), "h long, ctx binary, ahead smallint, places binary, hot boolean")
    total, hottest = holders.agg(F.sum(F.size("marks")), F.max(F.size("hot"))).first()
    sort_parts = partitions(spark, total or 0, CONTEXTS)
    ranges = contexts.where("not hot").repartition(sort_parts, "h").mapInArrow(released(_sorted_ranges(length)), "id long, lo long, hi long")
    if hottest:
        windows = scratch.write(contexts.where("hot").mapInArrow(released(_windows(length)), "d1 long, d2 long, id long, lo long, m long"))
        repeated = windows.groupBy("d1", "d2").agg(F.sum("m").alias("c")).where("c >= 2").select("d1", "d2")
        ranges = ranges.union(windows.join(repeated, ["d1", "d2"], "left_semi").select("id", "lo", (F.col("lo") + length).alias("hi")))
    ranges = ranges.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    done = holders.select("id", "t1", "t2", "packed").join(ranges, "id").select("t1", "t2", "packed", "ranges")
    out = scratch.write(done.mapInArrow(released(_unpressed(_cut(digest))), f"t1 long, t2 long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}"))
    scratch.drop_all_but(out)
    return out


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 200, text_col: str = "text", gram: int = 40, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` with ``n_bytes, n_removed, n_spans, kept``: every byte covered by a repeated string of ``length`` bytes is removed from ``kept``.

    The suffix array is sampled: each window of ``length`` bytes belongs to the ``gram``-byte string in it with the smallest hash, and equal windows belong to equal
    strings at equal offsets. Strings that stand in one place only can't belong to a repeated window and go first, by counts that are summed
    before the shuffle. Around the others the suffixes to the right and the prefixes to the left are ordered by deep-shallow sorting, and common prefixes of
    neighbours give the windows that occur twice, exactly. Anchors in over ``hot`` texts (a passage in a large part of the corpus) go through counts of
    their windows instead, so that no task holds an unbounded group.

    Equal texts are taken once and counted twice. A null text counts as empty. Texts shorter than ``length`` lose nothing. Repeated rows and ids keep their rows. An
    empty table gives no rows. Matches never cross texts; overlapping matches in one text count. Strings are judged on the input, not on what is left.
    """
    return _with_removals(spark, docs, length, text_col, gram, hot, F.col("__body"), "kept")


def repeat_digests(spark: SparkSession, docs: DataFrame, length: int = 200, text_col: str = "text", gram: int = 40, hot: int = HOT) -> DataFrame:
    """As ``remove_repeats``, with ``kept_sha256`` instead of the kept bytes, so that whole texts needn't meet their results."""
    return _with_removals(spark, docs, length, text_col, gram, hot, F.sha2("__body", 256), "kept_sha256")


def _with_removals(spark, docs, length, text_col, gram, hot, whole_value, name):
    if not 8 <= gram <= length or length > 0x7FFF:
        raise ValueError("the anchor needs 8 bytes or more and at most the length, which is below 32,768")
    keyed = _keyed(docs, text_col)
    gone = _removals(spark, keyed, length, gram, hot, name != "kept").select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), F.col("n_removed").alias("__removed"), F.col("n_spans").alias("__spans"), F.col("kept").alias("__cut"))
    keyed = keyed.withColumns({"__whole": whole_value, "n_bytes": F.length("__body").cast("long")}).drop("__body", *([text_col] if name == "kept" else []))
    joined = keyed.join(gone, ["__t1", "__t2"], "left")
    out = joined.withColumns({"n_removed": F.coalesce("__removed", F.lit(0)).cast("long"), "n_spans": F.coalesce("__spans", F.lit(0)).cast("long"), name: F.coalesce("__cut", "__whole")})
    return out.drop("__t1", "__t2", "__whole", "__removed", "__spans", "__cut")
