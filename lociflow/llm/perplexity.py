"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, hand_back, null_key, partitions, released

#: Characters of an n-gram. The alphabet is all of Unicode: no character is put into a class, and n-grams are as many as the texts have.
ORDER = 5
#: Characters of the texts that share their look-ups, that are sorted at once, and that are compressed together.
BLOCK, CHUNK, TOGETHER = 8_000_000, 400_000, 1_000_000
#: Log-probabilities of n-grams go to the documents as whole numbers of this part of a nat.
FINE = 2**34
#: Trusted ids up to which they are broadcast; more are joined by shuffling.
MOST_IDS = 1_000_000
#: Judged documents from which a language has a quantile of its own.
LEAST_JUDGED = 500


def _points(text: str) -> np.ndarray:
    """Code points of a text, with line feeds before it."""
    return np.concatenate((np.full(ORDER - 1, 10, np.uint32), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)))


def _keys(points: np.ndarray) -> np.ndarray:
    """64-bit digests of the n-grams that begin at each place."""
    n = len(points) - ORDER + 1
    return _digests([points[j : j + n] for j in range(ORDER)])


def _digests(places: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """64-bit digests of n-grams whose first, second, ... characters are given."""
    h = np.zeros(len(places[0]), np.uint64)
    for points in places:
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (points.astype(np.uint64) + np.uint64(0x632BE59B))
        h ^= h >> np.uint64(29)
    return h


def _squeeze(values: np.ndarray, press) -> bytes:
    """Numbers compressed with their bytes apart: all first bytes, then all second ones and so on."""
    return press.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _unsqueeze(packed: bytes, kind: type, unpress) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(unpress.decompress(packed), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _squeeze_grams(window: np.ndarray, press) -> bytes:
    return _squeeze(np.ascontiguousarray(window.T).ravel(), press)


def _unsqueeze_grams(packed: bytes, unpress) -> np.ndarray:
    """The characters of packed n-grams, one row for each place."""
    return _unsqueeze(packed, np.uint32, unpress).reshape(ORDER, -1)


def _strings(window: np.ndarray) -> pa.Array:
    text = np.ascontiguousarray(window).tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string())


def _distinct(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, a place of each, and how often it stands there, or the sum of its ``n``."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(starts, append=len(keys)) if n is None else np.add.reduceat(n[order], starts) if len(keys) else n
    return keys[starts], order[starts], counts


class _Counter:
    """The distinct n-grams of many texts with their counts, sorted a chunk at a time; chunks meet when they have become as many as what is known."""

    def __init__(self):
        self.held, self.size = [], 0
        self.key, self.n, self.window = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, ORDER), np.uint32)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, text: str) -> None:
        self.held.append(_points(text))
        self.size += len(text)
        if self.size > CHUNK:
            self.sort()
            if sum(len(p[0]) for p in self.parts) > len(self.key):
                self.merge()

    def sort(self) -> None:
        if not self.held:
            return
        # windows that reach from one text into the next are no n-grams
        points, lengths = np.concatenate(self.held), np.array([len(p) for p in self.held])
        inside = np.ones(len(points), bool)
        for back in range(1, ORDER):
            inside[np.cumsum(lengths) - back] = False
        at = np.flatnonzero(inside[: len(points) - ORDER + 1])
        key, first, n = _distinct(_keys(points)[at])
        self.parts.append((key, n, points[at[first][:, None] + np.arange(ORDER)]))
        self.held, self.size = [], 0

    def merge(self) -> None:
        self.sort()
        if not self.parts:
            return
        key, n, window = (np.concatenate(x) for x in zip((self.key, self.n, self.window), *self.parts, strict=True))
        self.parts = []
        self.key, first, self.n = _distinct(key, n)
        self.window = window[first]

    def grams(self, lo: int, hi: int) -> pa.Array:
        return _strings(self.window[lo:hi])


def _pack(names: list[str]):
    """Texts compressed one by one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for s in (b.slice(lo, 1000) for lo in range(0, b.num_rows, 1000)):
                texts = [t or "" for t in s.column(0).to_pylist()]
                packed = pa.array([press.compress(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*s.columns[1:], packed, pa.array([len(t) for t in texts], pa.int64())], names)

    return each


#: Documents of one block and role, compressed together with all of their columns, and the number of their characters.
PACK = "block long, role int, n long, chunk binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of documents of about ``TOGETHER`` characters, or one longer text, in blocks of about ``BLOCK`` characters of one task."""
    import zstandard

    press, unpress = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    part, block, size = TaskContext.get().partitionId(), 0, 0
    held: dict[int, list[pa.RecordBatch]] = {}
    sizes: dict[int, int] = {}

    def out(role: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held.pop(role)).combine_chunks()
        texts = pa.array([unpress.decompress(x).decode("utf-8", "surrogatepass") for x in rows.column("packed").to_pylist()], pa.string())
        rows = rows.drop_columns(["packed"]).append_column("text", texts)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as to:
            to.write_table(rows)
        values = (part << 24 | block, role, sizes.pop(role), press.compress(sink.getvalue()))
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["block", "role", "n", "chunk"])

    for b in batches:
        for i, (n, role) in enumerate(zip(b.column("n_symbols").to_pylist(), b.column("role").to_pylist(), strict=True)):
            if size and size + n > BLOCK:
                yield from [out(r) for r in sorted(held)]
                block, size = block + 1, 0
            if role in held and sizes[role] + n > TOGETHER:
                yield out(role)
            held.setdefault(role, []).append(b.slice(i, 1))
            sizes[role] = sizes.get(role, 0) + n
            size += n
    yield from [out(r) for r in sorted(held)]


def _unpacked(b: pa.RecordBatch | pa.Table, unpress) -> Iterator[pa.Table]:
    """The documents of each pack."""
    for chunk in b.column("chunk"):
        yield pa.ipc.open_stream(unpress.decompress(chunk.as_py())).read_all()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpress, seen = zstandard.ZstdDecompressor(), _Counter()
    for b in batches:
        for pack in _unpacked(b, unpress):
            for text in pack.column("text").to_pylist():
                seen.add(text)
    seen.merge()
    for lo in range(0, len(seen.key), 100_000):
        yield pa.RecordBatch.from_arrays([seen.grams(lo, lo + 100_000), pa.array(seen.n[lo : lo + 100_000])], ["gram", "c"])


#: What goes to the shards: the n-grams that a block asks for, or (block -1) digests of n-grams and their log-probabilities.
SHARD_ROW = "shard int, block long, grams binary, logs binary"


def _cuts(shard: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal numbers in a sorted array."""
    at = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    return zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


def _shard_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["shard", "block", "grams", "logs"])


def _by_shard(shard: np.ndarray, window: np.ndarray, shards: int) -> np.ndarray:
    """The order of distinct n-grams by shard and then by their characters."""
    used = np.unique(window)
    bits = max(1, int(len(used) - 1).bit_length())
    if len(used) and ORDER * bits + shards.bit_length() <= 64:  # one number has room for the shard and the ranks of the characters
        rank = np.zeros(int(used[-1]) + 1, np.uint64)
        rank[used] = np.arange(len(used))
        whole = shard.astype(np.uint64)
        for j in range(ORDER):
            whole = whole << np.uint64(bits) | rank[window[:, j]]
        return np.argsort(whole)
    w = window.astype(np.uint64)
    return np.lexsort((w[:, 3] << np.uint64(21) | w[:, 4], w[:, 0] << np.uint64(42) | w[:, 1] << np.uint64(21) | w[:, 2], shard))


def _nats(texts: list[str], key: np.ndarray, log: np.ndarray) -> list[float]:
    """Of every text the sum of the whole numbers that its n-grams have; n-grams of many texts are looked up in ascending order."""
    out: list[float] = []
    held: list[np.ndarray] = []

    def summed() -> None:
        if held:
            keys = np.concatenate(held)
            order = np.argsort(keys)
            found = np.empty(len(keys), np.int64)
            found[order] = log[np.searchsorted(key, keys[order])]
            ends = np.cumsum([len(k) for k in held])
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out.append(float(found[lo:hi].sum(dtype=np.longdouble if hi - lo > CHUNK else np.int64)) / FINE if hi > lo else 0.0)  # no sum overflows
            held.clear()

    size = 0
    for t in texts:
        held.append(_keys(_points(t)) if t else np.zeros(0, np.uint64))
        size += len(t or "")
        if size > CHUNK:
            summed()
            size = 0
    summed()
    return out


def _asked(shards: int):
    """The distinct n-grams of each block, of the part of it that a task reads, in one row for each shard."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, unpress, seen, block = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor(), _Counter(), None

        def out() -> Iterator[pa.RecordBatch]:
            seen.merge()
            shard = (seen.key % np.uint64(shards)).astype(np.int64)
            order = _by_shard(shard, seen.window, shards)
            shard, window = shard[order], seen.window[order]
            yield _shard_rows([(int(shard[lo]), block, _squeeze_grams(window[lo:hi], press), None) for lo, hi in _cuts(shard)])

        for b in batches:
            for own, pack in zip(b.column("block").to_pylist(), _unpacked(b, unpress), strict=True):
                if own != block:
                    if block is not None:
                        yield from out()
                    seen, block = _Counter(), own
                for text in pack.column("text").to_pylist():
                    seen.add(text)
        if block is not None:
            yield from out()

    return each


def _known(shards: int):
    """``(gram, p)`` as digests and log-probabilities, in rows of one shard."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)

        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            points = np.frombuffer("".join(table.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
            key, log = _digests(points.reshape(-1, ORDER).T), np.log(table.column("p").to_numpy())
            order = np.lexsort((key, key % np.uint64(shards)))
            key, log, shard = key[order], log[order], (key[order] % np.uint64(shards)).astype(np.int64)
            yield _shard_rows([(int(shard[lo]), -1, _squeeze(key[lo:hi], press), _squeeze(log[lo:hi], press)) for lo, hi in _cuts(shard)])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= 500_000:
                yield from out(held)
                held = []
        if sum(x.num_rows for x in held):
            yield from out(held)

    return each


def _answered(only_never: bool):
    """Answers of the shards of a task, whose rows come shard by shard, the known n-grams first: log-probabilities beside
    the n-grams that each block asked for, or only the distinct n-grams that aren't known. A shard's known n-grams and one question are held at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, unpress = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        own, held, key, log, never = None, [], np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64)
        for b in batches:
            for shard, block, grams, logs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != own:
                    own, held, key, log, never = shard, [], np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64)
                if block < 0:
                    held.append((_unsqueeze(grams, np.uint64, unpress), _unsqueeze(logs, np.float64, unpress)))
                    continue
                if held:
                    key, log, held = np.concatenate([k for k, _ in held]), np.concatenate([x for _, x in held]), []
                    order = np.argsort(key)
                    key, log = key[order], log[order]
                places = _unsqueeze_grams(grams, unpress)
                asked = _digests(places)
                if only_never:
                    new = np.flatnonzero(~(_within(asked, key) | _within(asked, never)))
                    if len(new):
                        never = np.sort(np.concatenate((never, asked[new])))
                        yield pa.RecordBatch.from_arrays([_strings(places[:, new].T)], ["gram"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([grams], pa.binary()), pa.array([_squeeze(np.rint(-log[np.searchsorted(key, asked)] * FINE).astype(np.int64), press)], pa.binary())], ["block", "grams", "logs"])

    return each


def _within(some: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which numbers stand in a sorted array."""
    if not len(known):
        return np.zeros(len(some), bool)
    return known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some


def _discount(c: Column, d: list[float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def discounts(n: dict[int, int]) -> list[float]:
    """The three discounts of modified Kneser-Ney smoothing from the numbers of n-grams counted once to four times."""
    if not n.get(1) or not n.get(2):
        return [0.5, 1.0, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    d = [k - (k + 1) * y * n.get(k + 1, 0) / n[k] if n.get(k) else k / 2 for k in (1, 2, 3)]
    return [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True)]


class Model:
    """Probabilities of seen n-grams and back-off weights of contexts, a table of each for every order, sharded by n-gram and context."""

    def __init__(self, seen: list[DataFrame], weights: list[DataFrame], none: float):
        self.seen, self.weights, self.none = seen, weights, none

    def unseen(self, grams: DataFrame, scratch: Scratch) -> DataFrame:
        """``(gram, p)`` of distinct n-grams that were never seen: the probability of the shorter n-gram times the weight of the context.

        Each order is a written table, so that no query has more than two joins; in one query, every order would stand
        twice in the plan of the next, and the driver would hold it all.
        """
        found = [grams.withColumn("p", F.lit(None).cast("double"))]
        for seen in reversed(self.seen[:-1]):  # the shorter n-grams that are needed, with their p if they were seen
            shorter = found[-1].where("p is null").select(F.expr("substring(gram, 2)").alias("gram")).distinct()
            found.append(scratch.write(shorter.join(seen, "gram", "left")))
        made = found[1:]
        below = found.pop().select("gram", F.coalesce("p", F.lit(self.none)).alias("p"))
        for k, table in enumerate(reversed(found), 2):
            rest = table.where("p is null").select("gram", F.expr(f"substring(gram, 1, {k - 1})").alias("context"), F.expr("substring(gram, 2)").alias("short"))
            rest = rest.join(below.select(F.col("gram").alias("short"), F.col("p").alias("below")), "short").join(self.weights[k - 1], "context", "left")
            p = rest.select("gram", (F.coalesce("weight", F.lit(1.0)) * F.col("below")).alias("p"))
            below = scratch.write(p if table is found[0] else table.where("p is not null").union(p))
            made.append(below)
        scratch.drop(*made[:-1])
        return below


def train(texts: DataFrame, scratch: Scratch) -> Model | None:
    """The model of all texts of ``texts(chunk)``, nothing if they hold no character.

    N-grams are counted per partition before the shuffle and then sharded; contexts, continuation counts of lower orders and the probabilities of each order meet by joins on the context and on the
    shortened n-gram. All of these tables grow with the texts and stay distributed; only the counts of counts come to the driver.
    """
    counts = scratch.write(texts.mapInArrow(released(_counted), "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c")))
    orders = [counts]
    for _ in range(ORDER - 1):  # in how many contexts the shorter n-gram continues
        orders.append(scratch.write(orders[-1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))))
    seen: list[DataFrame] = []
    weights: list[DataFrame] = []
    none = 0.0
    for k, table in enumerate(reversed(orders), 1):
        d = discounts({r["c"]: r["count"] for r in table.where("c <= 4").groupBy("c").count().collect()})
        keyed = table.withColumn("context", F.expr(f"substring(gram, 1, {k - 1})"))
        contexts = scratch.write(keyed.groupBy("context").agg(F.sum("c").alias("all"), F.sum(_discount(F.col("c"), d)).alias("freed"), F.count("*").alias("kinds")).withColumn("weight", F.col("freed") / F.col("all")))
        if k == 1:
            only = contexts.first()
            if only is None:
                return None
            none = only["weight"] / (only["kinds"] + 1)  # one more character stands for all that were never seen
            p = table.select("gram", ((F.col("c") - _discount(F.col("c"), d)) / float(only["all"]) + none).alias("p"))
        else:
            direct = keyed.join(contexts, "context").withColumn("direct", (F.col("c") - _discount(F.col("c"), d)) / F.col("all")).withColumn("short", F.expr("substring(gram, 2)"))
            p = direct.join(seen[-1].select(F.col("gram").alias("short"), F.col("p").alias("below")), "short").select("gram", (F.col("direct") + F.col("weight") * F.col("below")).alias("p"))
        seen.append(scratch.write(p))
        weights.append(contexts.select("context", "weight"))
    scratch.drop(*orders)
    return Model(seen, weights, none)


def entropies(docs: DataFrame, size: int, model: Model, scratch: Scratch, fields: T.StructType, with_text: str | None = None) -> DataFrame:
    """The documents of ``docs(block, n, chunk)``, of ``size`` bytes of text, with their columns ``fields``, ``nats``, the negative log-probability of the whole text, and, if a name is given, the text.

    Each block asks once for each of its distinct n-grams: the questions go to the shards of the model in one compressed row for each block and shard, the n-grams that
    no shard knows get their probability by joins with the lower orders, and the answers go back to the block, where documents add theirs up. The number of shards grows with the model and with the texts.
    """
    spark = docs.sparkSession
    each_way = max(partitions(spark, model.seen[-1].count(), 1_000_000), partitions(spark, size, 20 * BLOCK))
    shards = 4 * each_way
    dealt = lambda rows: rows.repartition(each_way, "shard").sortWithinPartitions("shard", "block")
    asked = scratch.write(docs.where("n > 0").select("block", "chunk").mapInArrow(released(_asked(shards)), SHARD_ROW))
    known = lambda grams: grams.select("gram", "p").mapInArrow(released(_known(shards)), SHARD_ROW)
    never = scratch.write(dealt(known(model.seen[-1]).union(asked)).mapInArrow(released(_answered(True)), "gram string"))
    never = model.unseen(never, scratch)
    answers = dealt(known(model.seen[-1]).union(known(never)).union(asked)).mapInArrow(released(_answered(False)), "block long, grams binary, logs binary")
    schema = T.StructType([*fields]).add("nats", "double")
    if with_text:
        schema = schema.add(with_text, "string")

    def each(rows: pa.Table, found: pa.Table) -> pa.Table:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        held = [(_digests(_unsqueeze_grams(g, unpress)), _unsqueeze(x, np.int64, unpress)) for g, x in zip(found.column("grams").to_pylist(), found.column("logs").to_pylist(), strict=True)]
        key, log = (np.concatenate([h[i] for h in held] or [np.zeros(0, kind)]) for i, kind in enumerate((np.uint64, np.int64)))
        order = np.argsort(key)
        key, log = key[order], log[order]
        del held
        done = []
        for pack in _unpacked(rows, unpress):
            texts = pack.column("text").to_pylist()
            nats = _nats(texts, key, log)
            columns = [*(pack.column(f.name) for f in fields), pa.array(nats, pa.float64()), *([pack.column("text")] if with_text else [])]
            done.append(pa.Table.from_arrays(columns, names=[f.name for f in schema]))
        del key, log
        hand_back()
        return pa.concat_tables(done) if done else pa.table({f.name: [] for f in schema})

    return docs.select("block", "chunk").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(each, schema)


def classify(
    spark: SparkSession, docs: DataFrame, trusted: DataFrame, quantile: float = 0.999, inertia: float = 60.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()
) -> DataFrame:
    """``(doc_id, lang, n_symbols, perplexity, score, threshold, keep)`` of every row of ``docs``, and the columns of ``carry`` as they are, the text among them if named there.

    The model counts n-grams of five characters over all trusted texts, and every whole text gets its perplexity per character. ``score`` is the
    entropy with ``inertia`` further characters of the language's median, so that a few characters decide nothing. A quarter of the trusted documents, by a hash of
    their ids, teach the model nothing and give the thresholds: a document is kept up to the ``quantile`` of their scores in its language. A language with fewer than ``LEAST_JUDGED`` of them has
    its own median, and the quantile of the distances from it over all languages; one without any takes median and quantile over all. Without trusted text everything but empty texts stays.

    Null and empty texts have no perplexity and are not kept. A null language is a language of its own. Repeated rows and ids, null ids too, are kept as they are; an empty table
    gives no rows. A null text that is carried comes back as an empty one. ``trusted`` has a column doc_id; null ids there mean nothing. A block of texts that share their look-ups has about ``BLOCK`` characters, or one longer text.
    """
    scratch = Scratch(spark, "perplexity")
    others = [c for c in carry if c != text_col]
    named = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), null_key(lang_col).alias("k"), *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(others)])
    schema = named.drop("__text").schema.add("packed", "binary").add("n_symbols", "long")
    packed = named.mapInArrow(released(_pack(schema.names)), schema)
    role = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0, 2).otherwise(1)
    ids = trusted.where("doc_id is not null").select("doc_id").distinct().select(F.col("doc_id").alias("__id"), F.lit(0).alias("__salt"), role.alias("role"))
    if ids.limit(MOST_IDS + 1).count() <= MOST_IDS:
        rows = packed.join(F.broadcast(ids.drop("__salt")), "__id", "left")
    else:
        # a null id meets nothing, and is dealt by the text so that many of them don't share a task
        packed = packed.withColumn("__salt", F.when(F.col("__id").isNull(), F.pmod(F.xxhash64("packed"), F.lit(4096)).cast("int")).otherwise(0))
        rows = packed.join(ids.hint("merge"), ["__id", "__salt"], "left")
    rows = rows.withColumn("role", F.coalesce("role", F.lit(0))).select(*schema.names, "role")
    fields = T.StructType([f for f in rows.schema if f.name != "packed"])
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("n")).first()["n"]
    rows = scratch.write(rows.mapInArrow(released(_blocks), PACK), "block", partitions(spark, size, 2 * BLOCK))

    model = train(rows.where("role = 1 and n > 0").select("chunk"), scratch)
    text_out = "__text" if text_col in carry else None
    if model is None:
        model = Model([spark.createDataFrame([], "gram string, p double")] * ORDER, [spark.createDataFrame([], "context string, weight double")] * ORDER, 1.0)
    scored = entropies(rows, size, model, scratch, fields, text_out)
    scored = scratch.write(scored)
    scratch.drop_all_but(scored)

    known = scored.where("role = 2 and n_symbols > 0").select("k", "nats", "n_symbols")
    rate = F.col("nats") / F.nullif(F.col("n_symbols"), F.lit(0))
    middle = known.groupBy("k").agg(F.percentile_approx(rate, 0.5, 10_000).alias("middle"))
    far = F.col("inertia_score") - F.col("middle")
    smooth = (F.col("nats") + inertia * F.col("middle")) / (F.col("n_symbols") + inertia)
    known = scratch.write(known.join(middle, "k").withColumn("inertia_score", smooth))
    at = lambda c: F.percentile_approx(c, quantile, 10_000)
    overall = known.agg(F.percentile_approx(rate, 0.5, 10_000).alias("middle"), at(F.col("inertia_score")).alias("high"), at(far).alias("far")).first()
    limits = known.groupBy("k").agg(F.first("middle").alias("middle"), at(F.col("inertia_score")).alias("high"), F.count("*").alias("judged"))
    limits = scratch.write(limits.select("k", "middle", F.when(F.col("judged") >= LEAST_JUDGED, F.col("high")).otherwise(F.col("middle") + F.lit(overall["far"]).cast("double")).alias("limit")))
    out = scored.join(F.broadcast(limits) if limits.limit(10_001).count() <= 10_000 else limits, "k", "left")  # one row per language
    out = out.withColumns({"middle": F.coalesce("middle", F.lit(overall["middle"]).cast("double")), "threshold": F.coalesce("limit", F.lit(overall["high"]).cast("double"))})
    out = out.withColumn("score", F.when(F.col("n_symbols") > 0, F.coalesce(smooth, rate)))
    keep = (F.col("n_symbols") > 0) & (F.col("threshold").isNull() | (F.col("score") <= F.col("threshold")))
    carried = [F.col("__text" if c == text_col else f"__c{others.index(c)}").alias(c) for c in carry if c not in ("doc_id", "lang")]
    return out.select(F.col("__id").alias("doc_id"), F.col("__lang").alias("lang"), *carried, "n_symbols", F.exp(rate).alias("perplexity"), "score", "threshold", F.coalesce(keep, F.lit(False)).alias("keep"))
