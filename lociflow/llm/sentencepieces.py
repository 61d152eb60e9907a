"""SentencePiece encoding and decoding on the tokenizers library, from the model's protobuf alone."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hand_back

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Piece types, model types and field numbers of the model's protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Largest model that is handed to every executor.
MOST_BYTES = 64 << 20


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix: bool = False


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return out

    while at < len(data):
        tag = number()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(wire) or number()
        yield tag >> 3, data[at : at + size]
        at += size


def parse(data: bytes) -> Model:
    """The parts of a serialised model that encoding needs."""
    m = Model()
    for f, v in _fields(data):
        if f == 1:
            piece, score, kind = "", 0.0, NORMAL
            for g, w in _fields(v):
                if g == 1:
                    piece = w.decode()
                elif g == 2:
                    score = struct.unpack("<f", w)[0]
                elif g == 3:
                    kind = w
            m.pieces.append((piece, score, kind))
        elif f == 2:
            for g, w in _fields(v):
                if g == 3:
                    m.kind = w
                elif g == 35:
                    m.byte_fallback = bool(w)
                elif g == 24:
                    m.suffix = bool(w)
        elif f == 3:
            for g, w in _fields(v):
                if g == 2:
                    m.charsmap = w
                elif g == 3:
                    m.dummy_prefix = bool(w)
                elif g == 4:
                    m.squeeze = bool(w)
                elif g == 5:
                    m.escape = bool(w)
    if m.kind not in (UNIGRAM, BPE) or m.suffix:
        raise ValueError("only unigram and BPE models whose marker stands before words are supported")
    return m


def words_apart(m: Model) -> bool:
    """Whether no piece reaches over the beginning of a word, so that words can be encoded one by one."""
    return m.escape and not any(MARK in p.lstrip(MARK) for p, _, k in m.pieces if k in (NORMAL, USER_DEFINED))


def build(data: bytes, cache: int = 10_000):
    """A tokenizer with the model's normaliser, metaspace marker, pieces with their scores, and byte fallback; it remembers the pieces of ``cache`` words."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = parse(data)
    unknown = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), None)
    if m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=unknown, byte_fallback=m.byte_fallback)
    else:
        usable = {p: s for p, s, k in m.pieces if k in (NORMAL, USER_DEFINED)}
        order = sorted((p for p in usable if len(p) > 1), key=lambda p: -usable[p])  # stable: equal scores in the order of ids
        merges = [(p[:i], p[i:]) for p in order for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges, unk_token=m.pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=cache)
    t = Tokenizer(model)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if words_apart(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    t.add_tokens([AddedToken(p, normalized=True) for p, _, k in m.pieces if k == USER_DEFINED])
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if m.dummy_prefix:
        undo.append(decoders.Strip(" ", 1, 0))
    t.decoder = decoders.Sequence(undo)
    return t


class Codec:
    """Encodes and decodes batches, and compares what it finds with the reference library."""

    def __init__(self, data: bytes, threads: int = 2, most_bytes: int = 24 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        from tokenizers import Tokenizer

        m = parse(data)
        # where words are independent, each distinct word goes through the pieces once, and they needn't remember it
        self.apart = words_apart(m) and m.byte_fallback and not any(k == USER_DEFINED for _, _, k in m.pieces)
        self.tokenizer, self.threads, self.most_bytes, self.held = build(data, 0) if self.apart else build(data), threads, most_bytes, 0
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.words: dict[str, bytes] = {}
        self.misspelled: set[str] = set()  # words whose ids don't spell them
        self.differ: set[str] = set()  # words to which the reference library gives other ids
        self.pieces = Tokenizer(self.tokenizer.model)
        mark = MARK.encode()
        self.bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.encode().replace(mark, b" ") for p, _, k in m.pieces]
        self.lengths = np.array([len(p) for p in self.bytes], np.int64)
        self.unknown = {i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN}
        self.dummy = m.dummy_prefix
        self.identity, self.start = not m.charsmap and not m.squeeze, MARK if m.dummy_prefix else ""

    def split(self, texts: list[str], check: bool) -> tuple[list[str], list[list[str]]]:
        """The normalised texts and the words of each, all of them known from here on by their packed ids.

        ``check`` compares the words that are new with the reference library. What is known takes ``most_bytes`` by estimate, however long the words are, and starts anew beyond.
        """
        if self.held > self.most_bytes:
            self.forget()
        known = self.words
        normal = (lambda t: self.start + t.replace(" ", MARK)) if self.identity else self.tokenizer.normalizer.normalize_str
        whole, split = [], []
        for t in texts:
            n = normal(t) if t else ""
            whole.append(n)
            if MARK * 2 in n or " " in n or not n.startswith(MARK):
                split.append(_WORDS.findall(n))
            else:
                split.append(n.replace(MARK, " " + MARK)[1:].split(" "))
        missing = list(set(chain.from_iterable(split)).difference(known))
        if not missing:
            return whole, split
        own = [e.ids for e in self.pieces.encode_batch_fast(missing, add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, own)])
        ids = np.fromiter(chain.from_iterable(own), np.int32, ends[-1])
        packed, at = ids.tobytes(), (4 * ends).tolist()
        known.update(zip(missing, [packed[lo:hi] for lo, hi in pairwise(at)], strict=True))
        plain = [w.encode() for w in "\0".join(missing).replace(MARK, " ").split("\0")]
        if len(plain) != len(missing):  # a word holds the separator
            plain = [w.replace(MARK, " ").encode() for w in missing]
        lengths = np.fromiter(map(len, plain), np.int64, len(plain))
        self.held += 240 * len(missing) + 2 * int(lengths.sum()) + len(packed)
        # all words are spelled by their ids if they are as long and the same when joined
        spelled = np.diff(np.concatenate(([0], np.cumsum(self.lengths[ids])))[ends])
        if not np.array_equal(spelled, lengths) or b"".join(map(self.bytes.__getitem__, ids.tolist())) != b"".join(plain):
            self.misspelled.update(w for w, x, t in zip(missing, own, plain, strict=True) if b"".join([self.bytes[i] for i in x]) != t)
        if check:
            theirs = self.original.encode([t[self.dummy and t[:1] == b" " :] for t in plain], num_threads=self.threads)
            if theirs != own:
                self.differ.update(w for w, a, b in zip(missing, own, theirs, strict=True) if a != b)
        return whole, split

    def forget(self) -> None:
        """Lets go of the words that are known, so that a worker that waits for its next task doesn't hold them."""
        for held in (self.words, self.misspelled, self.differ):
            held.clear()
        self.held = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.apart:
            return [e.ids if t else [] for t, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
        return [array("i", b"".join([self.words[w] for w in ws])).tolist() for ws in self.split(texts, False)[1]]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Pieces joined, bytes put together and markers turned into spaces; ids that stand for the unknown piece go through the library."""
        out = []
        for x in ids:
            if self.unknown and not self.unknown.isdisjoint(x):
                out.append(self.tokenizer.decode(x, skip_special_tokens=False))
                continue
            text = b"".join([self.bytes[i] for i in x])
            out.append((text[1:] if self.dummy and text[:1] == b" " else text).decode("utf-8", "replace"))
        return out

    def verified(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids, and whether both libraries agree; where they don't, the reference library's ids stand."""
        ids, same, _ = self.coded(texts, True)
        return ids.to_pylist(), same

    def coded(self, texts: list[str], check: bool) -> tuple[pa.Array, list[bool | None], list[bool]]:
        """Ids, parity and round trip of each text. Where words are independent a text agrees if all of its words do, and each distinct word is worked out once."""
        if not self.apart:
            own = self.encode(texts)
            same: list[bool | None] = [None] * len(texts)
            if check:
                theirs = self.original.encode(texts, num_threads=self.threads)
                same = [a == b for a, b in zip(own, theirs, strict=True)]
                own = theirs
            return pa.array(own, pa.list_(pa.int32())), same, [a == b for a, b in zip(self.decode(own), texts, strict=True)]
        whole, split = self.split(texts, check)
        packed = [b"".join(map(self.words.__getitem__, ws)) for ws in split]
        back = [n.replace(MARK, " ")[self.dummy and n[:1] == MARK :] == t for t, n in zip(texts, whole, strict=True)]
        same = [True if check else None] * len(texts)
        for i, ws in enumerate(split if self.differ or self.misspelled else ()):
            if not self.differ.isdisjoint(ws):
                ids = self.original.encode(texts[i])
                same[i] = array("i", ids).tobytes() == packed[i]
                packed[i] = array("i", ids).tobytes()
                back[i] = self.decode([ids])[0] == texts[i]
            elif not self.misspelled.isdisjoint(ws):
                back[i] = self.decode([array("i", packed[i]).tolist()])[0] == texts[i]
        offsets = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32))), same, back


#: The codec of this Python worker, by model and threads; tasks that follow one another share it and what it knows.
_CODECS: dict[tuple[str, int], Codec] = {}


def codec_of(data: bytes, threads: int) -> Codec:
    """The worker's codec for a model; another model takes its place, so that there is one at a time."""
    key = (hashlib.sha256(data).hexdigest(), threads)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(data, threads)
    return _CODECS[key]


def _slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose first column, of strings or lists, holds about ``most`` bytes or values, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(0)) if pa.types.is_string(batch.column(0).type) else pc.list_value_length(batch.column(0)), 0).to_pylist()
    lo = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(lo, i - lo)
            lo, size = i, 0
        size += n
    if lengths:
        yield batch.slice(lo)


def encode(spark: SparkSession, docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "ids", verify: bool = True, threads: int | None = None) -> DataFrame:
    """The rows of ``docs`` with ``ids array<int>``, ``parity boolean`` and ``round_trip boolean``.

    Whole texts are encoded in batches of about a megabyte, or of one longer text, on ``threads`` threads, by default as many as a task has cores. ``parity``: the reference library gives the same ids, to every word where words are independent (null if not verified); where it doesn't, its ids are
    taken. ``round_trip``: decoding gives the text back. Null and empty texts have no ids and agree. The model is read once on the driver, is at most ``MOST_BYTES`` and goes to the executors as a whole.
    Columns of ``docs`` with the names of the new ones are replaced. Repeated rows are kept; an empty table gives no rows.
    """
    with open(model_path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError("the model is too large to hand to every executor")
    shared = spark.sparkContext.broadcast(data)
    threads = threads or int(spark.conf.get("spark.task.cpus", "1"))
    others = [c for c in docs.columns if c not in (out_col, "parity", "round_trip")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value, threads)
        for b in batches:
            for part in _slices(b):
                ids, same, back = codec.coded([t or "" for t in part.column(0).to_pylist()], verify)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], ids, pa.array(same, pa.bool_()), pa.array(back, pa.bool_())], [*others, out_col, "parity", "round_trip"])
                del ids, same, back
        codec.forget()
        hand_back()

    source = docs.select(F.col(text_col).cast("string").alias("__text"), *[F.col(f"`{c}`") for c in others])
    schema = source.drop("__text").schema.add(out_col, T.ArrayType(T.IntegerType())).add("parity", "boolean").add("round_trip", "boolean")
    return source.mapInArrow(each, schema)


def decode(spark: SparkSession, rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text", threads: int = 2) -> DataFrame:
    """The rows with the text of their ids; null ids give null."""
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read(MOST_BYTES))
    others = [c for c in rows.columns if c != out_col]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value, threads)
        for b in batches:
            for part in _slices(b):
                ids = part.column(0).to_pylist()
                texts = codec.decode([x or [] for x in ids])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())], [*others, out_col])

    source = rows.select(F.col(ids_col).alias("__ids"), *[F.col(f"`{c}`") for c in others])
    return source.mapInArrow(each, source.drop("__ids").schema.add(out_col, "string"))
