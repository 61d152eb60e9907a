"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+")
#: Tokens and their first letters are counted in 2**20 buckets, so that the model, and what is broadcast, has one size for every corpus.
BUCKETS = 1 << 20
#: Lengths of the beginnings of words that are features beside the word: they catch inflected and compound forms.
BEGINNINGS = (4, 5, 6, 7, 8)


def features(token: str) -> list[int]:
    """Buckets of a token and of its beginnings."""
    own = token.encode("utf-8", "surrogatepass")
    starts = [zlib.crc32(b"^" + token[:k].encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for k in BEGINNINGS if k < len(token)]
    return [zlib.crc32(own) & (BUCKETS - 1), *starts]


@dataclass
class Scan:
    """What scoring needs: a score per bucket, the drift taken from every token, and the extreme-value parameters."""

    scores: np.ndarray
    drift: float
    rate: float = 1.0
    location: float = 0.0
    alpha: float = 0.01
    seen: dict = field(default_factory=dict)

    def token(self, t: str) -> float:
        """The strongest score of the token and its beginnings, less the drift."""
        return max((float(self.scores[i]) for i in features(t)), key=abs) - self.drift

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, prior: float = 10.0, least_z: float = 2.8) -> np.ndarray:
    """Log-odds of each bucket between the texts of both kinds that hold it, under a Dirichlet prior in proportion to the pooled shares; 0 where not significant.

    Texts are counted, not tokens: a token that one long text repeats tells little about its kind.
    """
    a = prior * (toxic + clean + 1e-3) / (n_toxic + n_clean)
    delta = np.log((toxic + a) / (n_toxic + prior - toxic - a).clip(1e-3)) - np.log((clean + a) / (n_clean + prior - clean - a).clip(1e-3))
    z = delta / np.sqrt(1 / (toxic + a) + 1 / (clean + a))
    return np.where(np.abs(z) >= least_z, delta, 0.0).astype(np.float32)


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, end, score)`` in linear time: no segment gains by growing or shrinking, and they are disjoint."""
    found: list[list] = []  # first, end, total before, total after, nearest earlier segment with a smaller total before
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        cur = [i, i + 1, before, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= cur[2]:
                j = found[j][4]
            cur[4] = j
            if j < 0 or found[j][3] >= cur[3]:
                found.append(cur)
                break
            cur = [found[j][0], cur[1], found[j][2], cur[3], -1]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


def _passages(scan: Scan, text: str, tally: Counter | None = None) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens and the maximal segments in tokens."""
    tokens = TOKEN.findall(text.lower())
    seen = scan.seen
    if len(seen) > 300_000:
        seen.clear()
    try:
        scores = [seen[t] for t in tokens]
    except KeyError:
        for t in tokens:
            if t not in seen:
                seen[t] = scan.token(t)
        scores = [seen[t] for t in tokens]
    if tally is not None:
        tally.update([round(s, 2) for s in scores])
    if not scores or max(scores) <= 0:
        return len(tokens), []
    # a token right after itself adds nothing: repetition is no evidence
    scores[1:] = [-scan.drift if a == b else s for a, b, s in zip(tokens, tokens[1:], scores[1:])]
    return len(tokens), segments(scores)


def _excess(scan: Scan, n: int, score: float) -> float:
    """Score in units of the extreme-value law of clean texts of n tokens; exp(-excess) is the expected number of such segments."""
    return scan.rate * score - math.log(max(n, 1)) - scan.location


def karlin_rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share x exp(rate x score)) = 1 for scores of negative mean."""
    top = scores.max()
    if top <= 0 or not (scores * share).sum() < 0:
        return 1.0
    lo, hi = 0.0, 1.0
    f = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    while f(hi) < 0:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 20_000, drift: float = 0.25, alpha: float = 0.01) -> Scan:
    """Learn from the texts whose ids have a label, at most ``most_rows`` of them: those with the smallest hash of their id.

    ``labels(doc_id, toxic)`` are the rows to learn from; null ids and labels are ignored, and an id labelled twice counts as toxic if any label says so. Without both
    kinds of rows every score is 0. The sample is the documented bound of a classifier; only it and 2**18 counts reach the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).toPandas()
    if sample.empty:
        return Scan(np.zeros(BUCKETS, np.float32), drift, alpha=alpha)
    picked = F.broadcast(spark.createDataFrame(sample, f"__id {labels.schema['doc_id'].dataType.simpleString()}, __toxic int"))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(picked, "__id").where("__text is not null").select("__text", "__toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((2, BUCKETS + 1), np.int64)
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = {i for t in set(TOKEN.findall(text.lower())) for i in features(t)}
                got[int(toxic == 1), [*at, BUCKETS]] += 1  # the last place counts the texts
        on = np.flatnonzero(got.any(axis=0))
        for lo in range(0, len(on), 50_000):
            s = on[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(got[1, s]), pa.array(got[0, s])], ["bucket", "toxic", "clean"])

    counts = rows.mapInArrow(count, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 1").toPandas()
    toxic, clean = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    toxic[counts.bucket], clean[counts.bucket] = counts.toxic, counts.clean
    (toxic, n_toxic), (clean, n_clean) = (toxic[:-1], toxic[-1]), (clean[:-1], clean[-1])
    scores = log_odds(toxic, clean, n_toxic, n_clean) if n_toxic and n_clean else np.zeros(BUCKETS, np.float32)
    scan = Scan(scores, drift, alpha=alpha)
    shared = spark.sparkContext.broadcast(scan)

    def clean_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The largest segment and the number of tokens of each text that has one, and, with no number, how often each token score occurs."""
        model, seen = shared.value, Counter()
        for b in batches:
            x = []
            for text in b.column(0).to_pylist():
                n, found = _passages(model, text, seen)
                if found:
                    x.append((max(f[2] for f in found), n))
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in x], pa.float64()), pa.array([n for _, n in x], pa.int64()), pa.nulls(len(x), pa.int64())], ["score", "n", "times"])
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.float64()), pa.nulls(len(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["score", "n", "times"])

    got = rows.where("__toxic = 0").select("__text").mapInArrow(clean_side, "score double, n long, times long")
    got = got.where("times is null").unionByName(got.where("times is not null").groupBy("score", "n").agg(F.sum("times").alias("times"))).toPandas()
    tokens, largest = got[got.times.notna()], got[got.times.isna()]
    if len(tokens):
        # one more token of the highest score: what clean texts never showed may still turn up
        values, times = np.r_[tokens.score.to_numpy(float), scores.max() - drift], np.r_[tokens.times.to_numpy(float), 1.0]
        scan.rate = karlin_rate(values, times / times.sum())
    if len(largest):
        # the Gumbel law of the largest segment, from its median: a few of the texts are mislabelled or quote others
        scan.location = max(-10.0, float(np.median(scan.rate * largest.score - np.log(largest.n.astype(float)))) + math.log(math.log(2)))
    return scan


def score(spark: SparkSession, docs: DataFrame, scan: Scan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted, passages)`` of every row; whole texts are scanned once, in linear time.

    ``passages`` are the significant segments, those of which clean texts of this length would show fewer than ``alpha``: first and end position in the lower-cased text, score and
    expected number. A document's score is alpha / (alpha + expected number), where the excess of all significant passages adds up; without any positive segment it is small and depends on the length only.
    Null and empty texts score 0 and have no passages. Repeated rows and ids are kept; an empty table gives no rows.
    """
    shared = spark.sparkContext.broadcast(scan)
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        level = -math.log(model.alpha)
        passage = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
        for b in batches:
            scores, all_found = [], []
            for text in b.column(1).to_pylist():
                n, found = _passages(model, text or "")
                by_excess = [(_excess(model, n, f[2]), f) for f in found]
                strong = [(x, f) for x, f in by_excess if x >= level]
                best = sum(x for x, _ in strong) if strong else max((x for x, _ in by_excess), default=None)
                scores.append(0.0 if best is None else 1 / (1 + math.exp(min(700, level - min(best, 700) if strong else level - best))) if best > -600 else 0.0)
                where = []
                if strong:
                    spans = [m.span() for m in TOKEN.finditer(text.lower())]
                    where = [{"first": spans[f[0]][0], "end": spans[f[1] - 1][1], "score": f[2], "expected": math.exp(-min(x, 700))} for x, f in strong]
                all_found.append(where)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(all_found, pa.list_(passage))], ["doc_id", "score", "predicted", "passages"])

    schema = f"doc_id {kind}, score double, predicted int, passages array<struct<first: long, end: long, score: double, expected: double>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)
