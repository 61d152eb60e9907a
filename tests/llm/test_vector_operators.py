"""Vector operators and the pipeline against brute force and on odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm import ann, vectors


def make(spark, n=600, seed=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 32))
    for i in range(0, n, 6):  # copies and near copies
        x[i + 1] = x[i]
        x[i + 2] = x[i] + 0.03 * r.standard_normal(32)
    body = [(i, [float(v) for v in row], i // 6 % 4, 1) for i, row in enumerate(x)]
    odd = [(9000, None, 1, 1), (9001, [], 1, 1), (9002, [0.0] * 32, 1, 1), (9003, [float("nan")] * 32, 1, 1), (9004, [None] * 32, 1, 1), (9005, body[0][1], None, 1), (None, body[0][1], 0, 1), (9006, [1.0, 2.0], 1, 1), (9007, [float("inf")] * 32, 1, 1)]
    return x, spark.createDataFrame(body + odd, "vec_id long, embedding array<double>, label int, rank int"), len(odd)


def test_links_and_components(spark):
    x, df, odd = make(spark)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark, df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(len(x)) // 6 % 4
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    assert len(got) == len(x) + odd
    assert [got[i]["n_links"] for i in range(len(x))] == link.sum(axis=1).tolist()
    assert all(got[i]["component_id"] == i - i % 6 for i in range(len(x)) if i % 6 < 3)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(9000, 9008))
    assert vectors.near_duplicates(spark, df.limit(0)).count() == 0


def shared_direction(n, r):
    """Vectors whose mean pairwise cosine is about the threshold."""
    return np.concatenate((np.full((n, 1), 3.7), r.standard_normal((n, 31)) / 31**0.5), axis=1)


def near_threshold(n, r):
    """Pairs whose cosines lie close about 0.93."""
    x = r.standard_normal((n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = r.standard_normal((n, 32))
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    c = r.uniform(0.925, 0.95, (n, 1))
    return np.concatenate((x, c * x + (1 - c**2) ** 0.5 * turn))


def topics(n, r):
    centre = r.standard_normal((20, 32))
    return centre[r.integers(0, 20, n)] + 0.35 * r.standard_normal((n, 32))


@pytest.mark.parametrize("kind", [shared_direction, near_threshold, topics])
@pytest.mark.parametrize("label", ["one", 1 << 40])
def test_recall_of_links(spark, kind, label):
    r = np.random.default_rng(4)
    x = kind(500, r)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93).sum() - len(x)
    df = spark.createDataFrame([(i, [float(v) for v in row], label) for i, row in enumerate(x)], f"vec_id long, embedding array<double>, label {'string' if label == 'one' else 'long'}")
    got = vectors.near_duplicates(spark, df).agg(F.sum("n_links")).first()[0]
    assert 0.99 * links <= got <= links


def test_lengths_labels_and_extreme_values(spark):
    rows = [(1, [1.0, 2.0], 0.5), (2, [1.01, 2.0], 0.5), (3, [1.0, 2.0], 0.25), (4, [1.0, 2.0, 3.0], 0.5), (5, [2.0, 4.0, 6.1], 0.5), (6, [1e200, 1e200], 0.5), (7, [1e-200, 1e-200], 0.5), (8, [5.0], 0.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark, df).collect()}
    # the cosine of (1, 2) and (1, 1) is 0.949
    assert got == {1: (3, 1), 2: (3, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (3, 1), 7: (3, 1), 8: (0, 8)}
    near = ann.nearest(spark, df.where("vec_id not in (6, 7)"), F.lit(True), most=20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in near) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1), (4, 1, 5), (5, 1, 4)]


def test_small_clusters_get_full_answers(spark):
    r = np.random.default_rng(6)
    x = np.repeat(r.standard_normal((400, 24)), 5, axis=0) + 0.001 * r.standard_normal((2000, 24))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(spark, df, F.col("vec_id") % 20 == 0).groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("d"), F.sort_array(F.collect_list("vec_id")).alias("v")).collect()
    assert len(got) == 100 and all(g["n"] == g["d"] == 20 for g in got)
    hit = 0
    for g in got:
        s = x @ x[g["query_id"]]
        s[g["query_id"]] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & set(g["v"]))
    assert hit >= 0.9 * 20 * len(got)


def test_nearest_recall_and_ties(spark):
    x, df, _ = make(spark, 900, 1)
    got = ann.nearest(spark, df, F.col("vec_id") % 20 == 0, most=20).collect()
    asked = [i for i in range(len(x)) if i % 20 == 0] + [9000 + 5 - 9005 % 20] * 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.r_[np.arange(len(x)), 9005]
    full = np.concatenate((x, x[:1]))
    hit = 0
    for q in asked:
        s = full @ full[q]
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        answer = sorted(by[q])
        assert [r for r, _, _ in answer] == list(range(1, 21))
        hit += len({int(ids[i]) for i in best} & {v for _, v, _ in answer})
        assert all(abs(c - full[np.flatnonzero(ids == v)[0]] @ full[q]) < 1e-9 for _, v, c in answer)
    assert hit >= 0.9 * 20 * len(asked)
    few = df.where("vec_id < 5")
    assert ann.nearest(spark, few, F.col("vec_id") == 0, most=20).count() == 4
    assert ann.nearest(spark, df.limit(0), F.col("vec_id") == 0).count() == 0


def test_start_partitions_stay_connected(spark, monkeypatch):
    monkeypatch.setattr(ann, "START_NODES", 300)
    x, df, _ = make(spark, 3000, 2)
    got = ann.nearest(spark, df.where("vec_id < 9000"), F.col("vec_id") % 20 == 0, most=20).select("query_id", "vec_id").collect()
    hit = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(len(x)), -s))[:20].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert len(got) == len({tuple(r) for r in got}) == 20 * 150
    assert hit >= 0.95 * len(got)


@pytest.mark.parametrize("seed", [0, 1])
def test_components_of_paths_and_stars(spark, seed):
    from lociflow.llm.common import Scratch
    from lociflow.llm.components import components

    r = random.Random(seed)
    path = [(i, i + 1) for i in range(60)]
    star = [(100, 101 + i) for i in range(50)]
    edges = path + star + [(7, 7), (300, 301), (301, 300)]
    r.shuffle(edges)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 151)} | {300: 300, 301: 300}


def odd_documents(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    one, shared = text(60), text(80)
    rows = [(None, one), (None, one), (None, one + " more"), (1, text(50)), (1, text(50)), (2, None), (3, ""), (4, shared + " " + text(30)), (5, shared + " " + text(30)), (None, text(40)), (None, text(40)), (6, text(40)), (6, text(40))]
    return spark.createDataFrame([(i, t, "en", "s" if n % 2 else None, 7) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_with_null_and_repeated_ids(spark, data):
    import corpus_pipeline as p

    odd = odd_documents(spark)
    key = lambda df: sorted((tuple(r) for r in df.select(*p.COLUMNS).collect()), key=repr)
    rows = key(odd)
    # the copies of a text without an id and what is near them, and the null and the empty text, are a group each
    left = key(p.near_duplicates(spark, odd, data))
    assert len(left) == 10 and set(left) <= set(rows) and sum(x[0] is None for x in left) == 3 and [x[0] for x in left if not x[1]] == [2]
    cut = key(p.repeated_passages(spark, odd, data))
    assert {x[0] for x in cut} >= {1, 4, 5, 6} and sum(x[0] is None for x in cut) >= 2 and all(x[4] == len(x[1]) for x in cut if x[0] in (4, 5))
    mixed = key(p.mix(spark, odd, data))
    assert sum(x[0] is None for x in mixed) > 3 and set(mixed) <= set(rows) and all(mixed.count(x) <= 2 * rows.count(x) for x in mixed)
    words = lambda xs: sum(len((x[1] or "").split()) for x in xs)
    assert abs(words(mixed) - 1.5 * words(rows)) <= 120
    assert p.encode(spark, odd, data).count() == len(rows)
    none = odd.limit(0)
    assert all(f(spark, none, data).count() == 0 for _, f in p.STAGES)


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = corpus_pipeline.run(spark, data)
    rows = out.collect()
    known = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mix", "encode"]
    assert rows and {r["doc_id"] for r in rows} <= known and all(r["n_tokens"] == len(r["ids"]) and r["parity"] for r in rows)
