"""What a query makes grows with its samples, not with their pairs, and stays right on tables larger than the fixture's smallest."""

import random

import pytest
from pyspark.sql import functions as F

from lociflow.functions import codec
from lociflow.operators import annotations, distance, graph, msa, neighbours
from lociflow.scratch import Scratch
from lociflow.sources import fixture as fx

REF = "ACGTTGCAAGAC"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def texts(n, unknown, seed, stem=REF):
    r = random.Random(seed)
    out = {}
    for i in range(n):
        seq = [c if r.random() < 0.85 else r.choice("ACGT") for c in stem]
        for _ in range(r.randint(0, unknown)):
            seq[r.randrange(len(seq))] = r.choice("NR")
        out[f"s{i:03d}"] = "".join(seq)
    return out


def compressed(spark, data):
    return codec.compress(spark.createDataFrame(list(data.items()), "sample_id string, seq string"), REF)


def brute(data, ceiling):
    dist = lambda x, y: sum(p != q and p in "ACGT" and q in "ACGT" for p, q in zip(x, y, strict=True))
    return sorted((a, b, d) for a in data for b in data if a < b and (d := dist(data[a], data[b])) <= ceiling)


@pytest.fixture
def written(monkeypatch):
    """Rows of every intermediate table."""
    sizes, write = [], Scratch.write

    def count(self, df):
        out = write(self, df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", count)
    return sizes


@pytest.mark.parametrize(("unknown", "ceiling"), [(0, 2), (1, 0), (1, 1), (1, 2), (3, 2)])
def test_pairs_by_keys_are_those_of_brute_force(spark, unknown, ceiling):
    data = texts(60, unknown, 7)
    s, v, u = compressed(spark, data)
    assert rows(distance.near_pairs(s, v, u, ceiling), "a", "b", "dist") == brute(data, ceiling)


def test_an_own_base_and_an_unknown_one_at_the_same_place(spark):
    data = {"a": "T" + REF[1:], "b": "G" + REF[1:], "c": "N" + REF[1:], "d": REF, "e": "T" + REF[1:-1] + "N", "f": "N" + REF[1:-1] + "G"}
    s, v, u = compressed(spark, data)
    for ceiling in (0, 1, 2):
        assert rows(distance.near_pairs(s, v, u, ceiling), "a", "b", "dist") == brute(data, ceiling)


def test_keys_make_no_pair_beyond_the_ceiling(spark, written):
    # 3 x 11 x 10 variants of one stem by two bases: all pairs share a position with many others
    data = {}
    for i in range(1, 12):
        for j in range(1, i):
            seq = list("T" + REF[1:])
            seq[i], seq[j] = "A" if seq[i] != "A" else "C", "A" if seq[j] != "A" else "C"
            data[f"s{i:02d}{j:02d}"] = "".join(seq)
    s, v, u = compressed(spark, data)
    want = brute(data, 1)
    assert rows(distance.near_pairs(s, v, u, 1), "a", "b", "dist") == want
    assert max(written) <= len(data) * 20  # keys; 'met' held all 1,485 pairs before


def profiled(spark, data):
    s, v, u = compressed(spark, data)
    members = distance.profiles(s, v, u)
    return s, u, members, distance.links(members, v, u, 2), distance.edges(s, v, u, 2)


def test_clusters_and_degrees_of_profiles_are_those_of_samples(spark):
    data = texts(25, 1, 3)
    data |= {f"t{i:03d}": seq for i, seq in enumerate(list(data.values())[:15] * 2)}
    s, u, members, links, edges = profiled(spark, data)
    nodes = spark.createDataFrame([(x, (i * 7) % 101) for i, x in enumerate(sorted(data))], "sample_id string, node_id long")
    mixed = u.where("kind = 'M'").select("sample_id").distinct()
    cols = "sample_id", "node_id", "cluster_id", "change_id", "is_mixed"
    for mode in graph.MODES:
        m = None if mode == "ignore" else mixed
        assert rows(graph.profile_clusters(spark, nodes, members, links, 1, m, mode), *cols) == rows(graph.clusters(spark, nodes, edges, 1, m, mode), *cols)
    degree = distance.degrees(links, members)
    assert rows(graph.degree_scores(nodes, degree), "sample_id", "degree", "degree_z") == rows(graph.degree_z(nodes, edges), "sample_id", "degree", "degree_z")
    assert rows(annotations.shards_of(degree), "shard", "n_samples", "n_edges") == rows(annotations.shards(edges), "shard", "n_samples", "n_edges")
    n = u.where("kind = 'M'").groupBy("sample_id").agg(F.count("*").alias("n_mixed"))
    cols = "a", "b", "n_mixed", "rank"
    assert rows(neighbours.top_mixed_of_profiles(links, members, n, 3), *cols) == rows(neighbours.top_mixed(edges, n, 2, 3), *cols)
    place = nodes.select("sample_id", (F.col("node_id") % 3).alias("place"))
    got = rows(distance.histogram(links, members.join(place, "sample_id"), "place"), "place", "dist", "n")
    at = dict(rows(place, "sample_id", "place"))
    want = {}
    for a, b, d in rows(edges, "a", "b", "dist"):
        if at[a] == at[b]:
            want[at[a], d] = want.get((at[a], d), 0) + 1
    assert got == sorted((*k, n) for k, n in want.items())


def test_many_equal_samples_make_no_pairs(spark, written):
    ids = spark.range(2000).select(F.format_string("s%05d", "id").alias("sample_id"), F.col("id").alias("node_id"))
    members = ids.select("sample_id", F.lit("s00000").alias("profile"))
    links = spark.createDataFrame([], "a string, b string, dist int")
    found = graph.profile_clusters(spark, ids, members, links, 1)
    assert graph.cluster_sizes(found).first()["n"] == 2000 and graph.change_feed(found, 50).count() == 2000
    assert distance.degrees(links, members).agg(F.sum("degree")).first()[0] == 2000 * 1999
    assert distance.thinned(links, members).count() == 2 * 1999 and max(written) <= 2000


def test_equal_samples_are_expanded_from_bounded_arrays(spark, monkeypatch):
    monkeypatch.setattr(distance, "CHUNK", 3)
    data = texts(12, 1, 5)
    data |= {f"t{i:03d}": seq for i, seq in enumerate(list(data.values()) * 2)}
    _, _, members, links, _ = profiled(spark, data)
    want = brute(data, 2)
    assert rows(distance.expanded(links, members, both=False), "a", "b", "dist") == want
    assert rows(distance.expanded(links, members), "a", "b", "dist") == sorted(want + [(b, a, d) for a, b, d in want])
    one = rows(distance.expanded(links, members, members.where("sample_id = 't003'")), "b", "dist")
    assert one == sorted((a if b == "t003" else b, d) for a, b, d in want if "t003" in (a, b))
    dump = annotations.numbered_dump(distance.expanded(links, members, both=False))
    assert rows(dump, "id", "a", "b", "dist") == [(i, *w) for i, w in enumerate(want)]


def test_components_of_thinned_edges_in_parts(spark):
    data = texts(25, 1, 3)
    data |= {f"t{i:03d}": seq for i, seq in enumerate(list(data.values())[:15] * 2)}
    _, _, members, links, edges = profiled(spark, data)
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate(sorted(data))], "sample_id string, node_id long")
    part = F.pmod(F.xxhash64("sample_id"), F.lit(3)).alias("part")
    thin = distance.thinned(links, members.select("sample_id", "profile", part), "part")
    for upto in range(3):
        some = nodes.select("sample_id", "node_id", part).where(F.col("part") <= upto)
        known = lambda e, some=some: neighbours.induced(e, some)
        assert rows(graph.clusters(spark, some, known(thin), 1), "sample_id", "cluster_id") == rows(graph.clusters(spark, some, known(edges), 1), "sample_id", "cluster_id")


def test_labels_that_begin_again_are_decoded(spark):
    n = spark.createDataFrame([(x,) for x in (5, 575_999, 576_000, 900_000, 5_400_000)], "n long")
    got = n.select("n", codec.label_encode(F.col("n")).alias("label"), codec.label_round(F.col("n")).alias("again")).withColumn("back", codec.label_decode(F.col("label"), F.col("again")))
    assert all(r["n"] == r["back"] for r in got.collect()) and rows(got, "n", "label")[2][1] == "AA000"


def test_a_cluster_that_varies_everywhere_has_no_constant_sites(spark):
    sites = spark.createDataFrame([("x", p) for p in range(4)] + [("y", 0)], "cluster_id string, pos int")
    clusters = spark.createDataFrame([("x",), ("y",), ("z",)], "cluster_id string")
    assert rows(msa.constant_sites(sites, clusters, "ACTG", ()), "cluster_id", "n_a", "n_c") == [("y", 0, 1), ("z", 1, 1)]


def test_small_tables_are_dealt_over_the_cores(spark, data):
    for df in (fx.customers(spark, data), fx.raw_sequences(spark, data), fx.long_sequences(spark, data)):
        assert df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_differences_in_case_and_of_characters_of_several_bytes(spark):
    data = {"a": REF.lower(), "b": "é" + REF[1:], "c": REF[:-1] + "\U0001f600", "d": "?" + REF[1:-1] + "-", "e": REF[:-1], "f": REF + "A", "g": "éN" + REF[2:]}
    _, v, u = compressed(spark, data)
    assert v.count() == 0
    assert rows(u, "sample_id", "pos", "code") == [("b", 0, "É"), ("c", 11, "\U0001f600"), ("d", 0, "?"), ("d", 11, "N"), ("g", 0, "É"), ("g", 1, "N")]


@pytest.mark.parametrize("name", ["content_hash", "rcs_json", "allele_counts", "category_row", "dense_calendar", "annotations_replaced", "msa_variant_positions", "one_to_all", "position_vector"])
def test_sequences_are_compared_in_one_written_pass(spark, data, written, name):
    from lociflow.plans import catalogue

    assert catalogue.QUERIES[name](spark, data).count() > 0
    assert len(written) == 1  # the others are read from it; there were four, and more passes that weren't written


def test_alignments_and_tests_are_made_in_rows_of_their_own(spark):
    from statistics import median

    data = texts(40, 2, 11)
    s, v, u = compressed(spark, data)
    members = s.select("sample_id", F.when(F.col("sample_id") < "s020", "x").otherwise("y").alias("cluster_id")).where("sample_id <> 's039'")
    sites = msa.variant_positions(members, v, len(REF), REF, u).where("pos > 2")
    found = msa.aligned(members, sites, v, u, REF)
    at = {c: sorted(p for x, p in rows(sites, "cluster_id", "pos") if x == c) for c in "xy"}
    got = {r["sample_id"]: r for r in found.collect()}
    assert len(got) == 39
    for k, r in got.items():
        want = "".join(data[k][p] for p in at[r["cluster_id"]])
        assert r["aligned_mseq"] == want and r["aligned_seq"] == want.replace("R", "M") and r["aligned_seq_len"] == len(want)
        assert (r["align_n"], r["align_m"]) == (want.count("N"), want.count("R"))
    tests = msa.mixture_tests(found, msa.unknown_counts(s, u), sites, len(REF), len(REF), 0.1)
    assert "shares" not in tests._jdf.queryExecution().optimizedPlan().toString()  # every row held the shares of all members of its cluster
    share = {k: (r["align_n"] + r["align_m"]) / r["aligned_seq_len"] for k, r in got.items()}
    for r in tests.collect():
        others = [x for k, x in share.items() if got[k]["cluster_id"] == r["cluster_id"] and k != r["sample_id"]]
        assert r["expected_proportion4"] == round(median(others), 9)


def test_binomial_tails_of_many_trials(spark):
    from math import comb

    for k, n, p in ((1, 1, 0.3), (1, 40, 0.01), (40, 40, 0.9), (7, 30, 0.2), (5, 3, 0.5)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert abs(spark.range(1).select(msa.binomial_tail(F.lit(k), F.lit(n), F.lit(p))).first()[0] - want) < 1e-12
    assert abs(spark.range(1).select(msa.binomial_tail(F.lit(5000), F.lit(10_000), F.lit(0.5))).first()[0] - 0.5 - comb(10_000, 5000) / 2**10_001) < 1e-9


def test_letters_are_counted_in_rows_of_their_own(spark):
    from lociflow.operators import mixture

    df = spark.createDataFrame([("x", "a", "AANR"), ("x", "b", ""), ("y", "a", "TT")], "cluster_id string, sample_id string, aligned_mseq string")
    found = mixture.letter_counts(df)
    assert rows(found, "cluster_id", "sample_id", "letter", "n") == [("x", "a", "A", 2), ("x", "a", "N", 1), ("x", "a", "R", 1), ("y", "a", "T", 2)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
