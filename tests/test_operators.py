"""Clusters, labels, alignments, statistics, stores and streams on small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from lociflow.operators import graph, labels, msa, neighbours, popstat, telemetry
from lociflow.sources import io
from lociflow.streaming import ingest


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def net(spark):
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate("abcdefm")], "sample_id string, node_id long")
    pairs = [("a", "b", 1), ("b", "c", 1), ("d", "e", 0), ("m", "c", 1), ("m", "d", 1), ("e", "f", 9)]
    edges = spark.createDataFrame(pairs + [(b, a, d) for a, b, d in pairs], "a string, b string, dist int")
    return nodes, edges, spark.createDataFrame([("m",)], "sample_id string")


def test_mixed_samples_in_three_modes(spark, net):
    nodes, edges, mixed = net
    assert rows(graph.clusters(spark, nodes, edges, 2), "sample_id", "cluster_id") == [("a", 0), ("b", 0), ("c", 0), ("d", 0), ("e", 0), ("f", 5), ("m", 0)]
    assert rows(graph.clusters(spark, nodes, edges, 2, mixed, "exclude"), "sample_id", "cluster_id") == [("a", 0), ("b", 0), ("c", 0), ("d", 3), ("e", 3), ("f", 5), ("m", 6)]
    got = graph.clusters(spark, nodes, edges, 2, mixed, "include")
    assert rows(got.where("sample_id = 'm'"), "cluster_id", "change_id") == [(0, 6), (3, 6)]
    with pytest.raises(ValueError):
        graph.clusters(spark, nodes, edges, 2, mixed, "maybe")


def test_spanning_tree_and_representatives(spark, net):
    nodes, edges, _ = net
    found = graph.clusters(spark, nodes, edges, 2)
    assert graph.spanning_trees(found, edges, 2).count() == 5
    picked = {r[0] for r in graph.representatives(spark, nodes, edges).collect()}
    linked = {(r["a"], r["b"]) for r in edges.collect()}
    assert not any((x, y) in linked for x in picked for y in picked)
    assert all(x in picked or any((x, y) in linked for y in picked) for x in "abcdefm")
    body = json.loads(graph.network_json(nodes, edges, 2).first()["elements"])
    assert len(body["nodes"]) == 7 and len(body["edges"]) == 5
    assert graph.network_json(nodes, edges, 2, max_edges=2).first()["success"] == 0


def test_labels_carry_over(spark):
    found = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 3), ("f", 3)], "sample_id string, cluster_id long")
    before = spark.createDataFrame([("a", "AA001"), ("c", "AA001v1")], "sample_id string, label string")
    assert rows(labels.assigned(found, before), "cluster_id", "label") == [(1, "AA001v1"), (2, "AA001v2"), (3, "AA002")]
    wrong = spark.createDataFrame([(1, "x"), (2, "x"), (9, "y")], "cluster_id long, label string")
    assert {r["problem"] for r in labels.check_one_to_one(wrong, found).collect()} == {"label of several clusters", "no such cluster"}


def test_neighbour_forms(spark):
    edges = spark.createDataFrame([("src", x, d) for x, d in (("1", 12), ("2", 0), ("3", 3), ("4", 4), ("5", 5))], "a string, b string, dist int")
    assert all(neighbours.neighbours(edges, 20, "src", f).count() == 5 for f in (1, 3, 4))
    with pytest.raises(NotImplementedError):
        neighbours.neighbours(edges, 20, "src", 2)


def test_unknown_expectations(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "sample_id string, all_n_or_m long")
    assert msa.expected_unknown(counts).first()["median_unknown"] == 2.0
    assert msa.expected_unknown(counts, 30).first()["median_unknown"] is None


def test_false_discovery(spark):
    fits = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.5)], "id string, p_value double")
    assert rows(popstat.false_discovery(fits), "id", "fdr") == [("a", 0.03), ("b", 0.03), ("c", 0.5)]


def test_poisson_finds_a_trend(spark):
    table = spark.createDataFrame([("1_0", t, int(100 * 1.1**t), 10_000) for t in range(-10, 1)], "pc_cat string, t int, n long, n_total long")
    r = popstat.poisson_trends(table).first()
    assert r["status"] == "completed" and abs(r["slope"] - 0.0953) < 0.01 and r["p_value"] < 1e-6
    assert popstat.poisson_trends(table.limit(2)).first()["status"] == "failed"


def test_throttle(spark):
    events = spark.sql("select id as event_id, 1L as user_id, timestamp_seconds(id * 40) as ts from range(6)")
    assert rows(telemetry.throttled(events, 60), "event_id") == [(0,), (2,), (4,)]


def test_fasta_masks_and_stores(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">COG/s:1/2020\nACg\nT?\n>s2 rest\nAC\n")
    assert rows(io.load_multifasta(spark, str(tmp_path / "x.fasta"), 5), "sample_id", "seq") == [("s-1", "ACGTN")]
    (tmp_path / "m.vcf").write_text("##x\n#CHROM\tPOS\nref\t5\nref\t9\n")
    assert rows(io.mask_from_vcf(spark, str(tmp_path / "m.vcf")), "pos") == [(4,), (8,)]
    store = io.Store(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert store.insert("t", one, "k") == 2 and store.insert("t", one, "k") == 0
    with pytest.raises(FileExistsError):
        store.insert("t", one, "k", strict=True)
    store.put("kv", "x", "1")
    store.put("kv", "x", "2")
    assert store.get("kv", "x") == "2" and store.get_if_newer("kv", "x", 2) is None and store.get_if_newer("kv", "x", 1) == (2, "2")


def test_stream_equals_batch(spark, tmp_path):
    ref = "ACGTACGTAC"
    seqs = {"a": "ACGTACGTAC", "b": "ACGTACGTAA", "c": "ACGTACGTNA", "d": "TTTTTTTTTT", "e": "NNNNNNNNNN"}
    src = tmp_path / "in"
    src.mkdir()
    for i, part in enumerate((["a", "d"], ["b", "a"], ["c", "e"])):
        (src / f"{i}.json").write_text("".join(json.dumps({"sample_id": k, "seq": seqs[k]}) + "\n" for k in part))
    stream = spark.readStream.schema("sample_id string, seq string").option("maxFilesPerTrigger", 1).json(str(src))
    ingest.ingest(spark, stream, str(tmp_path / "store"), ref, (), 3, 2, str(tmp_path / "ckpt")).awaitTermination()
    got = rows(ingest.stored_edges(io.Store(spark, str(tmp_path / "store"))), "a", "b", "dist")
    assert got == [("a", "b", 1), ("a", "c", 1), ("b", "a", 1), ("b", "c", 0), ("c", "a", 1), ("c", "b", 0)]


def test_keys_are_stored_once_deleted_and_listed(spark, tmp_path):
    store = io.Store(spark, str(tmp_path / "kv"))
    assert store.put_new("msa", "x", "1") and not store.put_new("msa", "x", "2")
    store.put("msa", "y", "3")
    store.put("msa", "z", "4")
    assert store.get("msa", "x") == "1" and store.keys("msa") == ["x", "y", "z"]
    store.delete("msa", "y")
    assert store.get("msa", "y") is None and store.delete_unless("msa", ["z"]) == 1 and store.keys("msa") == ["z"]
    assert store.put_new("msa", "y", "5") and store.keys("msa") == ["y", "z"]


def test_a_growing_linkage_keeps_its_versions(spark, net, tmp_path):
    from lociflow.operators.linkage import Linkage

    _, edges, mixed = net
    ids = lambda s: spark.createDataFrame([(x,) for x in s], "sample_id string")
    grown = Linkage(spark, str(tmp_path / "g"), 2, "exclude")
    assert grown.add(ids("ab"), edges) == 1 and grown.add(ids("ba"), edges) == -1
    assert grown.persist("g") == 1 and grown.add(ids("cdefm"), edges, mixed) == 6
    assert grown.persist("g") == 2 and grown.refreshed("g", 2) is None
    version, found = grown.refreshed("g", 1)
    assert version == 2 and rows(found, "sample_id", "cluster_id") == [("a", 0), ("b", 0), ("c", 0), ("d", 3), ("e", 3), ("f", 5), ("m", 6)]
