"""Reference compression and scalar functions on literal cases with known answers."""

import pytest
from pyspark.sql import functions as F

from lociflow.functions import codec
from lociflow.operators import distance, msa

REF = "ACTG"


def seqs(spark, **named):
    return spark.createDataFrame(list(named.items()), "sample_id string, seq string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_differences_and_unknown_positions(spark):
    _, v, u = codec.compress(seqs(spark, a="TCT-", b="ATT-", c="NYTQ"), REF)
    assert rows(v, "sample_id", "pos", "base") == [("a", 0, "T"), ("b", 1, "T")]
    assert rows(u.where("sample_id <> 'c'"), "sample_id", "pos", "kind") == [("a", 3, "N"), ("b", 3, "N")]
    assert rows(u.where("sample_id = 'c'"), "pos", "code") == [(0, "N"), (1, "Y"), (3, "Q")]


def test_round_trip(spark):
    texts = ["AAAA", "CCCC", "TTTT", "GGGG", "NNNN", "ACTG", "ACTC", "TCTN", "NYTR"]
    df = spark.createDataFrame([(t, t) for t in texts], "sample_id string, seq string")
    assert rows(codec.uncompress(*codec.compress(df, REF), REF), "sample_id", "seq") == sorted((t, t) for t in texts)


def test_too_many_unknown_is_invalid(spark):
    s, v, u = codec.compress(seqs(spark, a="NNNN", b="ANNN"), REF, max_unknown=3)
    assert rows(s, "sample_id", "invalid") == [("a", 1), ("b", 0)]
    assert v.where("sample_id = 'a'").count() == u.where("sample_id = 'a'").count() == 0


@pytest.mark.parametrize(("x", "y", "d"), [("AAAA", "CCCC", 4), ("AAAA", "RRCC", 2), ("AAAA", "RRNN", 0), ("ACTG", "ACTG", 0)])
def test_pair_distances(spark, x, y, d):
    s, v, u = codec.compress(seqs(spark, a=x, b=y), REF)
    assert rows(distance.half_matrix(s, v, u, 10), "a", "b", "dist") == [("a", "b", d)]
    assert rows(distance.one_to_all("a", s, v, u), "a", "b", "dist") == [("a", "b", d)]


def test_distance_equals_position_count_for_random_sequences(spark):
    import random

    r = random.Random(3)
    ref = "ACGTTGCAAG"
    data = {f"s{i:02d}": "".join(c if r.random() < 0.7 else r.choice("ACGTNR") for c in ref) for i in range(25)}
    s, v, u = codec.compress(seqs(spark, **data), ref)
    for ceiling in (0, 2, 10):
        want = sorted((a, b, sum(x != y and x in "ACGT" and y in "ACGT" for x, y in zip(data[a], data[b], strict=True))) for a in data for b in data if a != b)
        assert rows(distance.edges(s, v, u, ceiling), "a", "b", "dist") == [w for w in want if w[2] <= ceiling]


def test_reference_must_be_bases():
    with pytest.raises(TypeError):
        codec.check_reference("ACGN")


def test_composition(spark):
    r = codec.composition(seqs(spark, a="acgt", b="ACNR")).orderBy("sample_id").collect()
    assert r[0]["seq_md5"] == "f1f8f4bf413b16ad135722aa4591043e" and r[0]["prop_actg"] == 1.0
    assert (r[1]["n_N"], r[1]["n_mixed"], r[1]["prop_actg"]) == (1, 1, 0.5)
    assert codec.composition(seqs(spark, a="AC!T")).first()["prop_actg"] is None


def test_identifiers_and_labels(spark):
    one = spark.range(1)
    ids = codec.set_identifier(F.array(F.lit("3"), F.lit("1"), F.lit("2")), "msa", "all")
    assert one.select(ids).first()[0].split("|")[:3] == ["msa", "all", "no_og"]
    got = spark.range(1, 5).select(codec.label_encode(F.col("id")).alias("x")).collect()
    assert [r["x"] for r in got] == ["AA001", "AA002", "AA003", "AA004"]
    back = spark.createDataFrame([("AA004v2",), ("AB000",), ("nonsense",)], "x string").select(codec.label_decode(F.col("x"))).collect()
    assert [r[0] for r in back] == [4, 1000, None]


def test_binomial_tail(spark):
    p = lambda k, n, q: spark.range(1).select(msa.binomial_tail(F.lit(k), F.lit(n), F.lit(q))).first()[0]
    assert abs(p(3, 10, 0.1) - 0.0701908264) < 1e-12
    assert p(0, 10, 0.1) == 1.0 and p(2, 10, 0.0) == 0.0 and p(10, 10, 1.0) == 1.0 and p(1, 0, 0.1) is None


def test_json_round_trip(spark):
    s, v, u = codec.compress(seqs(spark, a="TCTR", b="ACTG"), REF)
    got = {r["sample_id"]: r for r in codec.from_json(codec.to_json(s, v, u)).collect()}
    assert got["a"]["T"] == [0] and got["a"]["M"] == {"3": "R"} and got["a"]["U"] == [3] and got["b"]["A"] == []


def test_masks_and_references_of_real_size(spark):
    from lociflow.sources import fixture as fx

    assert len(fx.LONG_REFERENCE) == 29_903 and len(fx.LONG_MASK) == 386
    seq = list(fx.LONG_REFERENCE)
    for p in (0, 55, 132, 200, 29_902):
        seq[p] = "T" if seq[p] != "T" else "A"
    seq[300] = "-"
    parts = codec.compress(seqs(spark, a="".join(seq)), fx.LONG_REFERENCE, fx.LONG_MASK, 10)
    assert [p for _, p in rows(parts[1], "sample_id", "pos")] == [0, 200, 29_902] and rows(parts[2], "pos", "kind") == [(300, "N")]
    back = codec.uncompress(*parts, fx.LONG_REFERENCE, fx.LONG_MASK).first()["seq"]
    assert all(b == ("N" if i in set(fx.LONG_MASK) or i == 300 else c) for i, (b, c) in enumerate(zip(back, seq, strict=True)))


def test_a_position_that_most_vary_at(spark):
    import random

    r = random.Random(5)
    ref = "ACGTTGCAAGAC"
    stem = "T" + ref[1:5] + "C" + ref[6:]  # two bases that nearly all share
    data = {f"s{i:02d}": "".join(c if r.random() < 0.85 else r.choice("ACGTNR") for c in (stem if i % 10 else ref)) for i in range(40)}
    s, v, u = codec.compress(seqs(spark, **data), ref)
    want = sorted((a, b, sum(x != y and x in "ACGT" and y in "ACGT" for x, y in zip(data[a], data[b], strict=True))) for a in data for b in data if a != b)
    assert rows(distance.edges(s, v, u, 3), "a", "b", "dist") == [w for w in want if w[2] <= 3]
    turned = distance.turned(s, v, u)
    assert turned.groupBy("pos", "base").count().agg(F.max("count")).first()[0] <= 20 < v.groupBy("pos", "base").count().agg(F.max("count")).first()[0]
    new = s.where("sample_id >= 's30'")
    got = rows(distance.new_edges(s, new, v, u, 3), "a", "b", "dist")
    assert got == [w for w in want if w[2] <= 3 and (w[0] >= "s30" or w[1] >= "s30")]
