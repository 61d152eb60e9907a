"""Corpus operators on text against brute force, and with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from lociflow.llm import licenses, maintext, mixing, perplexity, sentencepieces, simhash, suffixes, toxicity
from lociflow.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, label int"


def table(spark, texts, **more):
    """Documents with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, more.get("lang", "en"), f"s{i % 3}" if i and i % 4 else None, 0, -1, 1) for i, t in texts], SCHEMA)


def odd_texts():
    r = random.Random(1)
    words = [a + b for a in "ba ke lo mi".split() for b in "ra te so".split()]
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n))
    long = sentence(3000)
    body = [(1, None), (2, ""), (3, "one"), (4, " \t\n"), (5, long), (6, long), (7, long[:4000] + " other end"), (8, "é€😀 " * 40), (9, "é€😀 " * 40), (9, "é€😀 " * 40), (None, "no id here"), (10, "a" * 700), (11, "x " + sentence(60))]
    return body + [(20 + i, sentence(40)) for i in range(12)]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, odd_texts())


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_words(text, each):
    words = text.split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + each]).encode(), 42) for i in range(len(words) - each + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, odd, none):
    got = simhash.near_duplicates(spark, odd).collect()
    want = [(i, brute_fingerprint(t)) for i, t in odd_texts()]
    assert sorted((r["doc_id"] or -1, r["fp"] & (1 << 64) - 1) for r in got) == sorted((i or -1, f) for i, f in want)
    ids = [(i, f) for i, f in want if i is not None]
    up = {i: i for i, _ in ids}
    for _ in ids:
        for i, f in ids:
            for j, g in ids:
                if (f ^ g).bit_count() <= 3:
                    up[i] = up[j] = min(up[i], up[j])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]} == up
    assert simhash.near_duplicates(spark, none).count() == 0


def test_wide_buckets_lose_no_link():
    import numpy as np

    r = random.Random(2)
    base = r.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(3000)})
    fp = np.array(fps, np.uint64)
    n = len(fp)
    sets = simhash.Unions(n)
    for a, b in simhash._matches(np.zeros(n, np.int64), np.zeros(n, bool), fp, 3):
        sets.union(a, b)
    want = simhash.Unions(n)
    for i in range(0, n, 500):
        a, b = np.nonzero(np.bitwise_count(fp[i : i + 500, None] ^ fp[None]) <= 3)
        want.union(a + i, b)
    assert (sets.labels() == want.labels()).all()


def test_near_copies_of_five_word_shingles(spark, odd):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(8):
        base = [r.choice(words) for _ in range(120)]
        for c in range(4):
            copy = list(base)
            for _ in range(c):
                copy[r.randrange(120)] = f"n{r.random()}"
            texts.append((100 * g + c, " ".join(copy)))
    shingles = {i: {tuple(t.split()[j : j + 5]) for j in range(116)} for i, t in texts}
    up = {i: i for i in shingles}
    for _ in range(4):
        for i in up:
            for j in up:
                if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                    up[i] = up[j] = min(up[i], up[j])
    kept = simhash.keep_one(spark, table(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(up.values()))
    left = simhash.keep_one(spark, odd)
    assert left.columns == odd.columns and left.where("doc_id = 8").count() == 1 and left.where("doc_id = 9").count() == 0 and left.where("doc_id is null").count() == 1


def near_limit(n, size, edits, seed, families=1):
    """Texts of random words, each with random word edits of its family's base, and their groups by brute force."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(families):
        base = [r.choice(words) for _ in range(size)]
        for _ in range(n):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(size)] = r.choice(words)
            texts.append((len(texts), " ".join(copy)))
    shingles = [{tuple(t.split()[j : j + 5]) for j in range(size - 4)} for _, t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    sets = simhash.Unions(len(texts))
    import numpy as np

    sets.union(*(np.array(x, np.int64) for x in zip(*near, strict=True)))
    return texts, sets.labels().tolist()


def test_failed_candidates_do_not_break_groups(spark):
    texts, want = near_limit(200, 150, 2, 3)
    for parts in (8, 32):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = {r["rep"]: r["component"] for r in simhash.similar_groups(spark, table(spark, texts)).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert [got[i] for i, _ in texts] == want


def test_isolated_pairs_at_the_limit_are_found(spark):
    texts, want = near_limit(2, 150, 2, 4, 1500)
    got = {r["rep"]: r["component"] for r in simhash.similar_groups(spark, table(spark, texts)).collect()}
    assert [got[i] for i, _ in texts] == want


def test_texts_of_pairs_that_sketches_rule_out_are_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 1)  # so that shared shingles are not known to be common
    r = random.Random(8)
    texts = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(150)) + "".join(f" c{j}" for j in range(30))) for i in range(60)]
    texts += [(100 + i, t + " more") for i, t in texts[:5]]
    gathered = []
    write = simhash.Scratch.write

    def watched(self, df, *args, **more):
        out = write(self, df, *args, **more)
        if "text" in out.columns:
            gathered.append({x["doc_id"] for x in out.select("doc_id").collect()})
        return out

    monkeypatch.setattr(simhash.Scratch, "write", watched)
    got = {x["rep"]: x["component"] for x in simhash.similar_groups(spark, table(spark, texts)).collect()}
    assert got == {i: i % 100 for i, _ in texts}
    assert len(set().union(*gathered)) == 10


def test_rows_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 1)  # so that all texts meet in the buckets of their common part
    p, base = 17, [f"b{i}" for i in range(155)]
    # two texts have at most one of five passages in common: similarities just below the limit, which sketches don't tell apart
    texts = [(p * a + b, " ".join(base + [f"c{x}_{(a * x + b) % p}_{y}" for x in range(5) for y in range(5)])) for a in range(p) for b in range(p)]
    texts += [(1000 + i, t + " more") for i, t in texts[:5]]
    sizes = []
    write = simhash.Scratch.write

    def watched(self, df, *args, **more):
        out = write(self, df, *args, **more)
        if {"rep", "u"} & set(out.columns) and out.columns != ["key", "rep", "n", "place"]:  # the entries themselves are as many as prefixes have shingles
            sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash.Scratch, "write", watched)
    got = {x["rep"]: x["component"] for x in simhash.similar_groups(spark, table(spark, texts)).collect()}
    assert got == {i: i % 1000 for i, _ in texts}
    assert max(sizes) <= 10 * len(texts)


def test_sketches_rule_out_no_similar_pair():
    import numpy as np

    r = np.random.default_rng(9)
    for n in (0, 1, 63, 64, 65, 700, 5000, 40_000):
        a = np.unique(r.integers(-(2**62), 2**62, n))
        for gone, new in ((0, 0), (3, 5), (n // 10, n // 4), (n, n)):
            b = np.unique(np.concatenate((a[gone:], r.integers(-(2**62), 2**62, new))))
            assert simhash.sketched_difference(simhash.odd_sketch(a), simhash.odd_sketch(b)) <= len(np.setxor1d(a, b))


def test_fingerprints_find_near_copies_by_themselves(spark, monkeypatch):
    def no_entry(batches):
        for _ in batches:
            pass
        yield from ()

    monkeypatch.setattr(simhash, "_met", no_entry)  # the exact join finds nothing
    r = random.Random(10)
    texts = []
    for g in range(20):
        base = [f"w{r.randrange(10**4)}" for _ in range(1500)]
        texts += [(100 * g + c, " ".join([*base[:700], *["new"] * c, *base[700:]])) for c in range(3)]
    fp = [brute_words(t, 5) for _, t in texts]
    near = {(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3}
    got = {x["rep"]: x["component"] for x in simhash.similar_groups(spark, table(spark, texts)).collect()}
    sets = simhash.Unions(len(texts))
    import numpy as np

    sets.union(*(np.array(x, np.int64) for x in zip(*near, strict=True)))
    assert len(near) > 10
    assert [got[i] for i, _ in texts] == [texts[x][0] for x in sets.labels()]


def brute_cut(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [50_000, 1])
def test_repeats(spark, odd, none, hot):
    texts = [(t or "").encode() for _, t in odd_texts()]
    got = suffixes.repeat_digests(spark, odd, length=60, gram=16, hot=hot).collect()
    want = Counter(zip([i for i, _ in odd_texts()], brute_cut(texts, 60), strict=True))
    assert Counter((r["doc_id"], (r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == want
    if hot > 1:
        kept = suffixes.remove_repeats(spark, odd, length=60, gram=16)
        assert Counter((r["doc_id"], hashlib.sha256(r["kept"]).hexdigest()) for r in kept.collect()) == Counter((i, w[2]) for i, w in want.elements())
        assert suffixes.repeat_digests(spark, none).count() == 0


def test_anchors_take_little_memory_beside_the_texts():
    import tracemalloc

    import pyarrow as pa

    r = random.Random(11)
    texts = [r.randbytes(4000) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(range(2000)), pa.array(texts, pa.binary())], ["t1", "t2", "text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in suffixes._anchored(200, 40)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2000 and most < 100e6


def test_deep_shallow_sort_orders_and_measures():
    import numpy as np

    r = random.Random(4)
    stem = bytes(r.choice(b"ab") for _ in range(150))
    strings = [stem[: r.randint(0, 150)] + bytes(r.choice(b"\0ab") for _ in range(r.randint(0, 60))) for _ in range(300)]
    group = np.array([r.randint(0, 3) for _ in strings])
    order, lcp = suffixes.deep_shallow_sort(group, strings)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group.tolist(), strings, strict=True))
    for a, b, n in zip(order, order[1:], lcp[1:], strict=False):
        x, y = strings[a], strings[b]
        m = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert n == (m if group[a] == group[b] else -1)


def test_mixing(spark, odd, none):
    got = mixing.mix(spark, odd).collect()
    assert len(got) == len(odd_texts()) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    size = {(i, t): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in odd_texts()}
    assert sorted(r["size"] for r in got) == sorted(size[x] for x in odd_texts())
    targets, totals = {r["source"]: r["target"] for r in got}, {r["source"]: r["source_size"] for r in got}
    # refill by weight until no target is above twice its source
    order = sorted((s for s in totals if s is not None)) + [s for s in totals if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, open_, left = {}, set(order), 1.5 * sum(totals.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * totals[s]}
        if not full:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 2.0 * totals[s] for s in full}
        left -= sum(2.0 * totals[s] for s in full)
        open_ -= full
    assert all(abs(targets[s] - want[s]) < 1e-6 for s in order)
    again = mixing.mix(spark, odd.repartition(7)).collect()
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in got) == sorted((r["doc_id"] or -1, r["taken"]) for r in again)
    assert mixing.mix(spark, none).count() == 0


def test_mix_meets_targets_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f g h i j", "s1")] * 50 + [(1, "w " * 40, "s2")] * 30 + [(i, "x " * (i % 20), "s3") for i in range(400)] + [(None, "z " * (1 + i % 9), "s4") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(spark, docs).collect()
    for s in ("s1", "s2", "s3", "s4"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2
    # rates are exponential in a document's size: log(rate) / size is one number for each source
    for s in ("s3", "s4"):
        tilt = {round(math.log(r["rate"]) / r["size"], 6) for r in got if r["source"] == s and r["size"] and r["rate"] < 2}
        assert len(tilt) <= 1


def test_toxicity(spark, odd, none):
    r = random.Random(6)
    plain = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(400):
        words = [r.choice(plain) for _ in range(60)]
        if i % 5 == 0:
            for _ in range(4):
                words[r.randrange(60)] = r.choice(["vileone", "viletwo", "vilethree"])
        texts.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    known = spark.createDataFrame(labels[:300] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    scan = toxicity.fit(spark, table(spark, texts), known)
    got = toxicity.score(spark, table(spark, texts), scan).collect()
    assert all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in got)
    bad = next(r for r in got if r["doc_id"] == 0)
    assert all(any(v in texts[0][1][p["first"] : p["end"]] for v in ("vileone", "viletwo", "vilethree")) for p in bad["passages"])
    strange = toxicity.score(spark, odd, scan).collect()
    assert len(strange) == len(odd_texts()) and all(0 <= r["score"] <= 1 for r in strange) and next(r for r in strange if r["doc_id"] == 2)["score"] == 0.0
    empty = toxicity.fit(spark, table(spark, texts), known.limit(0))
    assert {r["predicted"] for r in toxicity.score(spark, odd, empty).collect()} == {0}
    assert toxicity.score(spark, none, scan).count() == 0


def test_segments_are_maximal():
    r = random.Random(7)
    for _ in range(200):
        s = [r.choice([-2, -1, -1, 1, 2, 3]) for _ in range(r.randint(0, 14))]

        def brute(lo, hi):
            best = max(((sum(s[a:b]), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            a = -best[2]
            b = a - best[1]
            return [*brute(lo, a), (a, b, best[0]), *brute(b, hi)]

        got = toxicity.segments(s)
        assert sum(x[2] for x in got) == sum(x[2] for x in brute(0, len(s)))
        assert max((x[2] for x in got), default=0) == max((x[2] for x in brute(0, len(s))), default=0)


def test_licenses(spark, odd, none):
    texts = [(1, "CC-BY, all rights reserved! cc by cc by"), (2, "Licensed under the Apache License, Version 2.0."), (3, "the GNU General Public License v3"), (4, "nothing at all"), (5, None)]
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, texts)).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (9, 4, 0, 7, "cc-by,reserved")
    assert "apache-2.0" in got[2]["labels"] and got[2]["base_labels"] == ""
    assert got[3]["base_labels"] == "gpl" and "gpl" in got[3]["labels"].split(",")
    assert got[4]["labels"] == "" and got[4]["score"] == 0.0 and got[4]["first_word"] is None and got[5]["n_words"] == 0
    assert len(licenses.rules()) > 200 and licenses.scan(odd).count() == len(odd_texts()) and licenses.scan(none).count() == 0


def test_base_places_by_brute_force(spark):
    r = random.Random(11)
    bits = "cc by CC-BY general public license general public all rights reserved rights cc cc, by; é ccby License".split(" ")
    texts = [(i, None if i == 3 else r.choice([" ", "  ", "-", ", "]).join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(200)]
    got = {x["doc_id"]: x for x in licenses.scan(table(spark, texts)).collect()}
    for i, t in texts:
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        places = [(at, label) for phrase, label in licenses.BASE for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        want = (len(words), len(places), min((a for a, _ in places), default=None), max((a for a, _ in places), default=None), ",".join(sorted({x for _, x in places})))
        assert tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == want
        assert {x for _, x in places} <= set(got[i]["labels"].split(",")) and 0 <= got[i]["score"] <= 1


def test_detections_within_better_ones_go():
    r = random.Random(12)
    better = lambda h: (-h[2].priority, h[0] - h[1], h[0], h[2].label)
    for _ in range(300):
        hits = [(a, a + r.randint(1, 10), licenses.Rule(r.choice("abc"), "", "", r.choice([1, 2, 3]), 0.5)) for a in (r.randint(0, 20) for _ in range(r.randint(0, 25)))]
        kept = []
        for h in sorted(hits, key=better):
            if not any(k[0] <= h[0] and h[1] <= k[1] for k in kept):
                kept.append(h)
        assert licenses.uncontained(hits) == kept
    assert len({(x.label, x.pattern) for x in licenses.rules()}) == len(licenses.rules())


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies, please accept them all now.</div>
<div class="post"><h1>Head</h1><p>A first paragraph of the story, long enough to be text as one may see.<p>Short.<ul><li>one<li>two</ul><div class="ad">Buy this now, it is the best thing ever made.</div>
<p>Last &amp; <b>bold</b>&nbsp;one with <a href=1>a link</a>, and it goes on.</div><section id="comments"><p>I like this article very much, thank you for it.</p></section><footer>&copy; me</footer>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (2, "u", None, 5), (3, "u", "", 5), (3, "u", "<p>", 5), (4, "u", "plain < text", 5)], "page_id long, url string, html string, n_chars int")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in maintext.extract(pages).collect()]
    want = "Head\nA first paragraph of the story, long enough to be text as one may see.\nShort.\none\ntwo\nLast & bold one with a link, and it goes on."
    assert Counter(got) == Counter([(1, want, len(want)), (2, "", 0), (3, "", 0), (3, "", 0), (4, "plain < text", 12)])
    assert maintext.extract(pages.limit(0)).count() == 0


def test_the_cut_overrules_the_text(spark):
    found = maintext.blocks(PAGE)
    own, kept = [maintext.local_cost(b) >= 0 for b in found], maintext.labels(found)
    text = {b.text: (o, k) for b, o, k in zip(found, own, kept, strict=True)}
    # short lines of the article stay, long sentences of a notice, an advert and a comment go
    assert text["one"] == (False, True) and text["Short."] == (False, True)
    assert text["We use cookies, please accept them all now."] == text["Buy this now, it is the best thing ever made."] == text["I like this article very much, thank you for it."] == (True, False)


def test_minimum_cut_is_minimal():
    import itertools

    r = random.Random(8)
    for _ in range(60):
        n = r.randint(1, 7)
        gain = [r.choice([-3.0, -1.0, 0.5, 2.0, 0.0]) for _ in range(n)]
        edges = [(i, j, r.choice([0.5, 1.5])) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        cost = lambda keep: sum(max(g, 0) if not k else max(-g, 0) for g, k in zip(gain, keep, strict=True)) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: E731,B023
        assert abs(cost(maintext.min_cut(n, gain, edges)) - min(cost(k) for k in itertools.product([True, False], repeat=n))) < 1e-9


def test_sentencepiece(spark, odd, none):
    got = sentencepieces.encode(spark, odd.withColumn("ids", F.lit(1)), tokenizer_path())
    rows = got.collect()
    assert len(rows) == len(odd_texts()) and all(r["parity"] and r["round_trip"] for r in rows)
    back = sentencepieces.decode(spark, got.select("doc_id", "ids"), tokenizer_path()).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i, t or "") for i, t in odd_texts())
    assert sentencepieces.encode(spark, none, tokenizer_path()).count() == 0


def brute_kneser_ney(texts):
    """Probability of a character after others under an interpolated modified Kneser-Ney model of order 5, from nested counts."""
    top = Counter()
    for t in texts:
        t = "\n" * 4 + t
        top.update(t[i : i + 5] for i in range(len(t) - 4))
    counts = {5: top}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off = {k: perplexity.discounts(Counter(c.values())) for k, c in counts.items()}
    after = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            after[k][g[:-1]].append(n)
    d = lambda k, n: off[k][min(n, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        seen = after[k].get(g[:-1])
        if seen is None:
            return p(g[1:])
        n = counts[k].get(g, 0)
        return ((n - d(k, n)) if n else 0.0) / sum(seen) + sum(d(k, x) for x in seen) / sum(seen) * p(g[1:])

    return p


def good_and_junk():
    r = random.Random(9)
    syllables = "ba ke lo mi ra te so nu".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    good = [(i, " ".join(word() for _ in range(80)) + ".") for i in range(200)]
    junk = [(1000 + i, " ".join(word().upper() + "!!%#" for _ in range(80))) for i in range(20)]
    return good, junk + [(2000, "слово и ещё слово " * 20), (2001, "文字と文字 " * 30), (2002, "é😀 " + good[3][1])]


def test_perplexity_is_that_of_the_model(spark, odd, none):
    import math

    from lociflow.llm.common import Scratch

    good, junk = good_and_junk()
    docs = table(spark, good + junk + [(None, good[0][1]), (3000, None), (3001, "")])
    trusted = spark.createDataFrame([(i,) for i in range(150)] + [(None,)], "doc_id long")
    got = perplexity.classify(spark, docs, trusted, carry=("doc_id", "text", "size", "label")).collect()
    assert len(got) == len(good) + len(junk) + 3 and {(r["size"], r["label"]) for r in got} == {(-1, 1)}
    taught = {r[0] for r in trusted.where("doc_id is not null").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("j")).where("j <> 0").collect()}
    p = brute_kneser_ney([t for i, t in good if i in taught])
    assert abs(sum(p("ba ba"[:4] + c) for c in {c for _, t in good for c in t} | {"\n", "?"}) - 1) < 0.01
    by = {(r["doc_id"], r["text"]): r for r in got}
    for i, t in [*good[:20], *good[190:], *junk, (None, good[0][1])]:
        padded = "\n" * 4 + t
        nats = -sum(math.log(p(padded[j : j + 5])) for j in range(len(t)))
        assert abs(math.log(by[i, t]["perplexity"]) - nats / len(t)) < 1e-9
    keep = {r["doc_id"]: r["keep"] for r in got}
    assert sum(keep[i] for i, _ in good) >= 195 and not any(keep[i] for i, _ in junk if i < 2002) and not keep[3000] and not keep[3001] and keep[None]
    assert perplexity.classify(spark, odd, trusted.limit(0)).where("keep").count() == sum(bool(t) for _, t in odd_texts())
    assert perplexity.classify(spark, none, trusted).count() == 0


def test_perplexity_does_not_depend_on_blocks(spark, monkeypatch):
    good, junk = good_and_junk()
    docs, trusted = table(spark, good + junk), spark.createDataFrame([(i,) for i in range(150)], "doc_id long")
    whole = {r["doc_id"]: r["perplexity"] for r in perplexity.classify(spark, docs, trusted).collect()}
    texts = dict(good + junk)
    counter = perplexity._Counter()
    monkeypatch.setattr(perplexity, "CHUNK", 500)
    small = perplexity._Counter()
    for t in texts.values():
        counter.add(t)
        small.add(t)
    counter.merge()
    small.merge()
    want = Counter(("\n" * 4 + t)[i : i + 5] for t in texts.values() for i in range(len(t)))
    for c in (counter, small):
        assert dict(zip(c.grams(0, len(c.key)).to_pylist(), c.n.tolist(), strict=True)) == want
    again = {r["doc_id"]: r["perplexity"] for r in perplexity.classify(spark, docs.repartition(13, "text"), trusted).collect()}
    assert all(abs(whole[i] - again[i]) < 1e-9 for i in whole)


def test_no_query_of_the_model_joins_many_tables(spark, monkeypatch):
    good, junk = good_and_junk()
    joins, write = [], perplexity.Scratch.write

    def counted(self, df, *a, **b):
        joins.append(df._jdf.queryExecution().analyzed().toString().count("Join "))
        return write(self, df, *a, **b)

    monkeypatch.setattr(perplexity.Scratch, "write", counted)
    perplexity.classify(spark, table(spark, good[:20] + junk), spark.createDataFrame([(i,) for i in range(20)], "doc_id long"))
    assert max(joins) <= 2


def test_order_by_shard_is_that_of_the_characters():
    import numpy as np

    r = np.random.default_rng(12)
    for high in (50, 0x10FFFF):
        window = np.unique(r.integers(0, high, (3000, perplexity.ORDER)).astype(np.uint32), axis=0)
        shard = r.integers(0, 40, len(window))
        order = perplexity._by_shard(shard, window, 40)
        assert order.tolist() == np.lexsort((*window.T[::-1], shard)).tolist()


def test_sums_of_looked_up_grams_are_those_of_each_text(monkeypatch):
    import numpy as np

    monkeypatch.setattr(perplexity, "CHUNK", 300)
    r = random.Random(13)
    texts = ["".join(r.choice("abcé") for _ in range(n)) for n in (0, 1, 4, 50, 299, 700, 20)] + [None]
    counter = perplexity._Counter()
    for t in texts:
        counter.add(t or "")
    counter.merge()
    log = np.arange(len(counter.key), dtype=np.int64) << 40
    by = dict(zip(counter.key.tolist(), log.tolist(), strict=True))
    assert perplexity._nats(texts, counter.key, log) == [sum(by[k] for k in perplexity._keys(perplexity._points(t)).tolist()) / perplexity.FINE if t else 0.0 for t in texts]
    assert sum(counter.n) == sum(len(t or "") for t in texts)


def test_codec_forgets_and_finds_the_same_again():
    with open(tokenizer_path(), "rb") as f:
        codec = sentencepieces.Codec(f.read(), 1)
    texts = ["", " ", "a  b", " a", "a ", "▁x y", "nul\0 in \0 it", "é€😀 x", "two\nlines here"]
    first = codec.verified(texts)
    assert first[0] == [codec.original.encode(t) for t in texts] and codec.words
    codec.forget()
    assert not codec.words and codec.held == 0 and codec.verified(texts) == first
