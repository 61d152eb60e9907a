"""Reference compression of sequences and the scalar functions around it."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"
#: IUPAC letters for more than one base, with the bases that they stand for. Fixed values.
IUPAC = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG"}
#: Alphabet of the two letters of a cluster label, without I and O. Fixed values.
LABEL_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"


def check_reference(reference: str) -> str:
    """The reference, which may hold A, C, G and T only."""
    if not reference or set(reference) - set(BASES):
        raise TypeError("the reference must consist of A, C, G and T")
    return reference


def count_letters(seq: str | Column, letters: str) -> Column:
    """How many characters of a string are among ``letters``."""
    c = F.col(seq) if isinstance(seq, str) else seq
    return (F.length(c) - F.length(F.translate(c, letters, ""))).cast("int")


def masked(reference: str, mask: tuple[int, ...] = (), by: str = ".") -> str:
    """The reference with another character at masked positions: one string, however many these are."""
    hidden = set(mask)
    return "".join(by if i in hidden else c for i, c in enumerate(check_reference(reference))) if hidden else check_reference(reference)


#: Characters that are compared at once, and of those that differ, masked ones left out.
BLOCK, PIECE = 128, 16


def _pieces(reference: str, mask: tuple[int, ...]) -> Column:
    """The reference in blocks ``(at, n, r, pieces)``, and what of each lies outside the mask in pieces ``(at, n, r)``: a literal."""
    hidden = set(mask)
    one = lambda at, end: [F.lit(at).alias("at"), F.lit(end - at).alias("n"), F.lit(reference[at:end]).alias("r")]
    blocks = []
    for first in range(0, len(reference), BLOCK):
        runs, at, last = [], first, min(first + BLOCK, len(reference))
        while at < last:
            end = at
            while end < last and end - at < PIECE and end not in hidden:
                end += 1
            if end > at:
                runs.append(F.struct(*one(at, end)))
            at = max(end, at + 1)
        none = F.array().cast("array<struct<at:int,n:int,r:string>>")
        blocks.append(F.struct(*one(first, last), (F.array(*runs) if runs else none).alias("pieces")))
    return F.array(*blocks)


def _differences(seq: Column, reference: str, mask: tuple[int, ...]) -> Column:
    """Array of ``(base, ref, pos)`` where a sequence differs from the reference outside the mask.

    Blocks of the sequence are cut as bytes, none with a look at those before it, and compared with those of the reference, which the plan holds as literals; only blocks that differ, in masked positions or case too, are looked at in
    pieces between masked positions, and of these only those that differ character by character. A character of several bytes counts as one: it becomes a byte of its own for the comparison, and is looked up in the text.
    """
    blocks = _pieces(check_reference(reference), mask)
    plain = lambda c: F.translate(F.upper(c), "-", "N")
    text = F.when(F.octet_length(seq) == F.length(seq), seq).otherwise(plain(seq))
    one_byte = F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(text, "[^\\x00-\\x7F]", "?"))
    cut = lambda t, c: F.substring(t["bytes"], c["at"] + 1, c["n"]).cast("string")
    cell = lambda t, c: lambda b, j: F.struct(F.when(b == "?", F.substring(t["text"], c["at"] + j + 1, F.lit(1))).otherwise(b).alias("base"), F.substring(c["r"], j + 1, F.lit(1)).alias("ref"), (c["at"] + j).alias("pos"))

    def found(t):
        unlike = F.flatten(F.transform(F.filter(blocks, lambda c: cut(t, c) != c["r"]), lambda c: F.filter(c["pieces"], lambda p: plain(cut(t, p)) != p["r"])))
        return F.flatten(F.transform(unlike, lambda c: F.filter(F.transform(F.split(plain(cut(t, c)), ""), cell(t, c)), lambda x: (x["base"] != x["ref"]) & (x["base"] != ""))))

    # an array of one element binds the text, which would be made again for every piece otherwise
    return F.flatten(F.transform(F.array(F.struct(text.alias("text"), one_byte.cast("binary").alias("bytes"))), found))


def count_unknown(seq: str, reference: str, mask: tuple[int, ...] = ()) -> Column:
    """Positions outside the mask that hold no called base."""
    return F.size(F.filter(_differences(F.col(seq), reference, mask), lambda c: ~c["base"].isin(*BASES)))


def composition(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Composition and validity: digest, counts, length, called and mixed bases and their share; null where the string isn't nucleic acid."""
    s = F.upper(F.col(seq))
    ok = s.rlike(r"^[ACGTN\-RYSWKMBDHVU]+$")
    counts = {f"n_{x if x != '-' else 'gap'}": count_letters(s, x) for x in "ACGTN-"}
    mixed = count_letters(s, "".join(IUPAC))
    out = df.withColumns({"is_valid": ok, "seq_md5": F.md5(s), "seq_length": F.length(s), **counts, "n_called": count_letters(s, BASES), "n_mixed": mixed})
    return out.withColumn("prop_actg", F.when(ok, F.round(F.col("n_called") / F.col("seq_length"), 9)))


def positions(df: DataFrame, reference: str, mask: tuple[int, ...] = (), seq: str = "seq") -> DataFrame:
    """``(sample_id, pos, base, ref)`` for the positions outside the mask that differ from the reference; gaps count as N.

    The comparison runs inside the row, so that only differences are exploded.
    """
    rows = df.where(F.length(seq) == len(reference)).select("sample_id", F.explode(_differences(F.col(seq), reference, mask)).alias("c"))
    return rows.select("sample_id", "c.pos", "c.base", "c.ref")


def differences(df: DataFrame, reference: str, mask: tuple[int, ...] = (), max_unknown: int | None = None) -> DataFrame:
    """``df`` with ``cells``, the array of ``(pos, base)`` at which a row's ``seq`` differs from the reference, empty where its length does, and ``invalid``: all that ``parts`` needs, found once a row."""
    rows = df.withColumn("__all", _differences(F.col("seq"), reference, mask))
    own = F.transform("__all", lambda c: F.struct(c["pos"].alias("pos"), c["base"].alias("base")))
    own = F.when(F.length("seq") == len(reference), own).otherwise(F.array().cast("array<struct<pos:int,base:string>>"))
    unknown = F.size(F.filter("__all", lambda c: ~c["base"].isin(*BASES)))
    return rows.withColumns({"cells": own, "invalid": F.lit(0) if max_unknown is None else (unknown > max_unknown).cast("int")}).drop("__all")


def parts(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of ``compress`` from the rows of ``differences``."""
    called = lambda c: c["base"].isin(*BASES)
    cells = found.where("invalid = 0")
    variants = cells.select("sample_id", F.explode(F.filter("cells", called)).alias("c")).select("sample_id", "c.pos", "c.base")
    unknowns = cells.select("sample_id", F.explode(F.filter("cells", lambda c: ~called(c))).alias("c"))
    return found.select("sample_id", "invalid"), variants, unknowns.select("sample_id", "c.pos", F.when(F.col("c.base") == "N", "N").otherwise("M").alias("kind"), F.col("c.base").alias("code"))


def compress(df: DataFrame, reference: str, mask: tuple[int, ...] = (), max_unknown: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``samples(sample_id, invalid)``, ``variants(sample_id, pos, base)`` and ``unknowns(sample_id, pos, kind, code)``.

    Samples with more than ``max_unknown`` unknown positions outside the mask are invalid and have no rows in the other two.
    """
    return parts(differences(df.select("sample_id", "seq"), reference, mask, max_unknown))


def uncompress(samples: DataFrame, variants: DataFrame, unknowns: DataFrame, reference: str, mask: tuple[int, ...] = ()) -> DataFrame:
    """``(sample_id, seq)`` of valid samples: the reference with their differences; masked positions become N."""
    own = variants.select("sample_id", "pos", "base").union(unknowns.select("sample_id", "pos", F.col("code")))
    changes = own.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "base"))).alias("changes"))
    start = F.split(F.lit(masked(reference, mask, "N")), "")
    fill = F.transform(start, lambda c, i: F.coalesce(F.try_element_at("changes", i), c))
    rows = samples.where("invalid = 0").select("sample_id").join(changes, "sample_id", "left")
    rows = rows.withColumn("changes", F.coalesce("changes", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))))
    return rows.select("sample_id", F.array_join(fill, "").alias("seq"))


def mask_digest(mask: tuple[int, ...]) -> str:
    """Name of a mask: its size and the digest of its sorted positions as JSON."""
    return f"Excl {len(set(mask))} nt [{hashlib.md5(json.dumps(sorted(set(mask))).encode()).hexdigest()}]"


def content_hash(variants: DataFrame, unknowns: DataFrame) -> DataFrame:
    """``(sample_id, content_md5)``: one digest for samples with the same differences."""
    cells = variants.select("sample_id", F.format_string("%s:%06d", "base", "pos").alias("x")).union(unknowns.select("sample_id", F.format_string("%s:%06d", "code", "pos")))
    return cells.groupBy("sample_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list("x")), ",")).alias("content_md5"))


def set_identifier(ids: Column, kind: str, what: str, outgroup: str = "no_og") -> Column:
    """``kind|what|outgroup|sha1`` of a set of ids, whatever their order."""
    return F.concat_ws("|", F.lit(kind), F.lit(what), F.lit(outgroup), F.sha1(F.array_join(F.array_sort(F.array_distinct(ids)), ";")))


def variant_id(base: Column, pos: Column, length: int) -> Column:
    """Integer of a variant: the position offset by A 0, C 1, T 2, G 3 genome lengths."""
    return (F.when(base == "A", 0).when(base == "C", 1).when(base == "T", 2).when(base == "G", 3) * length + pos).cast("int")


def variant_of(number: Column, length: int) -> tuple[Column, Column]:
    """Base and position of a variant's integer."""
    block = F.floor(number / length).cast("int")
    return F.element_at(F.array(*map(F.lit, "ACTG")), block + 1), F.pmod(number, F.lit(length)).cast("int")


#: Labels after which they begin again.
N_LABELS = len(LABEL_LETTERS) ** 2 * 1000


def label_encode(n: Column) -> Column:
    """Cluster label of an integer: two letters and three digits, AA000 upwards; after ``N_LABELS`` they begin again."""
    k = len(LABEL_LETTERS)
    letter = lambda x: F.substring(F.lit(LABEL_LETTERS), (x + 1).cast("int"), F.lit(1))
    return F.concat(letter(F.floor(n / (1000 * k)) % k), letter(F.floor(n / 1000) % k), F.lpad((n % 1000).cast("string"), 3, "0"))


def label_round(n: Column) -> Column:
    """How often the labels began again before an integer's: what ``label_decode`` needs besides the label from ``N_LABELS`` on."""
    return F.floor(n / N_LABELS)


def label_decode(label: Column, again: Column | None = None) -> Column:
    """Integer of a cluster label, in the round ``again`` of labels, the first by default; a version suffix is ignored, other strings give null."""
    k = len(LABEL_LETTERS)
    place = lambda i: F.instr(F.lit(LABEL_LETTERS), F.substring(label, i, 1)) - 1
    n = (place(1) * k + place(2)) * 1000 + F.substring(label, 3, 3).cast("int")
    return F.when(label.rlike("^[A-HJ-NP-Z]{2}[0-9]{3}(v[0-9]+)?$"), n if again is None else n + again * N_LABELS)


def to_json(samples: DataFrame, variants: DataFrame, unknowns: DataFrame) -> DataFrame:
    """``(sample_id, rcs)``: the compressed sequence as JSON; sets become sorted lists."""
    per = [F.array_sort(F.collect_set(F.when(F.col("base") == b, F.col("pos")))).alias(b) for b in BASES]
    v = variants.groupBy("sample_id").agg(*per)
    u = unknowns.groupBy("sample_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "N", F.col("pos")))).alias("N"),
        F.array_sort(F.collect_set("pos")).alias("U"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == "M", F.struct(F.col("pos").cast("string"), "code"))))).alias("M"),
    )
    rows = samples.select("sample_id", "invalid").join(v, "sample_id", "left").join(u, "sample_id", "left")
    none = F.array().cast("array<int>")
    body = F.struct(*[F.when(F.col("invalid") == 0, F.coalesce(c, none)).alias(c) for c in "ACGTNU"], "M", "invalid")
    return rows.select("sample_id", F.to_json(body).alias("rcs"))


RCS = "A array<int>, C array<int>, G array<int>, T array<int>, N array<int>, U array<int>, M map<string,string>, invalid int"


def from_json(rows: DataFrame) -> DataFrame:
    """The parsed compressed sequences."""
    return rows.select("sample_id", F.from_json("rcs", RCS).alias("rcs")).select("sample_id", "rcs.*")


def set_stats(a: str, b: str) -> tuple[Column, Column, Column]:
    """Sizes of two sets and of their union."""
    return F.size(F.array_distinct(a)).cast("long"), F.size(F.array_distinct(b)).cast("long"), F.size(F.array_union(a, b)).cast("long")


def sparse_vectors(variants: DataFrame, unknowns: DataFrame, length: int) -> DataFrame:
    """``(sample_id, alleles, missing)``: sorted integers of a sample's variants, and its unknown positions."""
    v = variants.groupBy("sample_id").agg(F.array_sort(F.collect_set(variant_id(F.col("base"), F.col("pos"), length))).alias("alleles"))
    u = unknowns.groupBy("sample_id").agg(F.array_sort(F.collect_set("pos")).alias("missing"))
    return v.join(u, "sample_id", "full_outer").select("sample_id", *[F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in ("alleles", "missing")])


def position_vector(alleles: DataFrame, length: int) -> DataFrame:
    """``(pos, n)``: counts of ``alleles(variant_id, n)`` added up over the four bases of each position."""
    return alleles.groupBy(F.pmod("variant_id", F.lit(length)).cast("int").alias("pos")).agg(F.sum("n").alias("n"))


def link_weight(dist: Column) -> Column:
    """Weight of a link in a network: 1 / (1 + distance)."""
    return 1 / (1 + dist)


def iupac_bases(code: Column) -> Column:
    """The bases that a letter stands for, in order; null for what is none."""
    table = F.create_map(*[F.lit(x) for k, v in ({b: b for b in BASES} | IUPAC).items() for x in (k, v)])
    return F.try_element_at(table, code)


def column_name(pos: Column, base: Column) -> Column:
    """Name of an allele's column: ``pos:base``."""
    return F.concat_ws(":", pos.cast("string"), base)
