"""The registered corpus queries: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import ann, licenses, maintext, mixing, perplexity, sentencepieces, simhash, suffixes, toxicity, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_mixing(spark, sf_dir):
    """Copies of every document in a mix of sources weighing 3, 1, 2 and holding 150 % of all words."""
    mixed = mixing.mix(spark, _table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2)
    return mixed.select(F.col("doc_id"), "size", "source_size", "target", "taken", "copies")


@_query
def op2_quality(spark, sf_dir):
    """Perplexity of every whole text under a model of the documents labelled good, and which documents stay."""
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return perplexity.classify(spark, _table(spark, sf_dir, "documents"), trusted)


@_query
def op3_toxicity(spark, sf_dir):
    """Scores of every whole text; every fifth document by the checksum of its id is held out of the fit."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scan = toxicity.fit(spark, docs, _table(spark, sf_dir, "labels").where(~held_out), most_rows=20_000)
    found = toxicity.score(spark, docs, scan)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def tokenizer_path() -> str:
    """The model file that the environment offers; ``LOCIFLOW_SENTENCEPIECE`` names another."""
    path = os.environ.get("LOCIFLOW_SENTENCEPIECE")
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


@_query
def op4_sentencepiece(spark, sf_dir):
    """Ids of every whole text, in number and as a digest, verified against the reference library and by decoding."""
    coded = sentencepieces.encode(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "parity", "round_trip")


@_query
def op5_licenses(spark, sf_dir):
    """Words, base phrases and licence labels of every whole text."""
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("detections")


@_query
def op6_simhash(spark, sf_dir):
    """Fingerprints of three-word shingles and the components of links at three or fewer bits."""
    found = simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"), words_each=3, most_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id").cast("long").alias("component_id"))


@_query
def op7_embedding_dedup(spark, sf_dir):
    """Links and components of all vectors of one label with cosine of 0.93 or more."""
    return vectors.near_duplicates(spark, _table(spark, sf_dir, "embeddings"), least=0.93)


@_query
def op8_ann(spark, sf_dir):
    """The 20 nearest vectors of every twentieth one by inner product."""
    return ann.nearest(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, most=20)


@_query
def op9_suffix_dedup(spark, sf_dir):
    """What stays of every text without the bytes that repeated 200-byte strings cover."""
    cut = suffixes.repeat_digests(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op10_html_extract(spark, sf_dir):
    """The main text of every page."""
    return maintext.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
