"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import mixing, perplexity, sentencepieces, simhash, suffixes
from lociflow.llm.common import Scratch
from lociflow.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under a model of the documents labelled good is usual for their language; the others go.

    Rows with null or repeated ids are judged by their own text; null and empty texts go. An empty table gives no rows.
    """
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return perplexity.classify(spark, docs, trusted, carry=COLUMNS).where("keep").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: five-word shingles, a similarity of 0.8 or more.

    Rows with a null id take part by their text, and stay only where no document of their group has an id.
    """
    return simhash.keep_one(spark, docs, words_each=5, least=0.8).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that stand elsewhere too; documents of which nothing is left go.

    A character of which only some bytes are removed goes as a whole. Every row is judged by its own text, whatever its id.
    """
    cut = suffixes.remove_repeats(spark, docs, length=200)
    text = F.col("kept").cast("string")
    whole = F.regexp_replace(F.make_valid_utf8(text), "\ufffd", "")
    out = cut.withColumn("text", F.when(F.col("n_removed") > 0, whole).otherwise(text)).withColumn("n_chars", F.length("text").cast("long"))
    return out.where((F.col("n_removed") == 0) | (F.trim("text") != "")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Rows are told apart by all of their columns, so that null and repeated ids lose none; equal rows come as often as the mix takes them in all.
    """
    whole = [x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())]  # hashes pass over nulls
    keyed = docs.withColumn("__key", F.concat(F.hex(F.xxhash64(F.lit(1), *whole)), F.lit(" "), F.hex(F.xxhash64(F.lit(2), *whole))))
    copies = mixing.mix(spark, keyed, id_col="__key").groupBy(F.col("doc_id").alias("__key")).agg(F.sum("copies").alias("__copies")).where("__copies > 0")
    once = keyed.dropDuplicates(["__key"]).join(copies, "__key")
    return once.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; null and empty texts have none."""
    return sentencepieces.encode(spark, docs.select("doc_id", "text", "lang", "source"), tokenizer_path()).select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "parity")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("encode", encode)]

#: The stages' models, graphs and sorts are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs)
    return docs
