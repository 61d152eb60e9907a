"""Readers and writers: FASTA, masks, metadata, edge lists, and tables with insert-only, last-write and versioned keys."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(defline, seq)`` of every record, plain or compressed; sequence lines are joined and upper-cased."""
    text = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    return text.select(F.trim(head).alias("defline"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"[\r\n]", "")).alias("seq"))


def read_single_fasta(spark: SparkSession, path: str) -> tuple[str, str]:
    """Name and sequence of a file with one record."""
    rows = read_fasta(spark, path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("the file must have one record")
    return rows[0]["defline"], rows[0]["seq"]


def load_multifasta(spark: SparkSession, path: str, length: int, known: DataFrame | None = None) -> DataFrame:
    """``(sample_id, seq)`` of new samples: the second part of a name with slashes, : as -, ? and blanks as N, sequences of the reference's length only."""
    name = F.when(F.col("defline").contains("/"), F.split("defline", "/")[1]).otherwise(F.split("defline", " ")[0])
    rows = read_fasta(spark, path).select(F.regexp_replace(name, ":", "-").alias("sample_id"), F.translate("seq", "? ", "NN").alias("seq")).where(F.length("seq") == length).dropDuplicates(["sample_id"])
    return rows if known is None else rows.join(known.select("sample_id"), "sample_id", "left_anti")


def clean_defline(defline: str) -> F.Column:
    """A name with all but letters, digits and ._- replaced by underscores."""
    return F.regexp_replace(F.col(defline), r"[^A-Za-z0-9._\-]+", "_")


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """``(pos)``: zero-based positions, one per line."""
    return spark.read.schema("pos int").csv(path).where("pos is not null").distinct()


def mask_from_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Zero-based positions of the records of a VCF file."""
    return spark.read.option("sep", "\t").option("comment", "#").csv(path).select((F.col("_c1").cast("int") - 1).alias("pos")).where("pos is not null").distinct()


def read_metadata(spark: SparkSession, path: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Clinical rows and sequence features from surveillance metadata: ``names`` must hold sequence_name, country, adm1, sample_date and lineage.

    The id is the second part of the name; dates that aren't ISO dates become null; repeated samples are taken once.
    """
    rows = spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    rows = rows.withColumn("sample_id", F.split("sequence_name", "/")[1]).withColumn("sample_date", F.expr("try_cast(sample_date as date)")).dropDuplicates(["sample_id"])
    clinical = rows.select("sample_id", "sample_date", "country", "adm1")
    features = rows.where("lineage is not null and lineage <> ''").select("sample_id", F.lit("pangolin_lineage").alias("variable"), F.col("lineage").alias("value"), F.concat(F.lit("pangolin_lineage:"), "lineage").alias("feature"), F.lit(True).alias("is_lineage"))
    return clinical, features


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, label)`` from a two-column file; labels have at most five characters and rows with nulls go."""
    return spark.read.schema("sample_id string, label string").option("header", True).csv(path).dropna().select("sample_id", F.substring("label", 1, 5).alias("label"))


def write_fasta(records: DataFrame, path: str, name: str = "sample_id", seq: str = "seq") -> None:
    records.select(F.concat(F.lit(">"), name, F.lit("\n"), seq)).write.mode("overwrite").text(path)


def write_edges(edges: DataFrame, path: str, form: str = "csv") -> None:
    """The edge list, once per pair, as csv, json or parquet."""
    getattr(edges.where("a < b").select("a", "b", "dist").write.mode("overwrite"), form)(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class Store:
    """Parquet tables under one folder, partition files added by each write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str, schema: str) -> DataFrame:
        """The table, empty if nothing was written."""
        if not _exists(self.spark, self.path(table)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table))

    def insert(self, table: str, rows: DataFrame, key: str, strict: bool = False) -> int:
        """Add rows whose key isn't there; a strict insert refuses known keys altogether. Returns the number added."""
        schema = rows.schema
        if _exists(self.spark, self.path(table)):
            old = self.spark.read.schema(schema).parquet(self.path(table)).select(key)
            fresh = rows.dropDuplicates([key]).join(old, key, "left_anti").select(*rows.columns)
        else:
            fresh = rows.dropDuplicates([key])
        n = fresh.count()
        if strict and n < rows.count():
            raise FileExistsError("some keys are stored already")
        fresh.write.mode("append").parquet(self.path(table))
        return n

    def put(self, table: str, key: str, content: str | None) -> None:
        """A key's new content; the last write counts, and nothing deletes the key."""
        version = self.read(table, KV).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
        self.spark.createDataFrame([(key, version, content)], KV).write.mode("append").parquet(self.path(table))

    def get(self, table: str, key: str) -> str | None:
        row = self.read(table, KV).where(F.col("key") == key).agg(F.max_by("content", "version")).first()
        return row[0]

    def get_if_newer(self, table: str, key: str, version: int) -> tuple[int, str] | None:
        """The newest version and content, or nothing if the reader has it."""
        row = self.read(table, KV).where((F.col("key") == key) & (F.col("version") > version)).agg(F.max("version"), F.max_by("content", "version")).first()
        return None if row[0] is None else (row[0], row[1])

    def put_new(self, table: str, key: str, content: str) -> bool:
        """Content for a key that has none; returns whether it was stored."""
        fresh = self.get(table, key) is None
        if fresh:
            self.put(table, key, content)
        return fresh

    def delete(self, table: str, key: str) -> None:
        self.put(table, key, None)

    def keys(self, table: str) -> list[str]:
        """The keys that have content, in order."""
        return [r["key"] for r in self.keep_latest(table).orderBy("key").collect()]

    def delete_unless(self, table: str, whitelist: list[str]) -> int:
        """Delete all keys but those of the whitelist; returns how many went."""
        gone = [k for k in self.keys(table) if k not in set(whitelist)]
        for k in gone:
            self.delete(table, k)
        return len(gone)

    def keep_latest(self, table: str, whitelist: list[str] | None = None) -> DataFrame:
        """What a purge leaves: the newest version of each key that isn't deleted, of the whitelist if one is given."""
        rows = self.read(table, KV)
        rows = rows if whitelist is None else rows.where(F.col("key").isin(whitelist))
        return rows.groupBy("key").agg(F.max("version").alias("version"), F.max_by("content", "version").alias("content")).where("content is not null")


KV = "key string, version long, content string"


def config_text(config: dict) -> str:
    return json.dumps(config, sort_keys=True)
