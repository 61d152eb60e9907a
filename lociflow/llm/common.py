"""What the corpus operators share: written intermediate tables, word rules and vectorised union-find."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of characters that are neither a space nor one of tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"file://{tempfile.gettempdir()}/lociflow-shared"
        spark.conf.set("spark.checkpoint.dir", folder) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return folder.rstrip("/")


#: Setting under which Spark removes the shuffle files of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables written as Parquet in the shared folder.

    A written table cuts the lineage and survives the loss of executors. ``drop`` removes tables that no later
    step reads; the others stay as long as the returned DataFrame may be evaluated.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{shared_folder(spark)}/lociflow/{name}-{uuid.uuid4().hex}", 0
        self.paths: set[str] = set()
        self.tables: dict[str, str] = {}

    def write(self, df: DataFrame, bucket: str | None = None, buckets: int = 0) -> DataFrame:
        """Evaluate ``df`` into a new table and return a DataFrame that reads it; the shuffle files behind it go.

        With ``bucket``, the files are dealt by the hash of that column, so that grouping or joining by it moves no row of
        this table. Such a table is registered in the session's catalogue until it is dropped.
        """
        self.made += 1
        path, schema = f"{self.root}/{self.made}", df.schema
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            to = df.write.option("compression", "zstd")
            if bucket:
                name = f"spark_catalog.default.lociflow_{uuid.uuid4().hex}"
                to.format("parquet").bucketBy(buckets, bucket).option("path", path).saveAsTable(name)
                self.tables[path] = name
            else:
                to.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.table(self.tables[path]) if bucket else self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        self.paths.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of tables that this object wrote."""
        for t in tables:
            self._delete(t._scratch_path)

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Delete the files of all tables that this object wrote, but for those that are named."""
        for path in self.paths - {t._scratch_path for t in tables}:
            self._delete(path)

    def _delete(self, name: str) -> None:
        self.paths.discard(name)
        if name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """As many partitions as keep one at ``each`` rows, and at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def hand_back() -> None:
    """Memory that a Python worker has freed goes back to the system; the worker waits for its next task, and would hold it meanwhile."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def released(f: Callable) -> Callable:
    """``f`` over the batches of a task, which hands its memory back at the end."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        hand_back()

    return each


def null_key(c: str | Column) -> Column:
    """A non-null string in which null and every string stay distinct, for joins that match nulls."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


class Unions:
    """Union-find over 0..n-1 on whole arrays of pairs; roots are the smallest members."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                return r
            r = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            differ = a != b
            a, b = a[differ], b[differ]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.parent, high, low)
            self.parent = self.parent[self.parent]

    def labels(self) -> np.ndarray:
        return self.roots(np.arange(len(self.parent), dtype=np.int64))
