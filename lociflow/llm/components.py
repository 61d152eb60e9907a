"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``, root being the smallest node of its component.

    Each round links every node's larger neighbours to its smallest neighbour and then its smaller neighbours to the
    smallest of them. Both are a minimum per node, pre-aggregated before the shuffle, and a join on the node that
    adaptive execution splits where a node has many edges. Rounds are written to the shared folder; they end when
    the edge set no longer changes, after a number of rounds that is logarithmic in practice. Loops and repeated edges are allowed;
    an empty table gives an empty table; edges with a null end are ignored.
    """
    e = scratch.write(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _signature(e)
    while before[0]:
        both = e.union(e.select("v", "u"))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.write(small)
        scratch.drop(e)
        e, after = new, _signature(new)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(v, u) >> 20"))).first())
