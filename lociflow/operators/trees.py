"""Trees as ``(node, parent, dist)`` tables: parsing, short branches, rooting, collapsing, writing."""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.scratch import Scratch

SCHEMA = "node string, parent string, dist double"


def parse_newick(text: str) -> list[tuple[str, str | None, float]]:
    """Rows of one tree; inner nodes without a name get one, the root has no parent."""
    rows, stack, last, unnamed = [], [[]], None, 0
    # a finished node is [name, dist, children]
    for token in re.findall(r"[(),;]|[^(),;]+", text.strip()):
        if token == "(":
            stack.append([])
            last = None
        elif token in ",);":
            if token == ")":
                children = stack.pop()
                last = [None, 0.0, children]
                stack[-1].append(last)
            elif token == ",":
                last = None
        else:
            label, _, length = token.strip().partition(":")
            if last is None:
                last = [label or None, 0.0, []]
                stack[-1].append(last)
            else:
                last[0] = label or last[0]
            last[1] = float(length) if length else 0.0
    todo = [(stack[0][0], None)]
    while todo:
        (name, dist, children), parent = (node := todo.pop())[0], node[1]
        if name is None:
            name, unnamed = f"node{unnamed}", unnamed + 1
        rows.append((name, parent, dist))
        todo += [(c, name) for c in children]
    return rows


def read_newick(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_newick(text), SCHEMA)


def zero_short(tree: DataFrame, genome_length: int) -> DataFrame:
    """Branches of less than half a substitution have length 0."""
    return tree.withColumn("dist", F.when(F.col("dist") < 0.5 / genome_length, 0.0).otherwise(F.col("dist")))


def collapse(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree without zero-length branches, and ``(node, kept)`` of every original node.

    Each node moves to its nearest ancestor or self with a branch, or to the root; ancestors are halved in every round.
    """
    scratch = Scratch(tree.sparkSession, "tree")
    own = F.col("parent").isNull() | (F.col("dist") > 0)
    at = scratch.write(tree.select("node", F.when(own, F.col("node")).otherwise(F.col("parent")).alias("kept")))
    while True:
        jump = at.select(F.col("node").alias("kept"), F.col("kept").alias("next"))
        new = scratch.write(at.join(jump, "kept").select("node", F.col("next").alias("kept")))
        moved = new.exceptAll(at).limit(1).count()
        at = new
        if not moved:
            break
    parents = at.select(F.col("node").alias("parent"), F.col("kept").alias("kept_parent"))
    heads = tree.join(at.where("node = kept").select("node"), "node", "left_semi").join(parents, "parent", "left")
    return heads.select("node", F.col("kept_parent").alias("parent"), "dist"), at


def reroot(tree: DataFrame, outgroup: str) -> DataFrame:
    """The tree with its root halfway along the branch to a leaf; one task holds the tree, as a tree is written as one string anyway."""

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        near = defaultdict(list)
        for r in pdf.itertuples(index=False):
            if isinstance(r.parent, str):
                near[r.node].append((r.parent, r.dist))
                near[r.parent].append((r.node, r.dist))
        rows = [("rooted", None, 0.0)]
        neighbour, dist = near[outgroup][0]
        rows.append((outgroup, "rooted", dist / 2))
        todo, seen = [(neighbour, "rooted", dist / 2)], {outgroup}
        while todo:
            node, parent, length = todo.pop()
            seen.add(node)
            rows.append((node, parent, length))
            todo += [(n, node, d) for n, d in near[node] if n not in seen]
        return pd.DataFrame(rows, columns=["node", "parent", "dist"])

    return tree.withColumn("tree", F.lit(1)).groupBy("tree").applyInPandas(turn, SCHEMA)


def without_leaf(tree: DataFrame, leaf: str) -> DataFrame:
    """The tree without one leaf, for instance the outgroup."""
    return tree.where(F.col("node") != leaf)


def root_tip_distances(tree: DataFrame) -> DataFrame:
    """``(node, distance)`` from the root to every leaf, by joins of ever longer ancestor steps."""
    scratch = Scratch(tree.sparkSession, "tree")
    at = scratch.write(tree.select("node", F.col("parent").alias("above"), F.col("dist").alias("distance")))
    while at.where("above is not null").limit(1).count():
        step = at.select(F.col("node").alias("above"), F.col("above").alias("next"), F.col("distance").alias("more"))
        at = scratch.write(at.join(step, "above", "left").select("node", F.col("next").alias("above"), (F.col("distance") + F.coalesce("more", F.lit(0.0))).alias("distance")))
    leaves = tree.join(tree.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")
    return at.join(leaves.select("node"), "node", "left_semi").select("node", F.round("distance", 9).alias("distance"))


def write_newick(tree: DataFrame) -> str:
    """One string of the whole tree, children by name."""
    below, dist, root = defaultdict(list), {}, None
    for r in tree.collect():
        dist[r["node"]] = r["dist"]
        if r["parent"] is None:
            root = r["node"]
        else:
            below[r["parent"]].append(r["node"])
    text: dict[str, str] = {}
    todo = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo += [(c, False) for c in below[node]]
            continue
        inner = ",".join(f"{text.pop(c)}:{dist[c]:g}" for c in sorted(below[node]))
        text[node] = f"({inner}){node}" if inner else node
    return text[root] + ";"


def labelled_tips(tree: DataFrame, clusters: DataFrame) -> DataFrame:
    """Nodes with the label of their sample's cluster after their name."""
    return tree.join(clusters.select(F.col("sample_id").alias("node"), "cluster_id"), "node", "left").withColumn("label", F.concat_ws("|", "node", F.col("cluster_id").cast("string")))
