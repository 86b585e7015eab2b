"""Connected components of a graph that is itself a DataFrame, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each of nodes 0 to n-1's component, over the edges a[i], b[i]."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while (further := label[label]) is not label and (further != label).any():
            label = further


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star; edges are (u, v) with u > v, distinct."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node with an edge (u, v): root is the least node of its component.

    Nothing but two numbers for each round comes to the driver. Rounds grow with the logarithm of the
    longest path; each is cut by a checkpoint. Self-loops and repeated edges are allowed.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state, seen = common.cut(edges.distinct()), None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen, state = tuple(mark), common.cut(_stars(state))
    nodes = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
