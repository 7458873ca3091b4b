"""Connected components by alternating large and small stars; edges stay distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_ROUNDS = 60


def _stars(edges: DataFrame) -> DataFrame:
    """One large star, then one small star. Only counted minima meet the edges of a node, never its edge list."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): every linked node with the smallest node it reaches.

    Nodes are longs. Self-links and repeats are ignored; nodes without a link
    do not occur in the result. Rounds are written to the shared folder, and
    end when a round changes no link (about the logarithm of the longest path).
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = common.staged(edges, "links")
    state = None
    for _ in range(MOST_ROUNDS):
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
        if now == state or not now[0]:
            break
        state = now
        following = common.staged(_stars(edges), "links")
        common.unstage(edges)
        edges = following
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def local_stars(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Inside a task: links between positions 0..n-1 -> one link per position to the first of its component."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]
