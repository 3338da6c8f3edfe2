"""Connected components of a graph given as edges, by alternating star contraction on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed


def connected(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b long, either direction, repeats allowed) to (node, component = smallest node).

    Every round hangs each node's larger neighbours below its smallest one, then its smaller
    neighbours, until the edges are stars; the number of rounds grows with the logarithm of the
    longest chain. Only counts and a checksum reach the driver. Nodes without an edge do not appear;
    no edge gives no row.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    pairs = checkpointed(pairs.distinct())
    seen = _state(pairs)
    while seen[0]:
        pairs = checkpointed(_small_star(_large_star(pairs)))
        now = _state(pairs)
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _state(pairs: DataFrame) -> tuple[int, int]:
    mark = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))
    row = pairs.agg(F.count("*"), F.coalesce(mark, F.lit(0))).first()
    return int(row[0]), int(row[1])


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of ``a[i]`` and ``b[i]`` in a label array (a label is the set's smallest index)."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped
    return labels
