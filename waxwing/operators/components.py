"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from waxwing.operators.staging import staged


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the edges of each batch by (node, smallest node of its component within the batch)."""
    for frame in frames:
        nodes, at = np.unique(frame[["u", "v"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)
        root = np.arange(len(nodes))
        while len(at):
            low, high = np.minimum(root[at[:, 0]], root[at[:, 1]]), np.maximum(root[at[:, 0]], root[at[:, 1]])
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root != root[root]).any():
                root = root[root]
        keep = root != np.arange(len(nodes))
        yield pd.DataFrame({"u": nodes[root[keep]], "v": nodes[keep]})


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v")


def _small(edges: DataFrame) -> DataFrame:
    """For each node (v, the larger end), hang it and its smaller neighbours on the least of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").filter("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(least.select(F.col("m").alias("u"), "v"))


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long) but the roots; a root is its component's smallest node.

    Nulls and loops are ignored, repeated edges count once. Each round is written below ``path``; the number of rounds
    grows with the logarithm of the longest chain. A node with very many edges is summed on the map side first.
    """
    now = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()
    now = staged(now.mapInPandas(_forest, "u long, v long"), f"{path}/edges0")
    mark, turn = _mark(now), 0
    while True:
        turn += 1
        now = staged(_small(_large(now).distinct()).distinct(), f"{path}/edges{turn}")
        seen = _mark(now)
        if seen == mark:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        mark = seen


def _mark(edges: DataFrame) -> Row:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
