"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a group-by and a join on links; each round is written to the shared folder, so nothing but two numbers
per round comes to the driver and a lost executor costs one round at most. Links of a bounded number are joined in one
task instead: a round has seven shuffles, whose tasks and small files cost far more than so few links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricebridge.llm.common import cut, drop_cut, tidied

#: Different links that one task joins at most, 16 bytes each; more go through the rounds.
FEW = 1 << 20


def _print_of(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (u, v), ascending, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, x, y = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while len(x):
        # every root with a smaller neighbour joins it, so at least half of a component's roots go
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def _at_once(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = (np.concatenate(c) for c in zip(*([c.to_numpy() for c in batch.columns] for batch in it), strict=True))
    nodes, labels = least_of(u, v)
    for i in range(0, len(nodes), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 65536]), pa.array(labels[i : i + 65536])], names=["node", "label"])


def connected_components(links: DataFrame, most_rounds: int = 60, few: int = FEW) -> DataFrame:
    """node, label for every node of links (columns a, b: longs): the smallest node reachable. Loops and repeats don't matter."""
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = cut(e, "links")
    before = _print_of(e)
    if 0 < before[0] <= few:
        return e.coalesce(1).mapInArrow(tidied(_at_once), "node long, label long")
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small, "links")
        after = _print_of(new)
        drop_cut(e)
        e = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not found in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
