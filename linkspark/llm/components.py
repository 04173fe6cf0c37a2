"""Connected components by alternating stars, as joins and grouped minima."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.common import drop, save


def components(links: DataFrame, rounds: int = 60, few: int = 100_000) -> DataFrame:
    """(id, component) for every end of links (a, b: longs): the smallest id that links reach.

    Each round hangs every larger neighbour of a node on the node's smallest neighbour (large star), then every smaller
    one (small star), until nothing changes. Minima are made on the map side and written before they are joined back: both
    sides of the join are then plain shuffles, so Spark splits a hub that has a third of all links. Each round is a table
    in the shared folder. Null
    ends are left out; loops and repeated links change nothing; no links give no rows. The number of rounds grows with
    the logarithm of the longest path; more than `rounds` is an error. At most `few` links (2 MB) are solved by one task
    instead, with the same rows; their number is checked first.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = save(edges)
    if edges.limit(few + 1).count() <= few:
        return edges.coalesce(1).mapInArrow(_solve, "id long, component long")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, first = save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, wide = save(large)
        least, second = save(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        grown, new = save(small.where("a <> b").distinct())
        after = grown.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("a")).first()
        for old in (path, first, wide, second):
            drop(spark, old)
        edges, path = grown, new
        if after == before and after[0] == after[2]:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


def _solve(batches):
    """Components of a bounded table of links in one task."""
    a, b = [], []
    for batch in batches:
        a.append(batch["a"].to_numpy())
        b.append(batch["b"].to_numpy())
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(len(ids), place[: len(a)], place[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["id", "component"])


def local_roots(n: int, a, b):
    """Smallest index that links (index arrays a, b) reach, for each of n nodes, in one task's arrays."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root
