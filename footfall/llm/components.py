"""Connected components by alternating large-star and small-star rounds, as plain DataFrame joins.

Public method: Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the given index pairs."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before, label.copy())
        label = label[label]
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    while True:
        jumped = label[label]
        if (jumped == label).all():
            return label
        label = jumped


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of long ids -> ``(node, component)``, component = smallest id reachable.

    Only nodes with an edge to another node are returned; null ends and self-loops are ignored;
    an empty edge table gives an empty result. Minima are written before they are joined, so both
    join sides are plain shuffles and adaptive execution can split a hub's rows.
    """

    def minima(pairs: DataFrame) -> tuple[DataFrame, str]:
        return scratch.write(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))

    def save(pairs: DataFrame) -> tuple[DataFrame, str, tuple]:
        seen = Observation()
        told = pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 32)).alias("h"))
        table, path = scratch.write(told)
        return table, path, (seen.get["n"], seen.get["h"])

    hi, lo = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now, path, mark = save(edges.filter("a <> b").select(hi, lo).distinct())
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m, m_path = minima(both)
        large, large_path = scratch.write(both.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        m2, m2_path = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(m2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old_path, old_mark = path, mark
        now, path, mark = save(small.unionByName(m2.select("u", F.col("m").alias("v"))).distinct())
        for x in (old_path, m_path, large_path, m2_path):
            scratch.drop(x)
        if mark == old_mark:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
