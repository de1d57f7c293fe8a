"""Links inside groups of any size: small groups whole, hot ones in chunks around shared pivots, then what is left."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

#: Rows of a hot group that every chunk of it is compared with, on average.
PIVOTS = 48


def group_links(keyed: DataFrame, key: str, node: str, find: Callable[[DataFrame], DataFrame], scratch: Scratch, block: int, pivots: int = PIVOTS, weight: str | None = None) -> DataFrame:
    """Links (a, b) whose closure is that of all links between two rows of one group of ``key``.

    ``find`` takes cells, ``keyed`` with the columns ``cell`` and ``asks``, and returns links (a, b) whose closure
    is that of all linked pairs in a cell of which a row asks. Groups up to ``block`` rows are one cell. The
    rows of a larger one are dealt to chunks of that size, each with the same few pivots; what the pivots'
    main component then does not hold asks all rows of its group, in blocks. So a hot group of copies costs as much as
    it has rows, and only rows that copy nothing meet all others. With ``weight``, a column that is equal within a group, cells and pivots are
    halved so many times, so that heavy rows fill a cell as light ones do.
    """
    told = [F.count(F.lit(1)).alias("n"), *([F.max(weight).alias("halved")] if weight else [])]
    sizes = scratch.keep(keyed.groupBy(key).agg(*told).filter("n > 1"))
    sized = keyed.join(sizes, key)
    extra = ["n", *(["halved"] if weight else [])]
    if weight:
        block, pivots = (F.greatest(F.lit(least), F.floor(F.lit(most) / F.pow(F.lit(2), F.col("halved"))).cast("int")) for most, least in ((block, 2), (pivots, 1)))
    found = find(sized.filter(F.col("n") <= block).drop(*extra).withColumns({"cell": F.xxhash64(key), "asks": F.lit(True)}))
    if sizes.filter(F.col("n") > block).isEmpty():
        return found
    spot = lambda n, seed: F.pmod(F.xxhash64(node, F.lit(seed)), n)
    cell = lambda *at: F.xxhash64(key, *at)
    parts = F.ceil(F.col("n") / block).cast("int")
    hot = scratch.keep(sized.filter(F.col("n") > block))
    everywhere = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: cell(p.cast("long")))
    chunks = F.when(spot(F.col("n"), 4) < pivots, everywhere).otherwise(F.array(cell(spot(parts, 3).cast("long"))))
    near = scratch.keep(find(hot.withColumn("cell", F.explode(chunks)).drop(*extra).withColumn("asks", F.lit(True))))
    parted = connected_components(near, scratch).withColumnRenamed("node", node)
    named = scratch.keep(hot.join(parted, node, "left").withColumn("component", F.coalesce("component", node)))
    hubs = named.groupBy(key, "component").agg(F.count(F.lit(1)).alias("rows")).groupBy(key).agg(F.max(F.struct("rows", (-F.col("component")).alias("minus"))).alias("top"))
    hubs = scratch.keep(hubs.select(key, (-F.col("top.minus")).alias("hub"), F.col("top.rows").alias("held")))
    told = named.join(hubs, key).withColumn("rim", F.col("n") - F.col("held")).filter("rim > 0")
    down = F.ceil(F.col("rim") / block).cast("int")
    asking = told.filter("component <> hub").withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda j: cell(spot(down, 9).cast("long"), j.cast("long"), F.lit(1)))))
    told = told.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), down - 1), lambda i: cell(i.cast("long"), spot(parts, 3).cast("long"), F.lit(1)))))
    pick = lambda df, asks: df.select(*keyed.columns, "cell").withColumn("asks", F.lit(asks))
    return found.unionByName(near).unionByName(find(pick(asking, True).unionByName(pick(told, False))))


def cell_rows(group: pd.DataFrame, node: str) -> pd.DataFrame:
    """A cell's rows once each; a row asks if any of its entries does. Where all ask, none is in it twice."""
    if group["asks"].to_numpy().all():
        return group
    return group.sort_values([node, "asks"], ascending=[True, False], kind="stable").drop_duplicates(node)


def pairs_within(rows: int, asks: np.ndarray, near: Callable[[slice], np.ndarray], step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs a < b of which one asks and ``near`` holds; it is given a slice of rows and returns their rows against all."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, rows, step):
        a, b = np.nonzero(near(slice(at, at + step)))
        a = a + at
        keep = (a < b) & (asks[a] | asks[b])
        left.append(a[keep])
        right.append(b[keep])
    return np.concatenate(left), np.concatenate(right)
