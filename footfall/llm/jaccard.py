"""Links between texts whose word shingles have a Jaccard similarity of a threshold or more, verified on whole shingle sets.

SimHash fingerprints of such texts differ by up to a dozen bits, which pigeonhole blocks cannot select, so ``simhash_dedup``
takes candidates from here when it is asked for a similarity: MinHash bands after Broder (1997), compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_groups
from .components import connected_components, forest
from .groups import cell_rows, group_links, pairs_within

#: Minima are taken in so many bands of so many; texts at similarity 0.8 share a band with probability 0.998.
BANDS, BAND = 12, 4
#: Candidates agree on at least the share of minima expected at the threshold less so many deviations.
SLACK = 4.5
#: Rows of a bucket compared at once; see ``groups.group_links``.
BLOCK = 512
#: Shingles of a set that counts as a light one; a block of such sets takes 8 MB.
LIGHT = 2048
_FACTORS = np.random.default_rng(12).integers(1, 1 << 63, size=BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(13).integers(1, 1 << 63, size=BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPAN = 16_384


def minima(shingles: np.ndarray) -> tuple[list[int], bytes]:
    """(band keys, signature) of the hashes of a text's shingles, a byte of the signature for each minimum; no keys without shingles."""
    if not len(shingles):
        return [], bytes(BANDS * BAND)
    low = np.full(BANDS * BAND, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), _SPAN):
        low = np.minimum(low, (shingles[at : at + _SPAN, None] * _FACTORS).min(axis=0))
    spread = low ^ (low >> np.uint64(29))
    keys = (spread.reshape(BANDS, BAND) * _MIX).sum(axis=1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64).tolist(), (low >> np.uint64(8)).astype(np.uint8).tobytes()


def agreement_limit(threshold: float) -> int:
    slots = BANDS * BAND
    return math.floor(slots * threshold - SLACK * math.sqrt(slots * threshold * (1 - threshold)))


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many items each two of the sets share (of a set with itself: those that stand in another set too)."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[column] > 1
    owner, column = owner[common], (np.cumsum(times > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n))
    width = max(256, (1 << 22) // n)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        x = np.zeros((n, width), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        out += x @ x.T
    return out


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two different sets have a Jaccard similarity of ``threshold`` or more."""
    sizes, both = np.array([len(s) for s in sets]), shared(sets)
    return (both > 0) & (both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9)


def _close(signatures: np.ndarray, band: int, limit: int, rows: slice) -> np.ndarray:
    """Rows against all: enough minima agree, and no band before this one does, where the pair has met already."""
    out = []
    step = max(1, (1 << 22) // max(1, signatures.size))
    stop = min(rows.stop, len(signatures))
    for at in range(rows.start, stop, step):
        same = signatures[at : min(at + step, stop), None, :] == signatures[None, :, :]
        met = same.reshape(*same.shape[:2], BANDS, BAND)[:, :, :band].all(axis=3).any(axis=2)
        out.append((same.sum(axis=2) >= limit) & ~met)
    return np.concatenate(out)


def packed_sets(texts: DataFrame, hashes: Callable[[str | None], np.ndarray]) -> DataFrame:
    """``texts(node, text)`` -> (node, shingles): the sorted distinct hashes of each text's shingles, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(hashes(t.as_py())).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def similar_links(nodes: DataFrame, texts: DataFrame, hashes: Callable[[str | None], np.ndarray], scratch: Scratch, threshold: float, block: int = BLOCK, light: int = LIGHT) -> DataFrame:
    """Links (a, b) whose closure is that of all retrieved pairs of texts at or over the threshold.

    ``nodes(node, bands, signature, shingles)`` are different texts with their number of shingles (without it: all light ones), ``texts(node,
    text)`` holds them and ``hashes`` gives a text's shingles. Band keys alone are shuffled to find the buckets that hold two nodes or more;
    signatures go only there, and whole sets only to candidates: once to each where its component of candidates fits a cell, else once for
    each bucket cell. Sets over ``light`` shingles are keyed apart, in classes that double in size, with cells that halve: two sets at the
    threshold have sizes in its ratio, so they are in one class if each is also entered in the next one where a partner could
    lie there. What a task holds is thus ``block`` times ``light`` shingles, or two sets.
    """
    limit = agreement_limit(threshold)
    sized = nodes if "shingles" in nodes.columns else nodes.withColumn("shingles", F.lit(0))
    level = lambda n: F.when(n <= light, F.lit(0)).otherwise(F.ceil(F.log2(n / light))).cast("int")
    classes = F.array_distinct(F.array(level(F.col("shingles")), level(F.floor(F.col("shingles") / threshold))))
    keyed = sized.select("node", F.explode(classes).alias("level"), "bands").select("node", "level", F.posexplode("bands").alias("band", "bucket"))
    keyed = keyed.withColumn("bucket", F.xxhash64("band", "bucket", "level"))
    marks_of, weights = sized.select("node", "signature"), sized.select("node", F.col("shingles").alias("size"))

    def mates(group: pd.DataFrame) -> pd.DataFrame | None:
        group = cell_rows(group, "node")
        if len(group) < 2:
            return None
        ids, asks, band = group["node"].to_numpy(), group["asks"].to_numpy(), int(group["band"].iloc[0])
        marks = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), -1)
        left, right = pairs_within(len(group), asks, lambda rows: _close(marks, band, limit, rows))
        wanted = np.unique(np.concatenate([left, right]))
        if not len(wanted):
            return None
        label = forest(len(group), left, right)
        return pd.DataFrame({"cell": group["cell"].iloc[0], "node": ids[wanted], "asks": asks[wanted], "first": ids[label[wanted]]})

    def links(group: pd.DataFrame) -> pd.DataFrame | None:
        group = cell_rows(group, "node")
        ids, asks = group["node"].to_numpy(), group["asks"].to_numpy()
        near = similar([np.frombuffer(s, np.uint64) for s in group["shingles"]], threshold)
        label = forest(len(ids), *pairs_within(len(ids), asks, near.__getitem__))
        tied = label != np.arange(len(ids))
        return pd.DataFrame({"a": ids[tied], "b": ids[label[tied]]}) if tied.any() else None

    def find(cells: DataFrame) -> DataFrame:
        met = cells.select("cell", "node", "asks", "band").join(marks_of, "node")
        wanted = scratch.keep(map_groups(met, "cell", mates, "cell long, node long, asks boolean, first long"))
        held = scratch.keep(packed_sets(texts.join(wanted.select("node").distinct(), "node", "left_semi"), hashes))
        parted = connected_components(wanted.select(F.col("node").alias("a"), F.col("first").alias("b")), scratch)
        sums = parted.join(weights, "node").groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"))
        small = sums.filter((F.col("rows") <= block) & (F.col("size") <= block * light))
        whole = scratch.keep(parted.join(small, "component").select("node", F.col("component").alias("cell"), F.lit(True).alias("asks")))
        split = wanted.join(whole.select("node"), "node", "left_anti").select("node", "cell", "asks")
        # marked, so that no cell of the one kind is one of the other
        dealt = whole.withColumn("cell", F.xxhash64("cell", F.lit("whole"))).unionByName(split.withColumn("cell", F.xxhash64("cell", F.lit("split"))))
        return map_groups(dealt.join(held, "node"), "cell", links, "a long, b long").distinct()

    return group_links(keyed, "bucket", "node", find, scratch, block, weight="level")
