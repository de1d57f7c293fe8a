"""SimHash near-dedup: pigeonhole blocks over 64-bit fingerprints, joined on blocks, verified by Hamming distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns, map_groups, map_texts
from .components import connected_components, forest
from .jaccard import minima, similar_links

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Blocks with more distinct fingerprints than this are split again on the bits they do not yet share.
BLOCK_ROWS = 512


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of the text's word shingles, in order, repeats included.

    ASCII letters are lower-cased, words are runs without ASCII white space; with fewer words than
    a shingle the whole sequence is one shingle; without words (or null) there is none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype=np.uint64, count=n - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; 0 without any."""
    if len(hashes) == 1:
        return int(hashes[0])
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        votes += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: the majority bits of the text's shingles."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def start():
        return lambda texts: {"fp": np.fromiter((fingerprint(t, shingle) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)}

    return map_texts(docs, id_col, text_col, start, "fp long")


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, fp, mark, bands, signature, shingles): mark names the set of the text's shingles, which has so many; the rest is of ``jaccard.minima``."""

    def start():
        def work(texts: list) -> dict:
            made: dict[str, list] = {"fp": [], "mark": [], "bands": [], "signature": [], "shingles": []}
            for t in texts:
                hashes = shingle_hashes(t, shingle)
                distinct = np.unique(hashes)
                keys, signature = minima(distinct)
                made["fp"].append(_signed(majority(hashes)))
                made["mark"].append(xxhash.xxh128_digest(distinct.tobytes()))
                made["bands"].append(keys)
                made["signature"].append(signature)
                made["shingles"].append(len(distinct))
            return made

        return work

    return map_texts(docs, id_col, text_col, start, "fp long,mark binary,bands longs,signature binary,shingles long")


def block_masks(free: list[tuple[int, int]], radius: int = RADIUS) -> list[int]:
    """Masks over the ``free`` bit ranges, cut into radius+2 blocks: any close pair agrees on one mask.

    At most ``radius`` blocks hold a differing bit, so two of the radius+2 blocks are equal.
    """
    bits = [b for lo, hi in free for b in range(lo, hi)]
    parts = np.array_split(bits, radius + 2)
    return [int(sum(1 << int(b) for p in pair for b in p)) for pair in combinations(parts, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _levels(radius: int) -> list[list[int]]:
    """Masks of level 1, 2 and 3; each deeper mask contains a mask of the level above and more bits."""
    levels = [block_masks([(0, 64)], radius)]
    for _ in range(2):
        deeper = []
        for mask in levels[-1]:
            free = [(b, b + 1) for b in range(64) if not mask >> b & 1]
            deeper += [mask | m for m in block_masks(free, radius)]
        levels.append(list(dict.fromkeys(deeper)))
    return levels


def _links(group: pd.DataFrame, radius: int) -> pd.DataFrame | None:
    """A spanning forest of the verified links inside one block."""
    fps, ids = group["fp"].to_numpy().view(np.uint64), group["rep"].to_numpy()
    order = np.argsort(ids, kind="stable")
    fps, ids = fps[order], ids[order]
    left, right = [], []
    for at in range(0, len(fps), 1024):
        near = np.bitwise_count(fps[at : at + 1024, None] ^ fps[None, :]) <= radius
        a, b = np.nonzero(near)
        keep = a + at < b
        left.append(a[keep] + at)
        right.append(b[keep])
    label = forest(len(fps), np.concatenate(left), np.concatenate(right))
    own = np.arange(len(fps))
    tied = label != own
    return pd.DataFrame({"a": ids[tied], "b": ids[label[tied]]}) if tied.any() else None


def close_links(reps: DataFrame, scratch: Scratch, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``reps(fp, rep)`` with distinct fp -> links (a, b) whose closure equals that of all pairs within ``radius``.

    Fingerprints meet on pairs of equal blocks. A block with over ``block_rows`` distinct fingerprints is
    cut again on the bits its members do not share, twice at most, after which it can hold only the
    values of its last free bits; nothing is skipped. Each block emits a spanning forest, not its pairs.
    """
    found = None
    waiting = reps.select("fp", "rep", F.lit(None).cast("long").alias("mask"))
    levels = _levels(radius)
    for depth, masks in enumerate(levels):
        if depth == 0:
            keyed = waiting.withColumn("mask", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])))
        else:
            deeper = F.array(*[F.lit(_signed(m)) for m in masks])
            keyed = waiting.withColumn("up", F.col("mask")).withColumn("mask", F.explode(F.filter(deeper, lambda m: m.bitwiseAND(F.col("up")) == F.col("up")))).drop("up").distinct()
        keyed = keyed.withColumn("block", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        sizes = scratch.keep(keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        keyed = keyed.join(sizes, "block")
        last = depth == len(levels) - 1
        small = keyed if last else keyed.filter(F.col("n") <= block_rows)
        links = map_groups(small.select("block", "fp", "rep"), "block", lambda g: _links(g, radius), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if last or sizes.filter(F.col("n") > block_rows).isEmpty():
            return found
        waiting = scratch.keep(keyed.filter(F.col("n") > block_rows).select("fp", "rep", "mask"))
    return found


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, block_rows: int = BLOCK_ROWS, similarity: float | None = None) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id, kept).

    Documents link when their fingerprints differ in at most ``radius`` bits; component_id is the smallest
    doc_id reachable and kept marks that document. Null and empty texts have fingerprint 0 and link with
    each other; rows with equal text share a fingerprint, so copies are compared once; an empty table
    gives no rows; other columns are ignored. Rows without an id link like any; their component is the smallest id
    in it, null if it has none.

    With a ``similarity``, texts also link when the Jaccard similarity of their shingle sets reaches it: such
    texts differ in more bits than blocks can select on, so their candidates are those of ``jaccard``, verified
    on the whole sets. Ids must then be unique and not null.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep(fingerprints(docs, id_col, text_col, shingle) if similarity is None else sketches(docs, id_col, text_col, shingle))
    reps = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    if similarity is None:
        # fingerprints are the nodes, as ids may be null or stand in several of them
        links = close_links(reps.select("fp", F.col("fp").alias("rep")), scratch, radius, block_rows)
        parts = scratch.keep(connected_components(links, scratch))
        grouped = reps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
        named = grouped.join(least, "component").select("fp", "component_id")
    else:
        links = close_links(reps, scratch, radius, block_rows)
        nodes = prints.groupBy("fp", "mark").agg(F.min(F.struct("doc_id", "bands", "signature", "shingles")).alias("first")).select("fp", F.col("first.doc_id").alias("node"), "first.bands", "first.signature", "first.shingles")
        nodes = scratch.keep(nodes)
        same = nodes.join(reps, "fp").filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
        texts = columns(docs, id_col, text_col).toDF("node", "text").withColumns({"node": F.col("node").cast("long"), "text": F.col("text").cast("string")})
        near = similar_links(nodes, texts, lambda t: shingle_hashes(t, shingle), scratch, similarity)
        parts = scratch.keep(connected_components(links.unionByName(same).unionByName(near), scratch))
        named = reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = scratch.keep(named)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
