"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

ITQ after Gong and Lazebnik (CVPR 2011), multi-index hashing after Norouzi et al. (CVPR 2012).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, map_groups
from .components import connected_components, forest
from .groups import cell_rows, group_links, pairs_within

THRESHOLD = 0.95
#: Vectors the rotation is learnt from.
SAMPLE = 4096
BITS = 64
TABLES = 4
#: Every key is also entered with each choice of its so many least certain bits flipped.
FLIPS = 3
#: Share of pairs at the threshold that the index must find, measured on the sample; see ``choose_index``.
RECALL = 0.985
#: Rotations and flips in the order they are tried, by their number of keys.
EFFORTS = ((1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (4, 4))
#: Largest share of differing code bits of a pair that is reranked; see ``hamming_limit``.
SLACK = 5.0
#: Rows compared with each other at once; larger buckets and components are dealt out as pairs of blocks.
BLOCK = 2048


@dataclass
class Codes:
    """Rotation into ``bits`` balanced signs."""

    rotation: np.ndarray

    def project(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.rotation


def learn_rotation(unit: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 5) -> Codes:
    """Principal directions of unit vectors turned so that their signs lose least (ITQ)."""
    dims = unit.shape[1]
    bits = min(bits, dims)
    rng = np.random.default_rng(seed)
    _, vectors = np.linalg.eigh(unit.T @ unit)
    basis = vectors[:, ::-1][:, :bits]
    flat = unit @ basis
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds if len(unit) else 0):
        u, _, vt = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
        turn = (u @ vt).T
    return Codes(basis @ turn)


def key_bits(rows: int, bits: int) -> int:
    """Width of a table's key: enough that unrelated vectors rarely share one."""
    return max(1, min(bits, 60, max(10, math.ceil(math.log2(max(2, rows))) + 2)))


def hamming_limit(bits: int, threshold: float, slack: float = SLACK) -> int:
    """Code distance that linked pairs stay under: its mean at the threshold angle plus ``slack`` deviations."""
    p = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    return min(bits, math.ceil(bits * p + slack * math.sqrt(bits * p * (1 - p))))


def table_bits(bits: int, width: int, tables: int = TABLES) -> list[np.ndarray]:
    """Bit numbers of each table's substring, evenly spread and overlapping only if they must."""
    return [(np.arange(width) + round(t * bits / tables)) % bits for t in range(tables)]


def encode(unit: np.ndarray, codes: Codes, width: int, tables: int = TABLES, flips: int = FLIPS) -> tuple[np.ndarray, np.ndarray]:
    """(code, keys): 64-bit codes and, per vector, the keys of all tables with uncertain bits both ways."""
    z = codes.project(unit)
    signs = z >= 0
    bits = z.shape[1]
    code = (signs.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    keys = []
    for t, at in enumerate(table_bits(bits, width, tables)):
        part = (signs[:, at].astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        weak = np.argsort(np.abs(z[:, at]), axis=1, kind="stable")[:, : min(flips, width)].astype(np.uint64)
        for choice in range(1 << weak.shape[1]):
            turned = part.copy()
            for k in range(weak.shape[1]):
                if choice >> k & 1:
                    turned ^= np.uint64(1) << weak[:, k]
            keys.append(turned | np.uint64(t) << np.uint64(60))
    return code.view(np.int64), np.stack(keys, axis=1).view(np.int64) if keys else np.zeros((len(unit), 0), np.int64)


@dataclass
class Index:
    """What codes and keys are made with: ``TABLES`` tables from each rotation."""

    rotations: list[Codes]
    width: int
    flips: int

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code by the first rotation, keys of all tables)."""
        made = [encode(unit, codes, self.width, TABLES, self.flips) for codes in self.rotations]
        return made[0][0], np.concatenate([keys ^ np.int64(k * TABLES << 60 if k * TABLES < 8 else (k * TABLES << 60) - (1 << 64)) for k, (_, keys) in enumerate(made)], axis=1)


def pairs_at(unit: np.ndarray, cosine: float, seed: int = 8) -> np.ndarray:
    """For each unit vector another one at the given cosine, in a random direction."""
    away = np.random.default_rng(seed).normal(size=unit.shape)
    away -= np.einsum("ij,ij->i", away, unit)[:, None] * unit
    return cosine * unit + math.sqrt(max(0.0, 1 - cosine * cosine)) * away / np.maximum(1e-12, np.linalg.norm(away, axis=1, keepdims=True))


def index_recall(index: Index, unit: np.ndarray, threshold: float) -> float:
    """The share of made pairs at the threshold that share a key and stay within the code limit."""
    (code, keys), (other, theirs) = index.encode(unit), index.encode(pairs_at(unit, threshold))
    bits = index.rotations[0].rotation.shape[1]
    near = np.bitwise_count(code.view(np.uint64) ^ other.view(np.uint64)) <= hamming_limit(bits, threshold)
    return float(np.mean([n and bool(np.isin(a, b).any()) for n, a, b in zip(near, keys, theirs)])) if len(unit) else 1.0


def choose_index(learnt: np.ndarray, rows: int, threshold: float = THRESHOLD, goal: float = RECALL, trials: int = 1000) -> Index:
    """The index of fewest keys whose recall of pairs at the threshold reaches ``goal``, measured on the sample.

    Keys are as wide as ``rows`` ask for. As they widen, more bits are tried both ways and further rotations add tables;
    where that is not enough they are narrowed, which costs comparisons in fuller buckets.
    """
    unit = learnt[:: max(1, len(learnt) // trials)][:trials]
    rotations = [learn_rotation(learnt)]
    width = key_bits(rows, rotations[0].rotation.shape[1])
    while True:
        for turns, flips in EFFORTS:
            while len(rotations) < turns:
                rotations.append(learn_rotation(learnt, seed=5 + len(rotations)))
            index = Index(rotations[:turns], width, min(flips, width))
            if width == 1 or index_recall(index, unit, threshold) >= goal:
                return index
        width = max(1, width - 2)


def units(raw: np.ndarray) -> np.ndarray:
    """Rows to unit length, without overflow."""
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _vectors(raw: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def near_links(vectors: DataFrame, keys: DataFrame, scratch: Scratch, threshold: float, limit: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose closure is that of all retrieved pairs at or over the threshold.

    ``keys(vec_id, code, key)`` meet in buckets, hot ones as ``groups.group_links`` deals them; only rows with a mate
    within ``limit`` code bits fetch their vectors, which are compared within the bucket; each bucket emits a spanning forest.
    """

    def mates(group: pd.DataFrame) -> pd.DataFrame | None:
        group = cell_rows(group, "vec_id")
        if len(group) < 2:
            return None
        code = group["code"].to_numpy().view(np.uint64)
        if len(code) <= 512 and group["asks"].to_numpy().all():
            # the many small buckets: who has a mate at all
            near = (np.bitwise_count(code[:, None] ^ code[None, :]) <= limit).sum(axis=1) > 1
            return group.loc[near, ["cell", "vec_id", "asks"]] if near.any() else None
        pairs = pairs_within(len(code), group["asks"].to_numpy(), lambda rows: np.bitwise_count(code[rows, None] ^ code[None, :]) <= limit)
        near = np.unique(np.concatenate(pairs))
        return group.iloc[near][["cell", "vec_id", "asks"]] if len(near) else None

    def links(group: pd.DataFrame) -> pd.DataFrame | None:
        group = cell_rows(group, "vec_id")
        ids, x = group["vec_id"].to_numpy(), _vectors(group["unit"])
        label = forest(len(ids), *pairs_within(len(ids), group["asks"].to_numpy(), lambda rows: x[rows] @ x.T >= threshold))
        tied = label != np.arange(len(ids))
        return pd.DataFrame({"a": ids[tied], "b": ids[label[tied]]}) if tied.any() else None

    def find(cells: DataFrame) -> DataFrame:
        wanted = map_groups(cells.select("cell", "vec_id", "code", "asks"), "cell", mates, "cell long, vec_id long, asks boolean")
        return map_groups(wanted.join(vectors, "vec_id").select("cell", "vec_id", "unit", "asks"), "cell", links, "a long, b long").distinct()

    return group_links(keys.select("key", "vec_id", "code"), "key", "vec_id", find, scratch, block)


def count_links(vectors: DataFrame, parts: DataFrame, scratch: Scratch, threshold: float, dims: int, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links) by comparing the original vectors within each component.

    In a component over ``block`` rows, vectors within half the threshold angle of its mean are linked
    with each other for certain and are counted, not compared; the others meet all rows, in blocks.
    """
    sizes = scratch.keep(parts.groupBy("component").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows")))
    members = scratch.keep(parts.join(sizes, "component").join(vectors, "vec_id"))

    def within(group: pd.DataFrame) -> pd.DataFrame:
        x, copies = _vectors(group["unit"]), group["copies"].to_numpy()
        n = np.concatenate([(x[at : at + 512] @ x.T >= threshold) @ copies for at in range(0, len(x), 512)])
        own = np.einsum("ij,ij->i", x, x) >= threshold
        return pd.DataFrame({"vec_id": group["vec_id"], "n_links": n - own})

    out = map_groups(members.filter(F.col("rows") <= block).select("component", "vec_id", "copies", "unit"), "component", within, "vec_id long, n_links long")
    large = members.filter(F.col("rows") > block)
    if large.isEmpty():
        return out
    half = math.cos(math.acos(threshold) / 2) + 1e-9

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("unit").to_pylist()), np.float64).reshape(batch.num_rows, -1)
            component = batch.column("component").to_numpy()
            for c in np.unique(component):
                sums[int(c)] = sums.get(int(c), 0) + x[component == c].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["component", "v"])

    means = large.select("component", "unit").mapInArrow(add, "component long, v array<double>").groupBy("component").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(dims)]).alias("mean"))

    @F.pandas_udf("boolean")
    def central(unit: pd.Series, mean: pd.Series) -> pd.Series:
        m = np.array(mean.tolist(), np.float64)
        return pd.Series(np.einsum("ij,ij->i", _vectors(unit), m) >= half * np.linalg.norm(m, axis=1)) if len(unit) else pd.Series([], dtype=bool)

    large = scratch.keep(large.join(means, "component").withColumn("core", central("unit", "mean")).drop("mean"))
    cores = scratch.keep(large.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("cores"), F.sum(F.when(F.col("core"), 0).otherwise(1)).alias("rim")))
    sure = large.filter("core").join(cores, "component").select("vec_id", (F.col("cores") - 1).alias("n_links"))
    # rim rows against all rows: both sides in blocks, each pair of blocks one cell
    sized = large.join(cores.filter("rim > 0"), "component")
    across, down = F.ceil(F.col("rows") / block).cast("int"), F.ceil(F.col("rim") / block).cast("int")
    spot = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(9)), n).cast("int")
    cell = lambda i, j: F.xxhash64("component", i, j)
    asks = sized.filter("not core").withColumn("i", spot(down)).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), across - 1), lambda j: cell(F.col("i"), j))))
    told = sized.withColumn("j", spot(across)).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), down - 1), lambda i: cell(i, F.col("j")))))
    pick = lambda df, asking: df.select("cell", "vec_id", "copies", "core", "unit", F.lit(asking).alias("asking"))

    def between(group: pd.DataFrame) -> pd.DataFrame | None:
        asking, x, copies, ids, core = (group[c].to_numpy() for c in ("asking", "unit", "copies", "vec_id", "core"))
        v = _vectors(group["unit"])
        q, a = np.flatnonzero(asking), np.flatnonzero(~asking)
        if not len(q) or not len(a):
            return None
        near = v[q] @ v[a].T >= threshold
        same = ids[q][:, None] == ids[a][None, :]
        mine = near @ copies[a] - (near & same).sum(axis=1)
        back = (near & core[a][None, :]).T @ copies[q]
        return pd.DataFrame({"vec_id": np.concatenate([ids[q], ids[a][back > 0]]), "n_links": np.concatenate([mine, back[back > 0]])})

    met = map_groups(pick(asks, True).unionByName(pick(told, False)), "cell", between, "vec_id long, n_links long")
    return out.unionByName(sure.unionByName(met).groupBy("vec_id").agg(F.sum("n_links").alias("n_links")))


def embedding_dedup(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, sample: int = SAMPLE, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """One row per row of the table: (vec_id, n_links, component_id, kept).

    Vectors link at a cosine of ``threshold`` or more, compared in double precision. The index is learnt on
    ``sample`` vectors and holds all of them; n_links counts every link inside a component. A null vector,
    a zero one, one with a null or non-finite entry, or of another length than most of the sample links
    with nothing. Every usable row counts as a vector of its own, also rows that repeat an id (all its rows
    then carry what their own vector finds); a null id is returned unlinked; an empty table gives no rows; other columns are ignored.

    The index finds at least the share ``RECALL`` of the pairs at the threshold, as measured on the sample, and more of closer ones;
    with ``exact`` all vectors are one bucket, so every link is found, at a cost that grows with the square of what links with nothing.
    """
    spark, scratch = table.sparkSession, Scratch(table.sparkSession)
    named = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    lengths = named.filter("v is not null and size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    lone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    if lengths is None:
        return named.select("vec_id", *lone)
    dims, rows = lengths.d, lengths.n
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") == dims) & finite & F.exists("v", lambda x: x != 0), F.lit(False))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = units(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([u.tobytes() for u in unit], pa.binary())], names=["vec_id", "unit"])

    usable = scratch.keep(named.filter(fit).mapInArrow(prepare, "vec_id long, unit binary"))
    # equal vectors are compared once: the smallest id stands for all rows that hold it
    copies = scratch.keep(usable.groupBy("unit").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    clash = scratch.keep(copies.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    clashes = not clash.isEmpty()
    if clashes:
        # an id that stands for several vectors gets a number of its own for each but the first
        nth = F.row_number().over(Window.partitionBy("rep").orderBy("unit"))
        copies = scratch.keep(copies.withColumn("nth", nth).withColumn("node", F.when(F.col("nth") == 1, F.col("rep")).otherwise(F.xxhash64("rep", "nth"))).drop("nth"))
    else:
        copies = copies.withColumn("node", F.col("rep"))
    vectors = copies.select(F.col("node").alias("vec_id"), "unit", "copies")
    different = vectors.count()
    share = min(1.0, 2 * sample / max(1, different))
    drawn = vectors.withColumn("draw", F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(31)), 24)).filter(F.col("draw") <= int(share * (1 << 40))).orderBy("draw", "vec_id").limit(sample)
    learnt = _vectors(pd.Series([bytes(r.unit) for r in drawn.select("unit").collect()] or [np.zeros(dims).tobytes()]))
    index = choose_index(learnt, different, threshold)
    bits = index.rotations[0].rotation.shape[1]

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = np.frombuffer(b"".join(batch.column("unit").to_pylist()), np.float64).reshape(batch.num_rows, -1)
                code, keys = index.encode(unit)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(code), flat], names=["vec_id", "code", "keys"])

    entered = vectors.select("vec_id", "unit").mapInArrow(enter, "vec_id long, code long, keys array<long>")
    keys = scratch.keep(entered.select("vec_id", "code", F.lit(0).cast("long").alias("key") if exact else F.explode("keys").alias("key")))
    links = near_links(vectors.select("vec_id", "unit"), keys, scratch, threshold, 64 if exact else hamming_limit(bits, threshold), block)
    parts = scratch.keep(connected_components(links, scratch))
    counted = vectors.select("vec_id", "copies").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left").withColumn("component", F.coalesce("component", "vec_id"))
    counted = scratch.keep(counted)
    linked = counted.join(parts.select(F.col("node").alias("vec_id")), "vec_id", "left_semi")
    numbers = count_links(vectors.select("vec_id", "unit"), linked, scratch, threshold, dims, block)
    classes = counted.join(numbers, "vec_id", "left").select(F.col("vec_id").alias("node"), F.coalesce("n_links", F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    classes = scratch.keep(classes)
    held = usable.join(copies, "unit").select("vec_id", "rep", "node").join(classes, "node")
    if clashes:
        least = held.groupBy("component_id").agg(F.min("rep").alias("least"))
        held = held.join(least, "component_id").withColumn("component_id", F.col("least"))
    held = held.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return held.unionByName(named.filter(~fit).select("vec_id", *lone))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same result as a DuckDB statement over ``embeddings`` that compares all pairs."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {threshold}::DOUBLE),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
part AS (SELECT a, min(b) AS low FROM reach GROUP BY a), many AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM v LEFT JOIN part p ON p.a = vec_id LEFT JOIN many m ON m.a = vec_id
"""
