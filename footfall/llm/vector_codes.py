"""Short codes for vectors: product quantisation in whole numbers, learnt on weighted distinct parts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A key that holds over one in so many rows is joined by broadcast, so at most this many keys a position are.
HOT_SHARE = 1024
#: Parts compared with a codebook at once.
CHUNK = 4096


@dataclass(frozen=True)
class Codes:
    """``rows(vec_id, code, error, label_error, codebooks_sha256)`` and ``codebooks[position][entry][component]`` of whole numbers."""

    rows: DataFrame
    codebooks: np.ndarray
    scale: int

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for."""
        entries = [int(code[k : k + 2], 16) for k in range(0, len(code), 2)]
        return np.concatenate([self.codebooks[p][e] for p, e in enumerate(entries)]) / self.scale


def checksum(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row; ties go to the lower entry."""
    entry, error = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
    for at in range(0, len(values), CHUNK):
        gap = values[at : at + CHUNK, None, :] - book[None]
        far = np.einsum("nkw,nkw->nk", gap, gap)
        entry[at : at + CHUNK] = far.argmin(axis=1)
        error[at : at + CHUNK] = far.min(axis=1)
    return entry, error


def _values(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = batch.column("part").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, width)


def lloyd(distinct: DataFrame, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after so many rounds over ``distinct(pos, part, weight)``.

    Each task folds its rows into one sum and weight per position, entry and component; those alone are shuffled, and their totals
    (positions x entries x components, fixed numbers) go to the driver. Rounds that would change nothing are left out.
    """
    parts, entries, width = codebooks.shape
    for _ in range(rounds):

        def fold(batches: Iterator[pa.RecordBatch], books: np.ndarray = codebooks) -> Iterator[pa.RecordBatch]:
            totals, weights = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
            for batch in batches:
                values = _values(batch, width)
                pos, weight = (batch.column(c).to_numpy() for c in ("pos", "weight"))
                for p in np.unique(pos):
                    rows = pos == p
                    entry, _ = nearest(values[rows], books[p])
                    np.add.at(totals[p], entry, values[rows] * weight[rows, None])
                    np.add.at(weights[p], entry, weight[rows])
            p, e = weights.nonzero()
            made = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p)), totals[p, e].reshape(-1), np.repeat(weights[p, e], width)]
            yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int64)) for m in made], names=["p", "e", "c", "total", "weight"])

        sums = distinct.mapInArrow(fold, "p long, e long, c long, total long, weight long").groupBy("p", "e", "c").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
        moved = codebooks.copy()
        for r in sums.collect():
            moved[r.p, r.e, r.c] = r.total // r.weight
        if (moved == codebooks).all():
            break
        codebooks = moved
    return codebooks


def encode_parts(distinct: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(pos, part, weight, entry, far): the nearest entry of each distinct part and its squared distance."""
    width = codebooks.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, pos = _values(batch, width), batch.column("pos").to_numpy()
            entry, far = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
            for p in np.unique(pos):
                rows = pos == p
                entry[rows], far[rows] = nearest(values[rows], codebooks[p])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pos", "part", "weight")), pa.array(entry), pa.array(far)], names=["pos", "part", "weight", "entry", "far"])

    return distinct.mapInArrow(run, "pos int, part array<int>, weight long, entry long, far long")


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, rows: int) -> DataFrame:
    """Inner join of rows with what is known of their keys, where ``right`` has one row a key and its number of rows in ``left``.

    Keys of over one row in HOT_SHARE are few (fewer than HOT_SHARE for each value of the other columns, whatever the table) and are
    broadcast; the others meet by shuffle, where no key is large. Null keys meet each other.
    """
    hot = F.col(count) * HOT_SHARE > rows
    named = [F.col(c).alias(f"_{c}") for c in on]
    other = [c for c in right.columns if c not in (*on, count)]
    frequent, rare = (right.filter(part).select(*named, *other, F.lit(True).alias("_met")) for part in (hot, ~hot))
    matches = F.lit(True)
    for c in on:
        matches &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    looked = left.join(F.broadcast(frequent), matches, "left")
    met = looked.filter("_met").select(*left.columns, *other)
    rest = looked.filter("_met IS NULL").select(*left.columns).join(rare, matches).select(*left.columns, *other)
    return met.unionByName(rest)


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of all vectors against codebooks that are learnt on all of them.

    Rows whose vector is null or holds null or non-finite components are left out. Parts that are equal at one position become one
    row with a weight, so copies cost nothing in the rounds. Codebooks start as the parts of the first rows by id (then vector);
    with fewer rows than entries there are fewer entries, and equal entries are kept, the lower one winning. The dimension is that of
    the first vector that can be cut into ``parts``; vectors of any other length get null code and error, and count nothing in their
    label's error. Components are held within a bound (2**27 at 64 dimensions) under which no sum of squares overflows. Null ids
    come last; repeated rows are coded each for itself; null labels are one label; an empty table gives no rows; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    named = columns(vectors, id_col, label_col, vector_col).toDF("vec_id", "label", "v").withColumns({"vec_id": F.col("vec_id").cast("long"), "v": F.col("v").cast("array<double>")})
    named = named.filter(F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    fits = (F.size("v") > 0) & (F.size("v") % parts == 0)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = named.filter(fits).orderBy(*order).limit(1).select(F.size("v")).collect()
    dims = first[0][0] if first else parts
    width = dims // parts
    bound = 1 << int(math.log2(2**62 / dims) / 2 - 1)
    ints = F.transform("v", lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), F.floor(x * scale))).cast("int"))
    same = named.withColumn("v", F.when(F.size("v") == dims, ints))
    table = scratch.numbered(same, "row")
    fit = table.filter("v IS NOT NULL")
    start = fit.orderBy(*order).limit(entries).select("v").collect()
    codebooks = np.array([r.v for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    slices = F.array(*[F.slice("v", p * width + 1, width) for p in range(parts)])
    cut = fit.select("row", "vec_id", "label", F.posexplode(slices).alias("pos", "part"))
    distinct = scratch.keep(cut.groupBy("pos", "part").agg(F.count("*").alias("weight")))
    if len(start):
        codebooks = lloyd(distinct, codebooks, rounds)
    known = scratch.keep(encode_parts(distinct, codebooks))
    joined = join_counted(cut, known, ["pos", "part"], "weight", table.count())
    entry = [F.max(F.when(F.col("pos") == p, F.col("entry"))) for p in range(parts)]
    code = F.lower(F.concat(*[F.lpad(F.hex(e), 2, "0") for e in entry]))
    coded = joined.groupBy("row", "vec_id", "label").agg(code.alias("code"), F.sum("far").alias("error"))
    unfit = table.filter("v IS NULL").select("row", "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = scratch.keep(coded.unionByName(unfit).drop("row"))
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    rows = join_counted(coded, by_label, ["label"], "n", table.count())
    return Codes(rows.select("vec_id", "code", "error", "label_error", F.lit(checksum(codebooks)).alias("codebooks_sha256")), codebooks, scale)


def oracle() -> str:
    """DuckDB SQL for the rows of ``compress_vectors`` over the table of embeddings."""
    floor = lambda a, b: f"({a} - ((({a} % {b}) + {b}) % {b})) // {b}"
    rounds = []
    for k in range(ROUNDS + 1):
        rounds.append(f"""
near{k} AS MATERIALIZED (SELECT vec_id, pos, arg_min(entry, far * {ENTRIES} + entry) AS entry, min(far) AS far FROM (
  SELECT v.vec_id, v.pos, b.entry, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS far FROM cells v JOIN book{k} b ON v.pos = b.pos AND v.c = b.c GROUP BY ALL) GROUP BY ALL)""")
        if k < ROUNDS:
            total, n = "sum(v.x)::BIGINT", "count(v.x)"
            rounds.append(f"""
mean{k} AS (SELECT v.pos, n.entry, v.c, {total} AS s, {n} AS m FROM cells v JOIN near{k} n ON v.vec_id = n.vec_id AND v.pos = n.pos GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT b.pos, b.entry, b.c, CASE WHEN m.m IS NULL THEN b.x ELSE {floor("m.s", "m.m")} END AS x
  FROM book{k} b LEFT JOIN mean{k} m ON b.pos = m.pos AND b.entry = m.entry AND b.c = m.c)""")
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (SELECT vec_id, ((i - 1) * {PARTS} // len(v))::BIGINT AS pos, ((i - 1) % (len(v) // {PARTS}))::BIGINT AS c, floor({SCALE} * v[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT pos, entry, c, x FROM cells JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < {ENTRIES}),
{",".join(rounds)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, sum(far)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY pos, entry, c)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""
