import hashlib
import math
import random

import duckdb
import numpy as np

from footfall.llm import vector_codes
from footfall.llm.vector_codes import compress_vectors, oracle


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract in plain whole numbers: rows of (id, vector, label)."""
    kept = [(i, [math.floor(4096 * float(x)) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda c, p: min((far(c[p], e), k) for k, e in enumerate(books[p]))[::-1]
    for _ in range(rounds):
        for p in range(parts):
            to = [nearest(c, p)[0] for c in cut]
            for e in set(to):
                own = [c[p] for c, t in zip(cut, to) if t == e]
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = [[nearest(c, p) for p in range(parts)] for c in cut]
    errors = [sum(e for _, e in f) for f in found]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by = {}
    for (_, _, y), e in zip(kept, errors):
        by[y] = by.get(y, 0) + e
    return [(i, "".join(f"{e:02x}" for e, _ in f), err, by[y], sha) for (i, _, y), f, err in zip(kept, found, errors)]


def rows_of(seed, n, dims=16, spread=1.0):
    rng = random.Random(seed)
    some = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(max(3, n // 3))]
    return [(i, list(map(float, np.float32(rng.choice(some) if rng.random() < 0.6 else [rng.gauss(0, spread) for _ in range(dims)]))), rng.choice([None, 0, 1, 2])) for i in rng.sample(range(10 * n), n)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_codes_equal_a_plain_version(spark):
    copy = [0.25] * 16
    awkward = [(-3, None, 1), (-2, [None] * 16, 1), (-1, [float("nan")] + [0.0] * 15, 1), (None, [float("-inf")] + [0.0] * 15, None)]
    for rows in (rows_of(1, 200) + awkward, rows_of(2, 9), [(k, copy, k % 2) for k in range(40)], rows_of(3, 60, spread=200.0) + [(None, copy, None), (5, copy, 1), (5, copy, 1)]):
        got = compress_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5)).rows
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows), key=repr)


def test_sql_and_decoding(spark):
    rows = rows_of(8, 150, dims=64)
    made = compress_vectors(spark.createDataFrame(rows, SCHEMA))
    got = made.rows.toPandas()
    embeddings = spark.createDataFrame(rows, SCHEMA).toPandas()  # noqa: F841
    theirs = duckdb.sql(oracle()).df()[list(got.columns)]
    order = lambda f: sorted(f.itertuples(index=False, name=None))
    assert order(got) == order(theirs)
    vectors = {i: v for i, v, _ in rows}
    for r in got.head(20).itertuples():
        gap = np.floor(4096 * np.array(vectors[r.vec_id])) - 4096 * made.decode(r.code)
        assert int((gap**2).sum()) == r.error


def test_hot_keys_and_odd_tables(spark, monkeypatch):
    rows = rows_of(4, 120)
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 4)  # some keys by broadcast, some by shuffle
    got = compress_vectors(spark.createDataFrame(rows, SCHEMA)).rows
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows), key=repr)
    clash = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA + ", pos int, part string, row long, weight long")
    assert sorted(map(tuple, compress_vectors(clash).rows.collect()), key=repr) == sorted(plain(rows), key=repr)
    assert compress_vectors(clash.limit(0)).rows.collect() == []


def test_other_lengths_and_huge_components(spark):
    rows = rows_of(6, 40)
    odd = [(-9, [], 1), (10_000, [1.0] * 15, 1), (10_001, [1.0] * 24, None)]
    got = {r.vec_id: r for r in compress_vectors(spark.createDataFrame(rows + odd, SCHEMA)).rows.collect()}
    assert all(got[i].code is None and got[i].error is None for i, _, _ in odd)
    want = {r[0]: r for r in plain(rows)}
    assert all(tuple(got[i]) == want[i] for i in want)
    huge = compress_vectors(spark.createDataFrame([*rows, (10_000, [3e38] * 16, 1), (10_001, [-3e38] * 16, 1)], SCHEMA)).rows.collect()
    assert len(huge) == 42 and all(r.error >= 0 for r in huge)
    assert all(r.code is None for r in compress_vectors(spark.createDataFrame([(1, [1.0], 1), (2, [], 1)], SCHEMA)).rows.collect())
