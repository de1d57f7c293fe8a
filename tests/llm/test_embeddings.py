import duckdb
import numpy as np
import pytest

from footfall.llm.itq_dedup import choose_index, embedding_dedup, encode, index_recall, learn_rotation, oracle, pairs_at

from .test_simhash import classes


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def cloud(seed=0, dims=32):
    rng = np.random.default_rng(seed)
    lone = unit(rng.normal(size=(150, dims)))
    centre = unit(rng.normal(size=dims))
    group = unit(centre + 0.017 * rng.normal(size=(60, dims)))
    chain = [unit(rng.normal(size=dims))]
    side = unit(rng.normal(size=dims))
    for _ in range(12):
        chain.append(unit(chain[-1] + 0.2 * side))
    return np.concatenate([lone, group, chain]).astype(np.float32)


def want(vectors):
    x = unit(vectors.astype(np.float64))
    near = x @ x.T >= 0.95
    return near.sum(axis=1) - 1, classes(list(range(len(x))), lambda a, b: near[a, b])


def test_rotation_is_orthonormal_and_codes_balanced():
    x = unit(np.random.default_rng(1).normal(size=(500, 32)) * np.linspace(0.2, 1, 32))
    codes = learn_rotation(x)
    assert np.allclose(codes.rotation.T @ codes.rotation, np.eye(32))
    assert 0.35 < (codes.project(x) >= 0).mean() < 0.65
    code, keys = encode(x, codes, 10)
    assert len(code) == 500 and keys.shape == (500, 32) and len({*keys[0].tolist()}) == 32


def test_links_match_all_pairs_also_in_small_blocks(spark):
    x = cloud()
    links, label = want(x)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    for block in (2048, 16):
        out = {r.vec_id: r for r in embedding_dedup(table, block=block).collect()}
        assert {i: out[i].n_links for i in out} == dict(enumerate(links.tolist()))
        assert {i: out[i].component_id for i in out} == label
        assert all(out[i].kept == (label[i] == i) for i in out)


@pytest.mark.parametrize("dims", [32, 64, 128])
@pytest.mark.parametrize("rows", [10**4, 10**7, 10**10])
def test_recall_holds_as_keys_widen(dims, rows):
    x = unit(np.random.default_rng(dims).normal(size=(2000, dims)))
    index = choose_index(x, rows)
    assert index.width >= min(0.7 * np.log2(rows), dims) and index_recall(index, x[1::2], 0.951) >= 0.975
    code, keys = index.encode(x[:50])
    assert keys.shape == (50, len(index.rotations) * 4 << index.flips) and all(len(set(k)) == len(k) for k in keys.tolist())
    assert np.allclose(np.einsum("ij,ij->i", x, pairs_at(x, 0.951)), 0.951)


def test_exact_mode_finds_all_also_in_one_hot_bucket(spark):
    x = cloud(seed=3, dims=8)
    links, label = want(x)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for block in (2048, 24):
        out = {r.vec_id: r for r in embedding_dedup(table, block=block, exact=True).collect()}
        assert {i: (r.n_links, r.component_id) for i, r in out.items()} == {i: (int(n), label[i]) for i, n in enumerate(links)}


def test_bad_vectors_copies_and_repeats(spark):
    v, w = [1.0, 2.0, 3.0, 0.5], [-3.0, 1.0, 0.2, 9.0]
    rows = [
        (1, v), (2, v), (3, [2 * c for c in v]), (4, None), (5, []), (6, [0.0] * 4), (7, [1.0, None, 3.0, 0.5]), (8, [1.0, float("nan"), 3.0, 0.5]),
        (9, [1.0, float("inf"), 3.0, 0.5]), (10, v[:3]), (11, w), (11, w), (12, [-c for c in v]), (None, v), (13, [c * 1e-30 for c in w]),
    ]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, unit string, copies int")
    out = embedding_dedup(table).collect()
    assert len(out) == len(rows)
    found = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in out)
    assert found == sorted([(1, 2, 1), (2, 2, 1), (3, 2, 1), *[(k, 0, k) for k in range(4, 11)], (11, 2, 11), (11, 2, 11), (12, 0, 12), (0, 0, 0), (13, 2, 11)])
    assert embedding_dedup(table.limit(0)).collect() == []
    assert embedding_dedup(table.filter("vec_id in (4, 5)")).count() == 2


def test_one_id_with_several_vectors(spark):
    v, w = [1.0, 2.0, 3.0, 0.5], [-3.0, 1.0, 0.2, 9.0]
    table = spark.createDataFrame([(5, v), (5, w), (6, v), (7, w), (8, [9.0, 0.0, 0.0, -1.0])], "vec_id long, embedding array<double>")
    out = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup(table).collect())
    assert out == [(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5), (8, 0, 8)]


def test_sql_equivalent():
    x = cloud()
    links, label = want(x)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [(i, v.tolist()) for i, v in enumerate(x)])
    rows = con.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({oracle()}) ORDER BY vec_id").fetchall()
    assert rows == [(i, int(links[i]), label[i], label[i] == i) for i in range(len(x))]
