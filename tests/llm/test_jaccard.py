import random

import numpy as np
import pytest

from footfall.llm.common import Scratch
from footfall.llm.components import connected_components
from footfall.llm.groups import group_links
from footfall.llm.jaccard import BANDS, minima, shared, similar, similar_links
from footfall.llm.simhash import fingerprint, shingle_hashes, simhash_dedup

from .test_simhash import classes

WORDS = [f"w{i}" for i in range(600)]


def word_sets(text, size=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    words = [w for part in words for w in part.split() if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


def copies(seed=4, n=150):
    rng = random.Random(seed)
    made = []
    for size in (60, 200, 1500):
        base = " ".join(rng.choices(WORDS, k=size))
        made += [edited(rng, base, rng.choice((0.005, 0.01, 0.02, 0.05))) for _ in range(n // 3)]
    return made + [" ".join(rng.choices(WORDS, k=80)) for _ in range(40)] + [None, "", "one two", "one two", "w1 w2 w3 w4 w5"]


def test_shared_counts_and_similarity():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, size=rng.integers(1, 30))).astype(np.uint64) for _ in range(30)] + [np.array([99], np.uint64)]
    both, near = shared(sets), similar(sets, 0.5)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            x, y = set(a.tolist()), set(b.tolist())
            assert both[i, j] == len(x & y) and near[i, j] == (jaccard(x, y) >= 0.5)


def test_pairs_at_the_threshold_share_a_band():
    rng = np.random.default_rng(6)
    hit, agree = 0, []
    for _ in range(400):
        items = rng.integers(0, 1 << 63, size=900, dtype=np.uint64)
        (a, x), (b, y) = minima(items[:810]), minima(np.concatenate([items[90:]]))
        hit += any(p == q for p, q in zip(a, b))
        agree.append(sum(p == q for p, q in zip(x, y)) / len(x))
    assert len(a) == BANDS and hit >= 394 and abs(np.mean(agree) - 0.8) < 0.02
    assert minima(np.zeros(0, np.uint64))[0] == []


@pytest.mark.parametrize("block", [512, 8])
def test_links_close_like_all_pairs_also_in_hot_groups(spark, block):
    texts = dict(enumerate(copies()))
    rows = [(i, *minima(np.unique(shingle_hashes(t, 5)))) for i, t in texts.items()]
    nodes = spark.createDataFrame([(i, k, bytearray(m)) for i, k, m in rows], "node long, bands array<long>, signature binary")
    docs = spark.createDataFrame(list(texts.items()), "node long, text string")
    scratch = Scratch(spark)
    made = {r.node: r.component for r in connected_components(similar_links(nodes, docs, lambda t: shingle_hashes(t, 5), scratch, 0.8, block), scratch).collect()}
    sets = {i: word_sets(t) for i, t in texts.items()}
    want = classes(list(texts), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    assert {i: made.get(i, i) for i in texts} == want and len(set(want.values())) < 140


def test_operator_with_a_similarity(spark):
    texts = dict(enumerate(copies(seed=9, n=60)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in simhash_dedup(docs, shingle=5, similarity=0.8).collect()}
    sets, prints = {i: word_sets(t) for i, t in texts.items()}, {i: fingerprint(t, 5) for i, t in texts.items()}
    assert out == classes(list(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2 or jaccard(sets[a], sets[b]) >= 0.8)
    assert simhash_dedup(docs.limit(0), similarity=0.8).collect() == []


def test_hot_groups_meet_through_pivots_and_blocks(spark):
    """Numbers link when they differ by one: the closure in a group is that of all pairs, whatever the block."""
    groups = {1: list(range(0, 300)), 2: [1000 + 3 * i for i in range(120)], 3: [5000, 5001, 5003]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "key long, node long")

    def find(cells):
        left, right = cells.select("cell", cells.node.alias("a"), cells.asks.alias("x")), cells.select("cell", cells.node.alias("b"), cells.asks.alias("y"))
        return left.join(right, "cell").filter("a < b and b - a = 1 and (x or y)").select("a", "b").distinct()

    scratch = Scratch(spark)
    made = {r.node: r.component for r in connected_components(group_links(rows, "key", "node", find, scratch, 16, 4), scratch).collect()}
    nodes = [v for vs in groups.values() for v in vs]
    assert {v: made.get(v, v) for v in nodes} == classes(nodes, lambda a, b: abs(a - b) == 1)
