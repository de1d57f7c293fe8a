import random
import re

import numpy as np
import xxhash

from footfall.llm.common import Scratch
from footfall.llm.components import connected_components
from footfall.llm.simhash import close_links, fingerprint, simhash_dedup


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, close):
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and close(a, b):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_fingerprint_matches_definition():
    cases = [None, "", " \n", "One", "one two", "a b c", "ÀÉ İx a\x0bb  c\x1cd e f", "Z " * 70000, "x y z w " * 9]
    for text in cases[:-2] + [cases[-1]]:
        assert fingerprint(text) == plain_fingerprint(text), text
    assert fingerprint(cases[-2]) == xxhash.xxh64(b"z z z", seed=42).intdigest()


def test_components_match_plain_union(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (900, 901), (900, 902), (900, 903)]
    rows = spark.createDataFrame(pairs, "a long, b long")
    made = {r.node: r.component for r in connected_components(rows, Scratch(spark)).collect()}
    linked = set(map(frozenset, pairs))
    want = classes(sorted({x for p in pairs for x in p if len(set(p)) > 1}), lambda a, b: frozenset((a, b)) in linked)
    assert made == want
    assert connected_components(rows.limit(0), Scratch(spark)).count() == 0


def test_blocks_lose_no_link_even_when_split(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 260:
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    fps |= {rng.getrandbits(64) for _ in range(60)}
    low = rng.getrandbits(64) >> 7 << 7
    fps |= {low | x for x in range(100)}
    ids = {i: f for i, f in enumerate(sorted(fps))}
    reps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in ids.items()], "fp long, rep long")
    want = classes(list(ids), lambda a, b: (ids[a] ^ ids[b]).bit_count() <= 2)
    for rows in (512, 16):
        scratch = Scratch(spark)
        links = close_links(reps, scratch, block_rows=rows)
        made = {r.node: r.component for r in connected_components(links, scratch).collect()}
        assert {i: made.get(i, i) for i in ids} == want


def test_whole_operator_with_nulls_ties_copies_and_clashing_columns(spark):
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(1)
    base = " ".join(rng.choices(words, k=3000))
    texts = [base, base, base.replace("w7 ", "w8 ", 1), "", None, " \t", "one", "ONE", "other " * 30000] + [" ".join(rng.choices(words, k=50)) for _ in range(30)]
    rows = [(10 + i, t, i, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, rep string, component_id int")
    out = {r.doc_id: r for r in simhash_dedup(docs).collect()}
    fps = {i: plain_fingerprint(t) if t is None or len(t) < 100000 else fingerprint(t) for i, t, *_ in rows}
    want = classes(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {i: int(r.fingerprint, 16) for i, r in out.items()} == fps
    assert {i: r.component_id for i, r in out.items()} == want
    assert {i for i, r in out.items() if r.kept} == set(want.values())
    assert out[13].component_id == out[14].component_id == 13 and np.unique([out[i].component_id for i in (16, 17)]).size == 1
    assert simhash_dedup(docs.limit(0)).collect() == []


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t u")], "doc_id long, text string")
    out = simhash_dedup(docs).collect()
    assert len(out) == 4 and sorted(r.component_id or -1 for r in out) == [-1, 1, 1, 1]
