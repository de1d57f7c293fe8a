from fractions import Fraction

import duckdb
import pandas as pd

from footfall.llm import mixing
from footfall.llm.mixing import DEFAULT, Mix, apply_mix, leaf_budgets, mix_sources

from .cases import awkward


def fill(budget, children):
    """{child: share} by raising all shares together, in exact fractions."""
    given, left, open_ = {}, Fraction(budget), dict(children)
    while open_:
        rate = left / sum(w for _, w in open_.values())
        full = {k: c for k, (c, w) in open_.items() if c <= w * rate}
        if not full:
            return given | {k: w * rate for k, (_, w) in open_.items()}
        for k, c in full.items():
            given[k] = Fraction(c)
            left -= c
            del open_[k]
    return given


def test_budgets_match_plain_filling(spark):
    tree = {("a", "en", "s1"): 100, ("a", "en", "s2"): 5, ("a", "de", "s3"): 40, ("b", "en", "s4"): 3, ("b", "en", "s5"): 2, ("c", "fr", "s6"): 1000, ("c", "fr", "s7"): 1000}
    mix = Mix(domain={"a": 2, "b": 5, "c": 3}, lang={"en": 3}, source={"s7": 4}, share=(1, 3), max_epochs=2)
    leaves = spark.createDataFrame([(*k, v, 1) for k, v in tree.items()], "domain string, lang string, source string, tokens long, docs long")
    made = {(r.domain, r.lang, r.source): r.leaf_budget for r in leaf_budgets(leaves, mix).collect()}
    cap = {k: v * 2 for k, v in tree.items()}
    weight = lambda level, name: getattr(mix, level).get(name, 1)
    budget = sum(tree.values()) // 3
    want = {(): Fraction(budget)}
    for depth, level in enumerate(mixing.LEVELS):
        nxt = {}
        for parent, b in want.items():
            kids = {k[: depth + 1] for k in tree if k[:depth] == parent}
            nxt |= fill(b, {k: (sum(c for q, c in cap.items() if q[: depth + 1] == k), weight(level, k[-1])) for k in kids})
        want = nxt
    assert sum(made.values()) == budget
    assert all(abs(made[k] - want[k]) < len(mixing.LEVELS) + 1 for k in tree) and made[("b", "en", "s4")] == 6 and made[("b", "en", "s5")] == 4


def check(spark, docs, mix, rows):
    out = mix_sources(docs, mix, prefix_rows=4).toPandas()
    assert len(out) == rows
    leaf = out.groupby(["domain", "lang", "source"]).agg(b=("leaf_budget", "first"), taken=("tokens_taken", "sum"), n=("n_tokens", "sum"))
    assert (leaf.b == leaf.taken).all() and (leaf.taken <= leaf.n * mix.max_epochs).all()
    over, under = mix.share
    assert leaf.b.sum() == min(out.n_tokens.sum() * over // under, out.n_tokens.sum() * mix.max_epochs)
    return out


def test_awkward_table(spark):
    docs, rows = awkward(spark)
    for mix in (DEFAULT, Mix(share=(3, 1), max_epochs=4), Mix(share=(9, 1), max_epochs=2), Mix(share=(0, 1))):
        check(spark, docs, mix, len(rows))
    assert mix_sources(docs.limit(0)).collect() == []
    out = mix_sources(docs).toPandas()
    assert "(none)" in set(out.lang) and "(none)" in set(out.source) and out[out.doc_id == 0].n_tokens.tolist() == [1]


def test_sql_equivalent(spark):
    docs, rows = awkward(spark)
    docs = docs.filter("doc_id is not null")
    made = mix_sources(docs).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas().replace("\x00", "", regex=True))
    want = con.sql(mixing.oracle()).df()
    key = ["doc_id", "partial_tokens"]
    a, b = (df[sorted(df.columns)].sort_values(key).reset_index(drop=True) for df in (made, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_apply_repeats_and_drops(spark):
    docs = spark.createDataFrame([(i, "one two three", "en", "src0" if i < 10 else "src1") for i in range(20)], "doc_id long, text string, lang string, source string")
    mix = Mix(domain={"domain0": 3, "domain1": 1}, share=(1, 1), max_epochs=2)
    out = apply_mix(docs, mix)
    assert out.columns == docs.columns
    counts = {s: out.filter(f"source = '{s}'").count() for s in ("src0", "src1")}
    assert counts == {"src0": 15, "src1": 5}


def test_weight_zero_takes_nothing(spark):
    rows = [(i, "w " * (1 + i % 5), "en", f"src{i % 8}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mix_sources(docs, Mix(domain={"domain0": 0, "domain1": 3}, share=(1, 2), max_epochs=1)).collect()
    taken = {}
    for r in out:
        taken[r.domain] = taken.get(r.domain, 0) + r.tokens_taken
    total = sum(r.n_tokens for r in out)
    assert taken["domain0"] == 0 and sum(taken.values()) == total // 2
    everything = mix_sources(docs, Mix(domain={"domain0": 0}, share=(1, 1), max_epochs=1)).collect()
    assert sum(r.tokens_taken for r in everything) == sum(r.n_tokens for r in everything if r.domain != "domain0")
