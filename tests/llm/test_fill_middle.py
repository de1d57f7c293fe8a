import hashlib
import random
import re

import duckdb
import pytest

from footfall.llm.fill_middle import Rope, digest, fill_middle, oracle, rearrange, restore, restored

from .cases import awkward

AWKWARD = ["<P>x", "y<S>", "<M>", "<", "S><P", "<<M", "P>P><", "a<P", "é😀\r\n", "<S" * 40, ">" * 9]


def height_is_right(rope):
    if rope.left is None:
        return 0
    a, b = height_is_right(rope.left), height_is_right(rope.right)
    assert abs(a - b) <= 1 and rope.height == 1 + max(a, b)
    assert rope.units == rope.left.units + rope.right.units and rope.chars == rope.left.chars + rope.right.chars
    return rope.height


@pytest.mark.parametrize("unit", [None, r"\w+\W*", r"[^\n]*\n?"])
def test_ropes_split_and_join(unit):
    rng = random.Random(5)
    for _ in range(150):
        text = "".join(rng.choices("ab \n😀é", k=rng.randrange(0, 300)))
        whole = Rope.of(text, unit, leaf=rng.choice((1, 3, 16)))
        assert str(whole) == text and whole.chars == len(text)
        height_is_right(whole)
        starts = range(len(text)) if unit is None else [m.start() for m in re.finditer(unit, text, re.DOTALL) if m.group()]
        starts = [0, *starts[1:]] if text else []
        assert whole.units == len(starts)
        k = rng.randrange(whole.units + 1)
        at = starts[k] if k < len(starts) else len(text)
        a, b = whole.split(k)
        assert (str(a), str(b), a.units, b.units) == (text[:at], text[at:], k, whole.units - k)
        height_is_right(b + a)
        assert str(b + a) == text[at:] + text[:at]
        c = rng.randrange(len(text) + 1)
        a, b = whole.split(c, "chars")
        assert (str(a), str(b)) == (text[:c], text[c:])
        height_is_right(a)
        height_is_right(b)


def test_joins_of_unequal_ropes_stay_balanced():
    rng = random.Random(2)
    rope, text = Rope.of(""), ""
    for _ in range(400):
        more = "x" * rng.choice((1, 2, 900))
        rope, text = (rope + Rope.of(more, leaf=4), text + more) if rng.random() < 0.5 else (Rope.of(more, leaf=4) + rope, more + text)
        if rng.random() < 0.2:
            rope = rope.split(k := rng.randrange(len(text) + 1))[1]
            text = text[k:]
    height_is_right(rope)
    assert str(rope) == text


def test_round_trip_with_near_sentinels():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choices(["<", "S>", "P", "M", ">", "<S", "é", " "], k=rng.randrange(1, 30)))
        form = rng.choice(("psm", "spm"))
        if any(s in text for s in ("<P>", "<S>", "<M>")):
            form = "plain"
        output, n, p, m = rearrange(text, (rng.randrange(2**32), rng.randrange(2**32)), form)
        assert n == len(text) and restore(output, form) == text
        if form != "plain":
            assert len(output) == n + 9 and 0 <= p and p + m <= n


def plain(key, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return key, n, "plain", None, None, text, text
    if h4 % 100 < 20:
        return key, n, "spm", a, b - a, "<S>" + s + "<P>" + p + "<M>" + m, text
    return key, n, "psm", a, b - a, "<P>" + p + "<S>" + s + "<M>" + m, text


def test_documents(spark):
    docs, rows = awkward(spark, AWKWARD * 9)
    want = sorted((plain(r[0], r[1]) for r in rows), key=repr)
    made = restored(fill_middle(docs))
    assert sorted(map(tuple, made.collect()), key=repr) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = digest(made).toPandas()
    assert sorted(got["output_sha256"]) == sorted(sha(r[5]) for r in want) and sorted(got["restored_sha256"]) == sorted(sha(r[6]) for r in want)
    documents = docs.select("doc_id", "text").toArrow()  # noqa: F841
    theirs = duckdb.sql(oracle()).df()
    order = lambda f: sorted(f[sorted(f.columns)].astype(str).itertuples(index=False, name=None))
    number = {c: "Int64" for c in ("doc_id", "prefix_chars", "middle_chars")}
    assert order(got.astype(number)) == order(theirs.astype(number))
    assert fill_middle(docs.limit(0)).collect() == []


def test_words_as_units(spark):
    docs = spark.createDataFrame([(k, "one  two, three\nfour ") for k in range(60)], "doc_id long, text string")
    for r in restored(fill_middle(docs, unit=r"\w+\W*")).collect():
        assert r.n == 4 and r.restored == "one  two, three\nfour "
        if r.form != "plain":
            assert r.prefix_chars in (0, 5, 10, 16, 21) and r.prefix_chars + r.middle_chars in (0, 5, 10, 16, 21)
