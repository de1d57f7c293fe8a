import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from footfall.llm.langid import fit_languages, grams, has_letter, predict_languages
from footfall.llm.quality import SAMPLE_DOCS, fit_network, fit_quality, fit_temperature, index_vector, keep_quality, pooled, score_quality, tokens

from .cases import awkward

SYLLABLES = {"aa": ["lo", "mi", "ta", "ne"], "bb": ["zur", "kech", "pfa", "gur"], "cc": ["oux", "eau", "ière", "ez"]}


def language_rows(n=240, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randrange(2, 6))) for _ in range(rng.randrange(5, 40))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_grams_back_off_in_length():
    assert grams("ab", 5) == [] and grams("ab", 4) == ["^ab$"] and grams("ab", 1) == ["a", "b"]
    assert has_letter("1a") and has_letter("漢") and not has_letter("12 ½² _") and not has_letter(None)


def test_languages_of_unseen_words(spark):
    rows = language_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, score string, n int")
    model = fit_languages(docs, vocabulary=30)
    assert model.languages == ["aa", "bb", "cc"] and len(model.words) <= 90
    out = {r.doc_id: r for r in predict_languages(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in out.items() if r.held_out} == {r[0] for r in held}
    assert np.mean([out[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    swapped = spark.createDataFrame([(i, t, "aa" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    again = fit_languages(swapped, vocabulary=30)
    assert again.words == model.words and (again.prior == model.prior).all()


def test_language_cases(spark):
    docs, rows = awkward(spark, ["12 ½ _", "漢字"])
    model = fit_languages(docs)
    out = predict_languages(docs, model).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for key, text, *_ in rows:
        assert (by[key].lang_pred == "und") == (not has_letter(text)) and (has_letter(text) or by[key].score == 0)
    assert predict_languages(docs.limit(0), model).collect() == []
    none = fit_languages(docs.limit(0))
    assert {r.lang_pred for r in predict_languages(docs, none).collect()} == {"und"}


def test_pooling_and_vectors():
    assert tokens("Ab1 ab. _é") == ["ab", "1", "ab", ".", "_", "é"] and tokens(None) == []
    assert (index_vector("a") == index_vector("a")).all() and np.abs(index_vector("a")).sum() <= 4
    vectors = np.random.default_rng(0).normal(size=(5000, 8)).astype(np.float32)
    ids = np.random.default_rng(1).integers(0, 5000, 200_000)
    v = vectors[ids].astype(np.float64)
    made = pooled(ids, vectors)
    assert np.allclose(made[:8], v.mean(0), atol=1e-4) and np.allclose(made[8:16], (v * v).mean(0), atol=1e-3)
    assert np.allclose(made[16:24], (v[1:] * v[:-1]).sum(0) / len(ids), atol=1e-3) and made[24] > 0.7
    assert not pooled(np.array([], np.int64), vectors).any()


def test_temperature_fits():
    rng = np.random.default_rng(0)
    logits = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert abs(fit_temperature(3 * logits, y) - 3) < 0.5
    x = rng.normal(size=(400, 5))
    w1, b1, w2, b2 = fit_network(x, (x[:, 0] > 0).astype(float))
    assert np.mean(((np.maximum(x @ w1 + b1, 0) @ w2 + b2) > 0) == (x[:, 0] > 0)) > 0.95


def quality_tables(spark, n=400):
    rng = random.Random(5)
    texts, marks = [], []
    for i in range(n):
        words = ["".join(rng.choices(SYLLABLES["aa"] + SYLLABLES["bb"], k=3)) for _ in range(30)]
        good = i % 4 > 0
        texts.append(" ".join(words) if good else " ".join(w for w in words[:6] for _ in range(5)))
        marks.append(int(good))
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, label int, score double")
    return docs, spark.createDataFrame([(i, q, 0, "x") for i, q in enumerate(marks)], "doc_id long, quality int, toxic int, text string"), texts, marks


def test_quality_held_out(spark):
    docs, labels, texts, marks = quality_tables(spark)
    model = fit_quality(docs, labels)
    out = {r.doc_id: r for r in score_quality(docs, model).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in out.items() if r.held_out} == set(held)
    assert np.mean([out[i].predicted == marks[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    wrong = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    again = fit_quality(docs, wrong)
    assert np.allclose(again.scores(np.array([again.features(t) for t in texts])), model.scores(np.array([model.features(t) for t in texts])))
    kept = keep_quality(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.predicted}


def test_quality_cases(spark):
    docs, labels, *_ = quality_tables(spark, 60)
    model = fit_quality(docs, labels)
    odd, rows = awkward(spark)
    out = score_quality(odd, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[0] == by[1] == by[2] and by[4] == by[5]
    assert score_quality(odd.limit(0), model).collect() == []
    assert {r.score for r in score_quality(odd, fit_quality(docs, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in score_quality(odd, fit_quality(docs, labels.filter("quality = 1"))).collect()} == {1.0}
    assert SAMPLE_DOCS == 6000


SF = "/root/testdata/sf0.001"


def test_language_scores_against_a_plain_version(spark):
    """Every document of the smallest table, scored word by word with dictionaries."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_languages(docs)
    learnt = [r for r in docs.collect() if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    counts = {}
    for r in learnt:
        for w in re.findall(r"[^\W\d_]+", r.text.lower()):
            counts.setdefault(r.lang, Counter())[w] += 1
    langs = sorted({r.lang for r in learnt})
    top = {x: {w: n for n, w in sorted(((n, w) for w, n in counts[x].items()), key=lambda p: (-p[0], p[1]))[:20_000]} for x in langs}
    marked = lambda w, n: w if n == 1 else f"^{w}$"
    pieces = lambda w, n: [marked(w, n)[i : i + n] for i in range(len(marked(w, n)) - n + 1)]

    def rows(held):
        items = {i for x in langs for i in held[x]}
        totals = {x: sum(held[x].values()) for x in langs}
        out = {}
        for i in items:
            row = [math.log((held[x].get(i, 0) + 0.5) / (totals[x] + 0.5 * len(items))) for x in langs]
            out[i] = [v - sum(row) / len(row) for v in row]
        return out

    word_rows = rows(top)
    assert set(model.words) == set(word_rows)
    assert all(np.allclose(model.words[w], word_rows[w]) for w in list(word_rows)[:500])
    prior = [math.log(sum(r.lang == x for r in learnt) / len(learnt)) for x in langs]
    out = {r.doc_id: r for r in predict_languages(docs, model).collect()}
    for r in docs.collect():
        total = list(prior)
        for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            row = word_rows.get(w)
            n = 5
            while row is None and n:
                held = [model.grams[n][g] for g in pieces(w, n) if g in model.grams[n]]
                row = [sum(c) / len(held) for c in zip(*held)] if held else None
                n -= 1
            total = [a + b for a, b in zip(total, row or [0] * len(langs))]
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        share = 1 / sum(math.exp(max(-700, v - total[best])) for v in total)
        assert out[r.doc_id].lang_pred == langs[best] and abs(out[r.doc_id].score - share) < 1e-6
    pred = [(out[r.doc_id].lang_pred, r.lang) for r in docs.collect() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(a == b for a, b in pred) >= 0.95 * len(pred)


def test_many_languages_are_bounded(spark):
    rows = [(i, f"word{i % 90} other{i % 90}", f"l{i % 90:02d}") for i in range(900)] + [(1000 + i, "common words", "aa") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs, languages=20)
    assert len(model.languages) == 20 and "aa" in model.languages
    assert {r.lang_pred for r in predict_languages(docs, model).collect()} <= set(model.languages)


def test_quality_scores_against_a_plain_version(spark):
    """Every document of the smallest table, with its features and layers worked out term by term."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    w1, b1, w2, b2 = model.layers
    out = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    assert len(out) == docs.count()
    for r in docs.collect():
        words = re.findall(r"[^\W\d_]+|\d+|[^\w\s]|_", (r.text or "").lower())
        size = len(model.words)
        ids = [model.words.get(w, size + zlib.crc32(w.encode()) % 4096) for w in words]
        vectors = [model.vectors[i].astype(float) for i in ids]
        zero = np.zeros(model.vectors.shape[1])
        n = max(1, len(ids))
        mean, square = sum(vectors, zero) / n, sum((v * v for v in vectors), zero) / n
        beside = sum((a * b for a, b in zip(vectors, vectors[1:])), zero) / n
        x = np.concatenate([mean, square, beside, [sum(i >= size for i in ids) / n]])
        hidden = [max(0.0, sum(float(a) * float(b) for a, b in zip((x - model.shift) / model.scale, w1[:, k])) + float(b1[k])) for k in range(len(b1))]
        logit = (sum(h * float(w) for h, w in zip(hidden, w2)) + b2) / model.temperature
        assert abs(out[r.doc_id] - 1 / (1 + math.exp(-min(60, max(-60, logit))))) < 1e-3
