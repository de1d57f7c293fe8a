"""Language ID, word first: known words by log frequency, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, document_fold, map_texts

#: Bounds of the fit: documents and words of each language.
SAMPLE_DOCS = 2000
VOCABULARY = 20_000
#: At most so many languages are learnt, the commonest, and so many numbers of words by pairs of languages.
LANGUAGES = 64
MODEL_NUMBERS = 4_000_000
FOLDS, HELD_OUT = 4, 2
LONGEST = 5
CACHE_WORDS = 300_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between its edge marks; single characters have no marks."""
    marked = word if n == 1 else f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class LanguageModel:
    """Log frequencies by language (one entry each) of words and of n-grams of each length."""

    languages: list[str]
    words: dict[str, tuple[float, ...]]
    grams: list[dict[str, tuple[float, ...]]]
    prior: np.ndarray

    def word_row(self, word: str) -> tuple[float, ...]:
        """A known word's log frequencies, or the mean over its longest n-grams of which any is known."""
        row = self.words.get(word)
        if row is not None:
            return row
        for n in range(LONGEST, 0, -1):
            rows = [r for r in map(self.grams[n].get, grams(word, n)) if r]
            if rows:
                return tuple(sum(column) / len(rows) for column in zip(*rows))
        return (0.0,) * len(self.languages)


def _log_rows(counts: dict[str, dict[str, int]], languages: list[str]) -> dict[str, tuple[float, ...]]:
    """Per item and language the log of its smoothed share, centred over the languages."""
    items = {i for c in counts.values() for i in c}
    totals = np.array([sum(counts.get(lang, {}).values()) for lang in languages], float)
    out = {}
    for item in items:
        n = np.array([counts.get(lang, {}).get(item, 0) for lang in languages], float)
        row = np.log((n + 0.5) / (totals + 0.5 * len(items)))
        out[item] = tuple((row - row.mean()).tolist())
    return out


def build_model(counts: dict[str, dict[str, int]], documents: dict[str, int]) -> LanguageModel:
    languages = sorted(documents)
    tables: list[dict[str, np.ndarray]] = [{}]
    for n in range(1, LONGEST + 1):
        seen: dict[str, dict[str, int]] = {}
        for lang in languages:
            found: dict[str, int] = defaultdict(int)
            for word, k in counts.get(lang, {}).items():
                for g in grams(word, n):
                    found[g] += 1 + int(math.log2(k))
            seen[lang] = found
        tables.append(_log_rows(seen, languages))
    share = np.array([documents[lang] for lang in languages], float)
    return LanguageModel(languages, _log_rows(counts, languages), tables, np.log(share / share.sum()) if len(share) else share)


def fit_languages(docs: DataFrame, sample: int = SAMPLE_DOCS, vocabulary: int = VOCABULARY, languages: int = LANGUAGES) -> LanguageModel:
    """Fit on rows with a language and crc32(doc_id) % 4 other than 2: about ``sample`` documents a language.

    Documents are drawn by the hash of id and text; the commonest ``vocabulary`` words of each language are kept, fewer beyond 14
    languages so that the model stays within ``MODEL_NUMBERS``. Of more than ``languages`` values of lang the commonest are
    learnt (ties: first by name). Null texts and languages are passed over; a null id learns like any outside the fold; repeated
    rows count each and are drawn together; an empty table gives a model without languages; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    learn = named.filter(document_fold(F.col("doc_id"), FOLDS) != HELD_OUT).filter("lang is not null and text is not null")
    common = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    totals = {r.lang: r.n for r in common.collect()}
    if not totals:
        return build_model({}, {})
    vocabulary = min(vocabulary, max(1, MODEL_NUMBERS // len(totals) ** 2))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, int(min(1.0, sample / n) * (1 << 40)))]), F.col("lang"))
    drawn = learn.filter(F.col("lang").isin(list(totals))).filter(F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(23)), 24) <= share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                seen[lang].update(words_of(text))
        for lang, words in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["lang", "word", "n"])

    counted = drawn.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    kept = scratch.keep(counted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= vocabulary))
    counts: dict[str, dict[str, int]] = {lang: {} for lang in totals}
    for r in kept.collect():
        counts[r.lang][r.word] = r.n
    return build_model(counts, totals)


class _Rows(dict):
    """Row numbers of words in a growing table of their log frequencies."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.table = np.zeros((1024, len(model.languages)))

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = self.model.word_row(word)
        self[word] = at
        return at


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, held_out, lang_pred, score) from its whole text.

    score is the share of the predicted language by the words' summed log frequencies and the prior. Null
    texts and those without a letter give ``und`` with 0, as does a model without languages; ties go to
    the first language by name; repeated rows are predicted each; an empty table gives no rows; other
    columns are ignored; a null id is not held out.
    """

    def start():
        rows = _Rows(model)

        def one(text: str | None) -> tuple[str, float]:
            nonlocal rows
            if not model.languages or not has_letter(text):
                return UNKNOWN, 0.0
            if len(rows) > CACHE_WORDS:
                rows = _Rows(model)
            ids = list(map(rows.__getitem__, words_of(text)))
            total = model.prior.copy()
            for at in range(0, len(ids), 65_536):
                total += rows.table[ids[at : at + 65_536]].sum(axis=0)
            best = int(total.argmax())
            return model.languages[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())

        def work(texts: list) -> dict:
            made = [one(t) for t in texts]
            return {"lang_pred": [lang for lang, _ in made], "score": [s for _, s in made]}

        return work

    made = map_texts(docs, id_col, text_col, start, "lang_pred string,score double")
    return made.select("doc_id", (document_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
