"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated by temperature."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns, document_fold, map_texts

#: Bounds of the fit: labelled documents, words with a vector, their dimensions.
SAMPLE_DOCS = 6000
VOCABULARY = 20_000
DIMENSIONS = 64
FOLDS = 5
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
#: Words without a vector stand for themselves, by one of so many index vectors.
STRANGERS = 4096
_SPAN = 65_536


def tokens(text: str | None) -> list[str]:
    """Lower-cased letter runs, digit runs and single signs."""
    return _TOKEN.findall((text or "").lower())


def index_vector(word: str, dimensions: int = DIMENSIONS, ones: int = 4) -> np.ndarray:
    """The sparse random vector of a word, fixed by its hash: ``ones`` entries of +1 and -1."""
    out = np.zeros(dimensions, np.float32)
    digest = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
    for _ in range(ones):
        digest, at = divmod(digest, dimensions)
        digest, sign = divmod(digest, 2)
        out[at] += 1 if sign else -1
    return out


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean, mean square and mean product of neighbours over a document's word vectors, and the share of unknown words."""
    d = vectors.shape[1]
    total = np.zeros(3 * d + 1, np.float64)
    for at in range(0, len(ids), _SPAN):
        part = ids[at : at + _SPAN + 1]
        v = vectors[part]
        own = v[:_SPAN]
        total[:d] += own.sum(axis=0, dtype=np.float64)
        total[d : 2 * d] += np.einsum("ij,ij->j", own, own)
        total[2 * d : 3 * d] += np.einsum("ij,ij->j", v[1:], v[:-1])
        total[-1] += (part[:_SPAN] >= len(vectors) - STRANGERS).sum()
    return (total / max(1, len(ids))).astype(np.float32)


@dataclass
class QualityModel:
    words: dict[str, int]
    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None
    temperature: float
    prior: float

    def features(self, text: str | None) -> np.ndarray:
        found = tokens(text)
        ids = list(map(self.words.get, found))
        if None in ids:
            size = len(self.words)
            ids = [size + zlib.crc32(w.encode("utf-8", "surrogatepass")) % STRANGERS if i is None else i for w, i in zip(found, ids)]
        return pooled(np.array(ids, np.int64), self.vectors)

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(features), self.prior)
        return _sigmoid(_logits((features - self.shift) / self.scale, self.layers) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _logits(x: np.ndarray, layers) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.maximum(x @ w1 + b1, 0) @ w2 + b2


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3):
    """Two layers by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(())]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            xs, ys = x[order[at : at + 128]], y[order[at : at + 128]]
            inner = np.maximum(xs @ w[0] + w[1], 0)
            error = (_sigmoid(inner @ w[2] + w[3]) - ys) / len(xs)
            back = np.outer(error, w[2]) * (inner > 0)
            grads = [xs.T @ back + decay * w[0], back.sum(0), inner.T @ error + decay * w[2], error.sum()]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w[0], w[1], w[2], float(w[3])


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of held-back logits with the least log loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 120))
    loss = [np.mean(np.logaddexp(0, logits / t) - y * logits / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def labelled_sample(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int) -> DataFrame:
    """(text, label, spare): at most ``sample`` labelled rows outside the held-out fold, chosen by their ids' hash."""
    known = columns(labels, "doc_id", "quality").groupBy("doc_id").agg(F.min("quality").alias("label")).filter("label in (0, 1)")
    known = scratch.keep(known.filter(document_fold(F.col("doc_id"), FOLDS) > 0).withColumn("draw", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 24)))
    share = min(1.0, 2 * sample / max(1, known.count()))
    drawn = known.filter(F.col("draw") <= int(share * (1 << 40))).orderBy("draw", "doc_id").limit(sample)
    drawn = drawn.withColumn("spare", F.col("draw") % 5 == 0).drop("draw")
    texts = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    # at most ``sample`` rows of some 20 bytes
    return scratch.keep(texts.join(F.broadcast(drawn), "doc_id").select("text", "label", "spare").repartition(12))


def word_vectors(sample: DataFrame, vocabulary: int, dimensions: int) -> tuple[dict[str, int], np.ndarray]:
    """The commonest words of the sample and the sums of their neighbours' index vectors, to unit length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(tokens(text))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    common = sample.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(vocabulary)
    words = {r.word: i for i, r in enumerate(common.collect())}
    size = len(words)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.zeros((size + 1, dimensions), np.float32)
        for word, at in words.items():
            index[at] = index_vector(word, dimensions)
        sums = np.zeros_like(index)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                ids = np.array([words.get(w, size) for w in tokens(text)], np.int64)
                for at in range(0, len(ids), _SPAN):
                    part = ids[at : at + _SPAN]
                    own = index[part]
                    near = np.zeros_like(own)
                    for gap in (1, 2):
                        near[gap:] += own[:-gap]
                        near[:-gap] += own[gap:]
                    order = np.argsort(part, kind="stable")
                    cut = np.flatnonzero(np.diff(part[order], prepend=-1))
                    sums[part[order][cut]] += np.add.reduceat(near[order], cut, axis=0)
        at = np.flatnonzero(np.abs(sums[:size]).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(list(sums[at]), pa.list_(pa.float32()))], names=["at", "v"])

    parts = sample.select("text").mapInArrow(gather, "at long, v array<float>")
    summed = parts.groupBy("at").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(dimensions)]).alias("v"))
    vectors = np.zeros((size + STRANGERS, dimensions), np.float32)
    for k in range(STRANGERS):
        vectors[size + k] = index_vector(f"\n{k}", dimensions)
    for row in summed.collect():
        vectors[row.at] = row.v
    return words, vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, vocabulary: int = VOCABULARY, dimensions: int = DIMENSIONS) -> QualityModel:
    """Fit on labelled rows with crc32(doc_id) % 5 > 0; only texts are inputs.

    Without both labels among them the model gives the share of label 1 (0.5 if there are none). Labels other than 0 and 1
    and null ids are passed over, of several labels of one id the least counts, rows that repeat an id are learnt each,
    null and empty texts are texts without words, empty tables are allowed; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    chosen = labelled_sample(docs, labels, scratch, sample)
    words, vectors = word_vectors(chosen, vocabulary, dimensions)
    size = 3 * dimensions + 1
    model = QualityModel(words, vectors, np.zeros(size), np.ones(size), None, 1.0, 0.5)

    def feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float32())), batch.column("label"), batch.column("spare")], names=["x", "label", "spare"])

    kind = chosen.schema["label"].dataType.simpleString()
    rows = sorted(chosen.mapInArrow(feature, f"x array<float>, label {kind}, spare boolean").collect(), key=lambda r: (r.label, r.x))
    y = np.array([r.label for r in rows], np.float64)
    if not len(rows) or y.min() == y.max():
        model.prior = float(y.mean()) if len(rows) else 0.5
        return model
    x = np.array([r.x for r in rows], np.float64)
    spare = np.array([r.spare for r in rows])
    learn = ~spare if 0 < y[~spare].mean() < 1 else np.ones(len(y), bool)
    model.shift, model.scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-4
    model.layers = fit_network((x[learn] - model.shift) / model.scale, y[learn])
    check = spare if spare.any() else learn
    model.temperature = fit_temperature(_logits((x[check] - model.shift) / model.scale, model.layers), y[check])
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted) from its whole text.

    Null and empty texts are scored as documents without words; equal texts score the same; repeated rows
    are scored each; an empty table gives no rows; other columns are ignored; a null id is not held out.
    """

    def start():
        def work(texts: list) -> dict:
            return {"score": model.scores(np.array([model.features(t) for t in texts], np.float64))}

        return work

    scored = map_texts(docs, id_col, text_col, start, "score double")
    return scored.select("doc_id", (document_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text the model accepts, with all their columns."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.scores(np.array([model.features(t) for t in texts], np.float64)) if len(texts) else [], dtype="float64")

    return docs.filter(score(F.col(f"`{text_col}`")) >= threshold)
