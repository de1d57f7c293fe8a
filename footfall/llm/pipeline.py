"""Corpus pipeline over ``documents``: quality, near-dedup, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir), keeps working on all rows its predecessor kept, and is written as
Parquet and read again before the next. The stages read the columns doc_id, text, lang, source and n_chars; all but the last return the
columns they were given, whatever those are named. Rows are told apart by a number of their own, so null and repeated ids and repeated rows
count row by row; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, packing, quality, secrets, simhash
from .common import Scratch
from .mixing import ROW

#: Four fifths of the tokens that reach the mix are kept, no document twice; see ``mixing.Mix``.
PIPELINE_MIX = mixing.Mix(domain=mixing.DEFAULT.domain, lang=mixing.DEFAULT.lang, share=(4, 5), max_epochs=1)
#: Near copies: word shingles of so many words, and the Jaccard similarity from which two texts are one.
SHINGLE, SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled rows of ``documents`` as delivered.

    Null and empty texts are scored as texts without words; equal texts are kept or dropped alike; texts of any length count whole.
    """
    labels, known = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("labels", "documents"))
    return quality.keep_quality(docs, quality.fit_quality(known, labels))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of the smallest id, null ids last, then the first row.

    Texts link if their SimHash fingerprints over five-word shingles differ in at most two bits, or if their sets of such
    shingles have a Jaccard similarity of 0.8 or more. Null and empty texts are one group.
    """
    rows = Scratch(spark).numbered(docs, ROW)
    groups = simhash.simhash_dedup(rows, id_col=ROW, shingle=SHINGLE, similarity=SIMILARITY).select(F.col("doc_id").alias(ROW), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first")
    kept = rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id")).join(groups, ROW).groupBy("component_id").agg(first).select(f"first.{ROW}")
    return rows.join(kept.hint("shuffle_hash"), ROW, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their secrets masked and ``n_chars`` counted anew where a text changed; null texts stay null."""
    return secrets.redact_secrets(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their leaf's token budget, in seeded order; the one that the budget would cut is left out.

    So a leaf whose first document exceeds its budget gives none; the README has the share of tokens lost. Null and empty texts
    count one token; null lang or source form leaves of their own.
    """
    return mixing.apply_mix(docs, PIPELINE_MIX)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as of ``packing.pack_documents``; null and empty texts hold only the end id."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, fingerprints and tokenizer are beyond SQL: tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    A stage's input and what it wrote on the way are deleted once its result is written.
    """
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = scratch.mark()
    for _, stage in STAGES[:-1]:
        docs, kept = scratch.write(stage(spark, docs, sf_dir))
        for path in [p for p in scratch.since(begun) if p != kept]:
            scratch.drop(path)
    return STAGES[-1][1](spark, docs, sf_dir)
