"""The registered queries opN_* over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_itq_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .itq_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secrets_digest

    return secrets_digest(table(spark, sf_dir, "documents"))


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiff_media import media_digest, store_texts

    return media_digest(store_texts(table(spark, sf_dir, "documents")))


def op4_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_dedup

    return simhash_dedup(table(spark, sf_dir, "documents"))


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    made = shard_by_bytes(table(spark, sf_dir, "documents"))
    return made.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_languages, predict_languages

    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, fit_languages(docs))


def op9_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotes import link_quotes

    return link_quotes(table(spark, sf_dir, "conversations"))


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress_vectors

    return compress_vectors(table(spark, sf_dir, "embeddings")).rows


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import digest, fill_middle, restored

    return digest(restored(fill_middle(table(spark, sf_dir, "documents"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_itq_embedding_dedup, op2_secret_scan, op3_tiff_pages, op4_quality_scores, op5_mix_sources,
        op6_simhash_dedup, op7_minimax_shards, op8_language_id, op9_quote_links, op10_pack_sequences, op11_token_counts,
        op12_vector_codes, op13_fill_middle, pipeline,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    from . import fill_middle, itq_dedup, mixing, quotes, vector_codes

    return {
        "op1_itq_embedding_dedup": itq_dedup.oracle(), "op5_mix_sources": mixing.oracle(), "op9_quote_links": quotes.oracle(),
        "op12_vector_codes": vector_codes.oracle(), "op13_fill_middle": fill_middle.oracle(),
    }
