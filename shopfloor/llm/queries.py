"""The registered queries of the subpackage, over the tables of a folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir
from . import (decontaminate, grid_join, html_blocks, jaccard_join, language, licenses, packing, preferences, quality,
               resample, spelling, token_counts, token_files)
from .ship import ship
from .tokens import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.digest(packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.expr("crc32(cast(doc_id AS string)) % 3 = 1").alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = preferences.echo_pairs(_table(spark, sf_dir, "conversations"))
    return preferences.digest(preferences.format_pairs(chosen, rejected))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.similarity_classes(_table(spark, sf_dir, "embeddings"), similarity=0.9)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(_table(spark, sf_dir, "pages"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(_table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_files.digest(token_files.read(spark, folder))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10,
                             min_words=20, ngram=1, buckets=10_000, seed=2024)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs)).select(
        "doc_id", F.expr("crc32(cast(doc_id AS string)) % 3 = 1").alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (
    op1_pack_sequences, op2_quality_classifier, op3_preference_pairs, op4_decontamination, op5_token_counts,
    op6_license_scan, op7_embedding_dedup, op8_html_extraction, op9_token_files, op10_jaccard_join,
    op11_spelling_variants, op12_importance_resampling, op13_language_id)}
ORACLE_SQL: dict[str, str] = {"op3_preference_pairs": preferences.ECHO_SQL, "op11_spelling_variants": spelling.SPELLING_SQL,
                              "op12_importance_resampling": resample.RESAMPLE_SQL}
