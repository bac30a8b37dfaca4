"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from attestry.llm import bpe, impacts, jaccard, merkle, packing, quality, resampling, sanitise, suffixes, toxicity, urls, vamana, warc
from attestry.llm.shared import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.top_vectors(table(spark, sf_dir, "embeddings"))


def op5_vamana(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.nearest(table(spark, sf_dir, "embeddings"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.passages(table(spark, sf_dir, "documents"))


def op11_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.private_documents(table(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_impacts": op4_impacts,
    "op5_vamana": op5_vamana,
    "op6_urls": op6_urls,
    "op7_warc": op7_warc,
    "op8_jaccard": op8_jaccard,
    "op9_packing": op9_packing,
    "op10_passages": op10_passages,
    "op11_sanitise": op11_sanitise,
    "op12_resample": op12_resample,
    "op13_merkle": op13_merkle,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op4_impacts": impacts.TOP_SQL, "op6_urls": urls.VERDICTS_SQL, "op12_resample": resampling.DRAWN_SQL, "op13_merkle": merkle.PROOFS_SQL}
