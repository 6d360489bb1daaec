"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilake.llm import alignment, bpe, byte_bpe, centroids, embedding_dup, language_id, license_scan, mixing, near_dup, quality, token_store, toxicity, url_filter
from vigilake.session import table


def op1_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.dedup(table(spark, sf_dir, "documents"))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.dedup(table(spark, sf_dir, "embeddings"))


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"))


def op8_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"))


def op13_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_centroids": op1_language_centroids,
    "op2_host_trust": op2_host_trust,
    "op3_order_minhash": op3_order_minhash,
    "op4_multi_index": op4_multi_index,
    "op5_weak_quality": op5_weak_quality,
    "op6_forced_boundary_bpe": op6_forced_boundary_bpe,
    "op7_token_store": op7_token_store,
    "op8_toxic_grammar": op8_toxic_grammar,
    "op9_source_mixing": op9_source_mixing,
    "op10_license_index": op10_license_index,
    "op11_annulus_clusters": op11_annulus_clusters,
    "op12_prefix_bpe": op12_prefix_bpe,
    "op13_segment_alignment": op13_segment_alignment,
}
ORACLES: dict[str, str] = {
    "op2_host_trust": url_filter.sql(),
    "op4_multi_index": embedding_dup.SQL,
    "op10_license_index": license_scan.sql(),
    "op9_source_mixing": mixing.SQL,
    "op11_annulus_clusters": centroids.sql(),
}
