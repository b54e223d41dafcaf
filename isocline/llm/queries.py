"""The queries opN_<name> with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licences, sql, url_filter, vocab
from .mixing import mix
from .near_dup import near_duplicates
from .packing import pack
from .pivots import near_vectors
from .quality import quality_scores
from .secrets import scan_secrets
from .token_counts import token_counts
from .topk import top_inner_products


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("found")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"), licences.known_digests(spark))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocab.public_path("word_bpe_49k.json"), length=4096, end_id=1)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocab.public_path("byte_bpe_50k.json"), limit=512)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op8_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_secret_scan": op2_secret_scan,
    "op3_url_filter": op3_url_filter,
    "op4_licence_scan": op4_licence_scan,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_top_inner_products": op8_top_inner_products,
    "op9_near_vectors": op9_near_vectors,
    "op10_near_duplicates": op10_near_duplicates,
}
ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": url_filter.ORACLE,
    "op4_licence_scan": licences.ORACLE,
    "op8_top_inner_products": sql.TOP_INNER_PRODUCTS,
    "op9_near_vectors": sql.NEAR_VECTORS,
    "op10_near_duplicates": sql.NEAR_DUPLICATES,
}
