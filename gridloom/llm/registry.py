"""Queries over the llm operators, at production parameters and over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from gridloom.llm import oracle
from gridloom.sources.tables import table
from gridloom.llm.decontaminate import contaminated
from gridloom.llm.fill_middle import fill_middle_digests
from gridloom.llm.mixing import mix_sources
from gridloom.llm.near_dup import near_duplicates
from gridloom.llm.packing import pack
from gridloom.llm.quality import quality_signals
from gridloom.llm.secrets import find_secrets
from gridloom.llm.substring_dedup import remove_repeats
from gridloom.llm.token_count import count_tokens
from gridloom.llm.token_file import read_token_files, write_token_files
from gridloom.llm.url_filter import filter_urls
from gridloom.llm.vector_codes import compress
from gridloom.llm.vector_search import top_k

URL_RULES = {
    "com/en/": "block",
    "example.com/en/7": "allow",
    "net/de/": "allow",
    "example.net/de/8": "block",
    "org/es/": "block",
}


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_token_files(table(spark, sf_dir, "documents"))
    return read_token_files(spark, written).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op8_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_signals(table(spark, sf_dir, "documents")).drop("class_divergence", "word_divergence")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Pages and documents share their ids; a page of a document labelled as toxic or of low quality is a bad one.
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES, labels)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle_digests(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_source_mix,
    op2_secret_scan,
    op3_token_files,
    op4_packing,
    op5_near_duplicates,
    op6_token_counts,
    op7_substring_dedup,
    op8_top_k_search,
    op9_quality_rules,
    op10_url_filter,
    op11_fill_in_middle,
    op12_decontamination,
    op13_vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | {"op10_url_filter": oracle.op10(URL_RULES)}
