"""The queries of the training-data operators and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewave.llm import divergence, line_dedup, substring_dedup, url_filter
from tilewave.llm.common import table

#: The rules that op10 is asked to apply.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewave.llm.common import OWN
    from tilewave.llm.line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return out.select("doc_id", F.col(f"{OWN}n_lines").alias("n_lines"), F.col(f"{OWN}n_dropped").alias("n_dropped"), digest.alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewave.llm.secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewave.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewave.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewave.llm.decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewave.llm.pii import pii_digest

    return pii_digest(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tilewave.llm.bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewave.llm.sharding import kd_shards

    return kd_shards(table(spark, sf_dir, "documents"), shards=8)


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewave.llm.minhash import near_classes

    return near_classes(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewave.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewave.llm.substring_dedup import repeat_digests

    return repeat_digests(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewave.llm.periodic import run_digests

    return run_digests(table(spark, sf_dir, "documents"), plant=True)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewave.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_decontam": op5_decontam,
    "op6_pii": op6_pii,
    "op7_bpe": op7_bpe,
    "op8_kd_sharding": op8_kd_sharding,
    "op9_dart_minhash": op9_dart_minhash,
    "op10_url_filter": op10_url_filter,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_divergence": op13_source_divergence,
}

SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op10_url_filter": url_filter.sql(URL_RULES),
    "op11_substring_dedup": substring_dedup.SQL,
    "op13_source_divergence": divergence.SQL,
}
