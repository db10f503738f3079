"""The thin queries ``opN_<name>`` and ``pipeline`` over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, host_quality, licenses, near_dedup, oracle, packing, secrets_scan, source_mix, toxicity, warc, weighted_sampling


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(_table(spark, sf_dir, "pages"))


def op2_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.report(_table(spark, sf_dir, "documents"))


def op4_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(_table(spark, sf_dir, "documents"))


def op5_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.report(_table(spark, sf_dir, "conversations"))


def op6_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(_table(spark, sf_dir, "documents"))


def op8_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.report(_table(spark, sf_dir, "documents"))


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.report(_table(spark, sf_dir, "documents"))


def op10_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.report(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_arc_to_warc, op2_license_index, op3_source_mix, op4_bin_slack, op5_chat_parts, op6_noisy_channel_toxicity,
        op7_circulant_minhash, op8_markov_secrets, op9_host_quality, op10_weighted_sampling, pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """For those whose result SQL expresses on whole tables; the others are
    tested against brute force."""
    return {
        "op1_arc_to_warc": oracle.PAGES,
        "op5_chat_parts": oracle.CHATS,
        "op7_circulant_minhash": oracle.NEAR,
        "op9_host_quality": oracle.QUALITY,
    }
