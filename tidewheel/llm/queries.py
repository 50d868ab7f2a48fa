"""Queries and SQL of the numbered operators and of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import bpe, classifier, jaccard, leaks, licences, lines, private, quality, repeats, scoring
from tidewheel.llm.common import documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": lambda spark, sf_dir: quality.op1(documents(spark, sf_dir)),
        "op2_suffix_dedup": lambda spark, sf_dir: repeats.op2(documents(spark, sf_dir)),
        "op3_bpe_codec": lambda spark, sf_dir: bpe.op3(documents(spark, sf_dir), tokenizer_path()),
        "op4_line_dedup": lambda spark, sf_dir: lines.op4(documents(spark, sf_dir)),
        "op5_lm_score": lambda spark, sf_dir: scoring.op5(documents(spark, sf_dir)),
        "op6_quality_classifier": lambda spark, sf_dir: classifier.op6(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
        "op7_jaccard_join": lambda spark, sf_dir: jaccard.op7(documents(spark, sf_dir)),
        "op8_private_data": lambda spark, sf_dir: private.op8(documents(spark, sf_dir)),
        "op9_decontamination": lambda spark, sf_dir: leaks.op9(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
        "op10_license_scan": lambda spark, sf_dir: licences.op10(documents(spark, sf_dir)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.SQL, "op2_suffix_dedup": repeats.SQL, "op4_line_dedup": lines.SQL, "op7_jaccard_join": jaccard.SQL, "op10_license_scan": licences.sql()}
