"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import (
    centroid_clustering,
    decontamination,
    html_extraction,
    merkle_manifest,
    mixture,
    near_dedup,
    pii,
    quality_classifier,
    quality_rules,
    simhash_dedup,
    substring_dedup,
    token_counts,
    warc_archive,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.query,
        "op2_quality_classifier": quality_classifier.query,
        "op3_substring_dedup": substring_dedup.query,
        "op4_decontamination": decontamination.query,
        "op5_html_extraction": html_extraction.query,
        "op6_warc_archive": warc_archive.query,
        "op7_source_mixture": mixture.query,
        "op8_near_dedup": near_dedup.query,
        "op9_personal_data": pii.query,
        "op10_quality_rules": quality_rules.query,
        "op11_merkle_manifest": merkle_manifest.query,
        "op12_centroid_clustering": centroid_clustering.query,
        "op13_simhash_dedup": simhash_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": substring_dedup.SQL,
        "op4_decontamination": decontamination.SQL,
        "op6_warc_archive": warc_archive.SQL,
        "op7_source_mixture": mixture.SQL,
        "op11_merkle_manifest": merkle_manifest.SQL,
        "op12_centroid_clustering": centroid_clustering.SQL,
    }
