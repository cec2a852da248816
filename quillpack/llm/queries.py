"""Queries of the training-data operators: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, license_scan, line_dedup, mixing, packing, pii, quality, rules, tiff, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has images: the pages are captured as TIFF (all codecs, layouts and byte orders in turn), then read back."""
    found = tiff.tiff_pages(tiff.captures(_table(spark, sf_dir, "pages")))
    return found.withColumn("pixels", F.hex("pixels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.graded(_table(spark, sf_dir, "labels")))
    return quality.grade(docs, model).select("doc_id", "expected_grade", "p_tail", "keep")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), share=mixing.SHARE).select("doc_id", "source", "n_tokens")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(_table(spark, sf_dir, "documents"))


def op9_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.sanitise(_table(spark, sf_dir, "documents"), spread=pii.SPREAD)


def op10_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_balanced(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_license_scan, op2_toxicity, op3_tiff_pages, op4_quality_classifier, op5_quality_rules, op6_line_dedup, op7_source_mixing, op8_ngram_jaccard_join, op9_pii_sanitise, op10_cost_packing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against brute force."""
    return {"op3_tiff_pages": tiff.SQL, "op5_quality_rules": rules.SQL, "op6_line_dedup": line_dedup.SQL}
