"""The registered queries of this subpackage and their SQL. Each reads whole tables and returns its operator's full result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import conversation_audit, edit_matches, language_kernel, licence_paragraphs, packing_bm25, quality_gam, quality_trees, secret_links, setsketch, source_mix, spelling_variants, suffix_repeats, toxicity_models


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_packing_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return packing_bm25.pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_secret_links(spark: SparkSession, folder: str) -> DataFrame:
    return secret_links.scan(_table(spark, folder, "documents"))


def op3_language_kernel(spark: SparkSession, folder: str) -> DataFrame:
    return language_kernel.identify(_table(spark, folder, "documents"))


def op4_setsketch(spark: SparkSession, folder: str) -> DataFrame:
    return setsketch.near_duplicates(_table(spark, folder, "documents"))


def op5_toxicity_models(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_models.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_edit_matches(spark: SparkSession, folder: str) -> DataFrame:
    return edit_matches.matches(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_repeats.dedup(_table(spark, folder, "documents"))


def op8_licence_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return licence_paragraphs.scan(_table(spark, folder, "documents"))


def op9_quality_gam(spark: SparkSession, folder: str) -> DataFrame:
    return quality_gam.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_quality_trees(spark: SparkSession, folder: str) -> DataFrame:
    return quality_trees.quality_rules(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_conversation_audit(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_audit.audit(_table(spark, folder, "conversations"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.variants(_table(spark, folder, "documents"))


def op13_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return source_mix.mix(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing_bm25, op2_secret_links, op3_language_kernel, op4_setsketch, op5_toxicity_models, op6_edit_matches, op7_suffix_repeats, op8_licence_paragraphs, op9_quality_gam, op10_quality_trees, op11_conversation_audit, op12_spelling_variants, op13_source_mix)}

ORACLES = {"op2_secret_links": secret_links.SQL, "op12_spelling_variants": spelling_variants.SQL, "op13_source_mix": source_mix.SQL}
