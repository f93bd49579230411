"""The registered queries of these operators, bound to a folder of tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import (
    hard_negatives,
    line_dedup,
    lm,
    merkle,
    mixing,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    topk,
    toxicity,
    url_filter,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Slot and shard of every document."""
    ids = _table(spark, folder, "documents").select("doc_id")
    return sharding.place(ids, ["doc_id"], sharding.lookup_table(list(sharding.SHARDS)))


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    return quality_classifier.report(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    """The five best partners of every fiftieth vector."""
    return topk.report(_table(spark, folder, "embeddings"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of all documents to their sources' targets."""
    return mixing.report(_table(spark, folder, "documents"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's address."""
    return url_filter.judged(_table(spark, folder, "pages"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of all documents' pieces."""
    return packing.pack(packing.pieces(_table(spark, folder, "documents")))


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of every document."""
    return lm.report(_table(spark, folder, "documents"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document, and those that fuzzy line dedup removes."""
    return line_dedup.report(_table(spark, folder, "documents"))


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under near duplication."""
    return near_dedup.report(_table(spark, folder, "documents"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality_rules.report(_table(spark, folder, "documents"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    return hard_negatives.report(_table(spark, folder, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, proof and check of every document against one root."""
    return merkle.report(_table(spark, folder, "documents"))


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.report(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_topk_search": op3_topk_search,
        "op4_mixing": op4_mixing,
        "op5_url_filter": op5_url_filter,
        "op6_packing": op6_packing,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_line_dedup": op8_line_dedup,
        "op9_near_dedup": op9_near_dedup,
        "op10_quality_rules": op10_quality_rules,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    from ledgerlake.llm import statements

    return statements.all_statements()
