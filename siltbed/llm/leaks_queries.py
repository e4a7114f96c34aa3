"""Queries p6: evaluation items inside documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import leaks
from siltbed.sources.tables import table


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the items it leaks, matched words and share of the item."""
    return leaks.find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked item with the number of documents that hold it and the longest passage."""
    return p6_leaks(spark, sf_dir).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("n_words").alias("most_words"))


def queries() -> dict:
    return {"p6_found": p6_found, "p6_leaks": p6_leaks, "p6_items": p6_items}
