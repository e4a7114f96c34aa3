"""Queries p8: abusive, hateful or sexual documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import toxicity
from siltbed.sources.tables import table


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    labels = table(spark, sf_dir, "abuse_labels", "doc_id", "label")
    return toxicity.score_documents(docs, "text", toxicity.fit_tables(docs, labels)).drop("text")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the probability of each category and its score."""
    return _scored(spark, sf_dir).drop("source").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("score") >= toxicity.THRESHOLD).select("doc_id").distinct()


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of such documents per source (case and blanks aside)."""
    bad = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    once = _scored(spark, sf_dir).select("doc_id", F.lower(F.trim("source")).alias("source"), "score").distinct()
    return once.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(bad).alias("n_toxic"), F.avg(bad).alias("rate"))


def queries() -> dict:
    return {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
