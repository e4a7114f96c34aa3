"""Queries p7: the documents mixed to the target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltbed.llm import mixing
from siltbed.sources.tables import table


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: which tokens of which document lie in which output shard."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixing.reached(*_mix(spark, sf_dir))


def queries() -> dict:
    return {"p7_mix": p7_mix, "p7_shares": p7_shares}
