"""Queries p3: personal information in the previews of text blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import pii
from siltbed.sources.tables import table


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "text_blocks", "block_id", "preview")
    # more tasks than files, for the tagger is all CPU
    return pii.find_pii(blocks.distinct(), "preview")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = _tagged(spark, sf_dir)
    return tagged.select("block_id", F.explode(F.array_distinct("pii.types")).alias("pii_type")).distinct()


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every preview with its personal information replaced."""
    return _tagged(spark, sf_dir).select("block_id", "pii.masked", F.size("pii.types").alias("n_replaced"))


def queries() -> dict:
    return {"p3_found": p3_found, "p3_masked": p3_masked}
