"""Queries p4: garbled previews and file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import garble
from siltbed.sources.tables import table


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of both tables once per id: ``tbl, row_id, body``."""
    blocks = table(spark, sf_dir, "text_blocks", "block_id", "preview")
    names = table(spark, sf_dir, "dirents", "dirent_id", "name")
    return blocks.select(F.lit("text_blocks").alias("tbl"), F.col("block_id").alias("row_id"), F.col("preview").alias("body")).unionByName(
        names.select(F.lit("dirents").alias("tbl"), F.col("dirent_id").alias("row_id"), F.col("name").alias("body"))
    )


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each garbled text with the original where it can be had."""
    return garble.find_garbled(_both(spark, sf_dir), "body", "tbl", "row_id").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.find_garbled(_both(spark, sf_dir), "body", "tbl", "row_id").select("tbl", "row_id").distinct()


def queries() -> dict:
    return {"p4_found": p4_found, "p4_repaired": p4_repaired}
