"""Queries p5: languages of the previews of running text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.llm import langid
from siltbed.sources.tables import table


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "text_blocks", "block_id", "kind", "preview", "lang")
    blocks = blocks.where("kind IN ('Generic', 'Markdown')")
    sources = {"previews": (blocks, "preview"), "documents": (table(spark, sf_dir, "documents", "text", "lang"), "text")}
    # bounded: a limited number of texts per language and table
    model = langid.fit([(r[0], r[1], name) for name, (df, text) in sources.items() for r in langid.labelled_sample(df, text, "lang").collect()])
    return langid.identify(blocks.select("block_id", "preview", "lang").distinct(), "preview", model)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.mislabelled(_identified(spark, sf_dir), "lang", "block_id")


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every preview of running text in its parts, with language and confidence."""
    parts = _identified(spark, sf_dir).select("block_id", F.posexplode("segments").alias("part_no", "s"))
    return parts.select("block_id", "part_no", "s.part", "s.lang", "s.confidence").distinct()


def queries() -> dict:
    return {"p5_found": p5_found, "p5_segments": p5_segments}
