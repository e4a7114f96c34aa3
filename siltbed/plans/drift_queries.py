"""Queries p2: checkpoint files whose lines change shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.operators import drift
from siltbed.plans.lineage import cut
from siltbed.sources.tables import table


def _read(spark: SparkSession, sf_dir: str, *unused: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, sf_dir, "checkpoint_files", "file_id", "session_id", "file_no")
    return cut(drift.path_values(table(spark, sf_dir, "checkpoint_lines")).drop(*unused)), files


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, files = _read(spark, sf_dir, "raw")
    return drift.changes(values, files)


def p2_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed table of all lines under common field names."""
    values, files = _read(spark, sf_dir)
    return drift.consistent_table(values, drift.field_groups(drift.changes(values, files)))


def p2_failed_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file and field of the consistent table: values that don't fit, fit only when normalised, or clash."""
    hits = p2_hits(spark, sf_dir).select("file_id", "failed_casts", "normalised", "clashes")
    kinds = [hits.select("file_id", F.lit(kind).alias("problem"), F.explode(kind).alias("field")) for kind in ("failed_casts", "normalised", "clashes")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("file_id", "field", "problem").agg(F.count("*").alias("n_values"))


def queries() -> dict:
    return {"p2_found": p2_found, "p2_hits": p2_hits, "p2_failed_casts": p2_failed_casts}


def oracle_sql() -> dict:
    return {}
