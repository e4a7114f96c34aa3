"""Map files of an imaging run: reading and writing, with a checksum over the block lines.

Lines are ``pos size status`` in hexadecimal; ``#`` starts a comment and the first other line is the current position.
A checksum comment, where there is one, must fit the block lines put together without line breaks.

Defined results: lines that don't parse and blocks of size 0 are left out; a wrong checksum sets ``checksum_ok`` to false,
a missing one leaves it null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = r"^(0x[0-9A-Fa-f]+|\d+)\s+(0x[0-9A-Fa-f]+|\d+)\s+([?*/+-])$"
TAG = r"^#\s*crc32:\s*([0-9A-Fa-f]{1,8})\s*$"


def _number(text):
    return F.when(text.startswith("0x"), F.conv(F.substring(text, 3, 16), 16, 10)).otherwise(text).cast("long")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, size, status, checksum_ok`` of the map files under ``path``."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("lines"))
    trimmed = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: x != "")
    rows = lines.select("file", trimmed.alias("lines"))
    blocks = F.filter("lines", lambda x: x.rlike(BLOCK))
    tag = F.regexp_extract(F.get(F.filter("lines", lambda x: x.rlike(TAG)), F.lit(0)), TAG, 1)
    ok = F.when(F.length(tag) > 0, F.crc32(F.array_join(blocks, "").cast("binary")) == F.conv(tag, 16, 10).cast("long"))
    out = rows.select("file", ok.alias("checksum_ok"), F.explode(blocks).alias("b"))
    part = lambda k: F.regexp_extract("b", BLOCK, k)
    return out.select("file", _number(part(1)).alias("pos"), _number(part(2)).alias("size"), part(3).alias("status"), "checksum_ok").where("size > 0")


def write_map(blocks: DataFrame, path: str) -> None:
    """One map file of ``pos, size, status``: a device's map is bounded by its runs of equal status."""
    hexed = lambda c: F.concat(F.lit("0x"), F.lpad(F.hex(c), 10, "0"))
    line = F.concat_ws("  ", hexed(F.col("pos")), hexed(F.col("size")), "status")
    ordered = blocks.select("pos", line.alias("line")).groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("b")).select(F.transform("b", lambda x: x["line"]).alias("lines"))
    crc = F.lpad(F.lower(F.hex(F.crc32(F.array_join("lines", "").cast("binary")))), 8, "0")
    text = F.concat(F.lit("# map of an imaging run\n# crc32: "), crc, F.lit("\n0x0000000000  ?\n"), F.array_join("lines", "\n"))
    ordered.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def number_blocks(blocks: DataFrame, key: list[str]) -> DataFrame:
    """Blocks with their number in order of position."""
    return blocks.withColumn("block_no", F.row_number().over(Window.partitionBy(*key).orderBy("pos")))
