"""Passes of an imaging run over a device map, as joins of blocks with the outcome per sector.

``blocks``: ``device, pos, size, status`` in sectors; ``bad``: ``device, sector`` that can't be read. The passes are those of a
recovery: copy in chunks, trim from the front, scrape sector by sector. Bad sectors are few beside the
device, so every pass works on blocks and bad sectors only, never on all sectors.

Defined results: a device without bad sectors is finished after the copy; blocks without size are void; bad sectors
outside all blocks don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.operators.intervals import merge_islands

CHUNK = 1024


def _split(blocks: DataFrame, status: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """The blocks of a status in chunks (aligned to the chunk size), and all others."""
    todo, rest = blocks.where((F.col("status") == status) & (F.col("size") > 0)), blocks.where((F.col("status") != status) & (F.col("size") > 0))
    first, last = F.floor(F.col("pos") / chunk), F.floor((F.col("pos") + F.col("size") - 1) / chunk)
    cut = todo.select("device", F.explode(F.sequence(first, last)).alias("c"), "pos", "size")
    lo, hi = F.greatest("pos", F.col("c") * chunk), F.least(F.col("pos") + F.col("size"), (F.col("c") + 1) * chunk)
    return cut.select("device", "c", lo.alias("pos"), (hi - lo).alias("size")), rest.select("device", "pos", "size", "status")


def _hits(pieces: DataFrame, bad: DataFrame, chunk: int) -> DataFrame:
    """Each piece with its first bad sector, null without one."""
    b = bad.select("device", F.floor(F.col("sector") / chunk).alias("c"), "sector").distinct()
    inside = pieces.join(b, ["device", "c"]).where((F.col("sector") >= F.col("pos")) & (F.col("sector") < F.col("pos") + F.col("size")))
    first = inside.groupBy("device", "c", "pos").agg(F.min("sector").alias("first_bad"))
    return pieces.join(first, ["device", "c", "pos"], "left")


def copy_pass(blocks: DataFrame, bad: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Untried blocks in chunks: read (``+``) or to be trimmed (``*``)."""
    pieces, rest = _split(blocks, "?", chunk)
    done = _hits(pieces, bad, chunk).select("device", "pos", "size", F.when(F.col("first_bad").isNull(), "+").otherwise("*").alias("status"))
    return merge_islands(rest.unionByName(done), ["device"])


def trim_pass(blocks: DataFrame, bad: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Blocks to be trimmed, read from the front of each chunk: up to the first failure (``+``), that sector (``-``), the rest to be scraped (``/``)."""
    pieces, rest = _split(blocks, "*", chunk)
    h = _hits(pieces, bad, chunk)
    end, b = F.col("pos") + F.col("size"), F.col("first_bad")
    part = lambda pos, size, status: F.struct(pos.alias("pos"), size.alias("size"), F.lit(status).alias("status"))
    parts = F.when(b.isNull(), F.array(part(F.col("pos"), F.col("size"), "+"))).otherwise(F.array(part(F.col("pos"), b - F.col("pos"), "+"), part(b, F.lit(1).cast("long"), "-"), part(b + 1, end - b - 1, "/")))
    done = h.select("device", F.inline(parts)).where("size > 0")
    return merge_islands(rest.unionByName(done), ["device"])


def scrape_pass(blocks: DataFrame, bad: DataFrame) -> DataFrame:
    """Every sector of the blocks to be scraped by itself: the bad ones (``-``) and the stretches between them (``+``)."""
    todo, rest = blocks.where("status = '/' AND size > 0"), blocks.where("status <> '/' AND size > 0").select("device", "pos", "size", "status")
    pieces, _ = _split(todo, "/", CHUNK)
    b = bad.select("device", F.floor(F.col("sector") / CHUNK).alias("c"), "sector").distinct()
    inside = pieces.join(b, ["device", "c"], "left").where(F.col("sector").isNull() | ((F.col("sector") >= F.col("pos")) & (F.col("sector") < F.col("pos") + F.col("size"))))
    sectors = pieces.join(inside.groupBy("device", "c", "pos").agg(F.sort_array(F.collect_list("sector")).alias("s")), ["device", "c", "pos"], "left")
    s = F.coalesce("s", F.array().cast("array<bigint>"))  # at most one chunk of sectors
    ends = F.concat(s, F.array(F.col("pos") + F.col("size")))
    starts = F.concat(F.array(F.col("pos")), F.transform(s, lambda x: x + 1))
    good = F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("pos"), (z - a).alias("size"), F.lit("+").alias("status")))
    lost = F.transform(s, lambda x: F.struct(x.alias("pos"), F.lit(1).cast("long").alias("size"), F.lit("-").alias("status")))
    done = sectors.select("device", F.inline(F.concat(good, lost))).where("size > 0")
    return merge_islands(rest.unionByName(done), ["device"])


def known_bad(blocks: DataFrame, bad: DataFrame, size: int) -> DataFrame:
    """Sectors a drive reports as bad, as updates for an overlay: only those inside the device."""
    return bad.where((F.col("sector") >= 0) & (F.col("sector") < size)).select("device", F.col("sector").alias("pos"), F.lit(1).cast("long").alias("size"), F.lit("-").alias("status"))


def sweep_pass(blocks: DataFrame, bad: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Whatever is still untried, read as in trimming."""
    left = blocks.withColumn("status", F.when(F.col("status") == "?", "*").otherwise(F.when(F.col("status") == "*", "?").otherwise(F.col("status"))))
    swept = trim_pass(left, bad, chunk)
    return merge_islands(swept.withColumn("status", F.when(F.col("status") == "?", "*").otherwise(F.col("status"))), ["device"])


def retry_pass(blocks: DataFrame, bad: DataFrame, recovers: DataFrame, attempts: int = 3) -> DataFrame:
    """Bad blocks again: a sector that ``recovers`` (``device, sector, attempt``) within the attempts becomes ``+``.

    The direction of an attempt doesn't change which sectors answer, so all attempts are one join.
    """
    ok = recovers.where(F.col("attempt") <= attempts).select("device", "sector").distinct()
    still = bad.select("device", "sector").distinct().join(ok, ["device", "sector"], "left_anti")
    again = blocks.withColumn("status", F.when(F.col("status") == "-", "/").otherwise(F.when(F.col("status") == "/", "~").otherwise(F.col("status"))))
    done = scrape_pass(again, still)
    return merge_islands(done.withColumn("status", F.when(F.col("status") == "~", "/").otherwise(F.col("status"))), ["device"])
