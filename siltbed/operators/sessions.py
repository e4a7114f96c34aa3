"""Carving sessions: states of hits, resumption, comparison of drives, reports.

Defined results: a status that can't be read is ``Unextracted``; comparisons are null-safe; empty sessions give zero rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States that count as written.
WRITTEN = ("Ok", "Truncated")


def state(status: Column) -> Column:
    """Name of a status written as a word or as ``{"Name": {...}}``."""
    name = F.regexp_extract(F.coalesce(status, F.lit("")), r'^\s*\{?\s*"?([A-Za-z]+)', 1)
    return F.when(F.length(name) > 0, name).otherwise("Unextracted")


def state_bytes(status: Column) -> Column:
    """Bytes in a status, null without any."""
    return F.regexp_extract(F.coalesce(status, F.lit("")), r'"bytes"\s*:\s*(\d+)', 1).try_cast("bigint")


def requeued(name: Column) -> Column:
    """State after loading: what was under way starts again."""
    return F.when(name.isin("Queued", "Extracting"), "Unextracted").otherwise(name)


def restore_stats(hits: DataFrame, key: list[str]) -> DataFrame:
    """Per session: files written, skipped, duplicate and still to do, of rows with ``state``."""
    n = lambda *s: F.sum(F.col("state").isin(*s).cast("int"))
    return hits.groupBy(*key).agg(n(*WRITTEN).alias("written"), n("Skipped").alias("skipped"), n("Duplicate").alias("duplicate"), n("Unextracted", "Queued", "Extracting").alias("to_do"), F.count("*").alias("n_hits"))


def session_match(sessions: DataFrame, drives: DataFrame) -> DataFrame:
    """Sessions that may go on with a drive: same non-empty serial, and the size unknown or equal.

    ``sessions``: ``session_id, serial, size``; ``drives``: ``drive_id, serial, size``.
    """
    s, d = sessions.where("serial IS NOT NULL AND serial <> ''").alias("s"), drives.alias("d")
    fits = (F.col("s.serial") == F.col("d.serial")) & ((F.coalesce("s.size", F.lit(0)) == 0) | (F.col("s.size") == F.col("d.size")))
    return s.join(d, fits).select("session_id", "drive_id")


def same_drive(serial_a: Column, model_a: Column, size_a: Column, serial_b: Column, model_b: Column, size_b: Column) -> Column:
    return serial_a.eqNullSafe(serial_b) & model_a.eqNullSafe(model_b) & size_a.eqNullSafe(size_b)


def without_disabled(signatures: DataFrame, disabled: DataFrame) -> DataFrame:
    """Only disabled names are stored, so new signatures are on."""
    return signatures.join(disabled.select("name").where("name IS NOT NULL").distinct(), "name", "left_anti")


def range_mask(device: DataFrame, start: int, end: int) -> DataFrame:
    """Updates that mark everything outside ``[start, end)`` of ``device, size`` as done."""
    parts = F.array(
        F.struct(F.lit(0).cast("long").alias("pos"), F.least(F.lit(start).cast("long"), F.col("size")).alias("size"), F.lit("+").alias("status")),
        F.struct(F.least(F.lit(end).cast("long"), F.col("size")).alias("pos"), F.greatest(F.col("size") - end, F.lit(0)).alias("size"), F.lit("+").alias("status")),
    )
    return device.select("device", F.inline(parts)).where("size > 0")


def report(device: DataFrame, verdicts: DataFrame, maps: DataFrame, hits: DataFrame) -> DataFrame:
    """One text per device from ``device, model``; ``device, verdict``; ``device, done``; ``device, n_hits``."""
    joined = device.join(verdicts, "device", "left").join(maps, "device", "left").join(hits, "device", "left")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("Device: "), F.col("device").cast("string")), F.concat(F.lit("Model: "), F.coalesce("model", F.lit("unknown"))), F.concat(F.lit("Health: "), F.coalesce("verdict", F.lit("unknown"))),
        F.concat(F.lit("Imaged: "), F.format_string("%.1f%%", F.bround(F.coalesce("done", F.lit(0.0)) * 100, 1))), F.concat(F.lit("Hits: "), F.coalesce("n_hits", F.lit(0)).cast("string")),
    )
    return joined.select("device", lines.alias("report"))
