"""Drive health from SMART reports, and thermal and speed guards over samples.

Defined results: a report without ``smart_status`` counts as failed; a report that is no JSON has the verdict
``Unknown``; missing attributes count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltbed.operators.intervals import TIME_BLOCK, _micros, neighbour

REPORT = """device struct<name: string>, serial_number string, model_name string, rotation_rate int, smart_status struct<passed: boolean>, temperature struct<current: int>,
ata_smart_attributes struct<table: array<struct<id: int, name: string, value: int, thresh: int, when_failed: string, raw: struct<value: bigint>>>>,
nvme_smart_health_information_log struct<critical_warning: int, available_spare: int, available_spare_threshold: int, media_errors: bigint>"""
# Attribute, limits for a warning and for a critical verdict.
LIMITS = {"temperature": (None, 50, 60), "reallocated": (5, 1, 50), "pending": (197, 1, 10), "uncorrectable": (198, 1, 5), "spin_up": (3, 10_000, 20_000)}


def parse_report(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("report", F.from_json(F.col(column), REPORT, {"mode": "PERMISSIVE"}))


def attribute(report: Column, number: int) -> Column:
    """First attribute with this id."""
    return F.get(F.filter(report["ata_smart_attributes"]["table"], lambda a: a["id"] == number), F.lit(0))


def reasons(report: Column) -> tuple[Column, Column]:
    """Critical and warning reasons."""
    raw = lambda n: F.coalesce(attribute(report, n)["raw"]["value"], F.lit(0))
    value = {k: raw(n) if n else F.coalesce(report["temperature"]["current"], F.lit(0)) for k, (n, _, _) in LIMITS.items()}
    spins = F.coalesce(report["rotation_rate"], F.lit(0)) > 0
    nvme = report["nvme_smart_health_information_log"]
    critical = [F.when(~F.coalesce(report["smart_status"]["passed"], F.lit(False)), F.lit("self-test failed"))]
    warning = []
    for k, (_, low, high) in LIMITS.items():
        on = spins if k == "spin_up" else F.lit(True)
        critical.append(F.when(on & (value[k] >= high), F.lit(k)))
        warning.append(F.when(on & (value[k] >= low) & (value[k] < high), F.lit(k)))
    critical.append(F.when(nvme["available_spare"] < nvme["available_spare_threshold"], F.lit("spare")))
    critical.append(F.when(nvme["media_errors"] > 0, F.lit("media errors")))
    warning.append(F.when(nvme["critical_warning"] != 0, F.lit("nvme warning")))
    failed = F.exists(F.coalesce(report["ata_smart_attributes"]["table"], F.array()), lambda a: F.coalesce(a["when_failed"], F.lit("")) != "")
    warning.append(F.when(failed, F.lit("attribute failed")))
    return F.array_compact(F.array(*critical)), F.array_compact(F.array(*warning))


def verdict(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """``keep`` columns, ``verdict`` (Healthy, Warning, Critical, Unknown) and ``reasons``, criticals first."""
    p = parse_report(df, column)
    bad, warn = reasons(F.col("report"))
    broken = F.col(column).isNull() | F.try_parse_json(F.col(column)).isNull()
    state = F.when(broken, "Unknown").when(F.size(bad) > 0, "Critical").when(F.size(warn) > 0, "Warning").otherwise("Healthy")
    return p.select(*keep, state.alias("verdict"), F.when(broken, F.lit("")).otherwise(F.concat_ws("; ", F.concat(bad, warn))).alias("reasons"))


def bad_lba(message: Column) -> Column:
    """Address in an error message such as ``at LBA = 0x000bc4a2``; null without one."""
    return F.conv(F.nullif(F.regexp_extract(message, r"at LBA = 0x([0-9A-Fa-f]+)", 1), F.lit("")), 16, 10).cast("long")


def thermal_state(samples: DataFrame, key: list[str], at: str, temperature: str, tie: str, pause: float = 55, resume: float = 50) -> DataFrame:
    """``paused`` per sample: from ``pause`` degrees on, until ``resume`` or less.

    Only samples beyond either limit change the state, so it is the last such sample's side; blocks of
    time keep a device's samples apart.
    """
    d = samples.withColumn("_us", _micros(at)).withColumn("_side", F.when(F.col(temperature) >= pause, 1).when(F.col(temperature) <= resume, 0))
    d = d.withColumn("_b", F.floor(F.col("_us") / TIME_BLOCK)).withColumn("_m", F.when(F.col("_side").isNotNull(), F.struct("_us", tie, "_side")))
    inside = Window.partitionBy(*key, "_b").orderBy("_us", tie).rowsBetween(Window.unboundedPreceding, 0)
    blocks = d.groupBy(*key, "_b").agg(F.max("_m").alias("_e"))
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_e", F.max("_e").over(before))
    out = d.withColumn("_l", F.max("_m").over(inside)).join(blocks, [*key, "_b"])
    return out.withColumn("paused", F.coalesce(F.coalesce("_l", "_e")["_side"], F.lit(0)) == 1).drop("_us", "_side", "_b", "_m", "_l", "_e")


def reconnects(samples: DataFrame, key: list[str], at: str, serial: str, tie: str) -> DataFrame:
    """Samples at which another drive answers under the same key (null-safe comparison with the one before)."""
    near = neighbour(samples.withColumn("_us", _micros(at)), key, "_us", [tie, serial], TIME_BLOCK, "_p")
    return near.where(F.col("_p").isNotNull() & ~F.col(f"_p.{serial}").eqNullSafe(F.col(serial))).drop("_us", "_p")
