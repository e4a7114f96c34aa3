"""Intervals and ordered data: gap suppression, maps of device regions, partitions from hits, rates.

Defined results: rows with a null key or position are void; equal positions are ordered by the
tie-breakers given; empty inputs give empty results.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ordered data is cut into blocks of so many bytes, or microseconds.
OFFSET_BLOCK, TIME_BLOCK = 1 << 36, 86_400_000_000



def neighbour(df: DataFrame, key: list[str], at: str, columns: list[str], width: int, name: str, ahead: bool = False) -> DataFrame:
    """``df`` with the struct ``name`` of ``columns`` from the row before (or ``ahead``) in order of ``at``.

    The order runs inside blocks of ``width``; the last row of each block is handed to the next one that has
    rows. So a key with a third of all rows is spread over its blocks, and only one row per block is
    ordered per key. ``columns`` break ties.
    """
    pick = F.struct(F.col(at), *[F.col(c) for c in columns])
    d = df.withColumn("_b", F.floor(F.col(at) / width)).withColumn("_s", pick)
    inside = Window.partitionBy(*key, "_b").orderBy("_s")
    near = F.lead("_s").over(inside) if ahead else F.lag("_s").over(inside)
    edge = F.min("_s") if ahead else F.max("_s")
    blocks = d.groupBy(*key, "_b").agg(edge.alias("_e"))
    across = Window.partitionBy(*key).orderBy("_b")
    blocks = blocks.withColumn("_e", F.lead("_e").over(across) if ahead else F.lag("_e").over(across))
    return d.withColumn("_n", near).join(blocks, [*key, "_b"]).withColumn(name, F.coalesce("_n", "_e")).drop("_b", "_s", "_n", "_e")


def run_starts(df: DataFrame, key: list[str], at: str, fresh: str, width: int, name: str) -> DataFrame:
    """``df`` with ``name``: the place of the last row at or before each one where ``fresh`` holds."""
    d = df.withColumn("_b", F.floor(F.col(at) / width)).withColumn("_m", F.when(F.col(fresh), F.col(at)))
    inside = Window.partitionBy(*key, "_b").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    blocks = d.groupBy(*key, "_b").agg(F.max("_m").alias("_e"))
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_e", F.max("_e").over(before))
    return d.withColumn("_l", F.max("_m").over(inside)).join(blocks, [*key, "_b"]).withColumn(name, F.coalesce("_l", "_e")).drop("_b", "_m", "_l", "_e")


def suppress_gap(hits: DataFrame, key: list[str], at: str, gap: str, tie: str, width: int = OFFSET_BLOCK) -> DataFrame:
    """Hits that lie at least their own ``gap`` behind the last one accepted under the same key.

    A hit with gap 0 always stays and doesn't move the limit. The rule is greedy, so it looks
    sequential, but a hit further behind the one before than any gap of the key is always accepted and starts
    afresh. The walk goes over stretches from such a start to another, about one block long.
    """
    rows = hits.where(F.col(at).isNotNull() & F.col(gap).isNotNull())
    for k in key:
        rows = rows.where(F.col(k).isNotNull())
    largest = rows.groupBy(*key).agg(F.max(gap).alias("_g"))
    near = neighbour(rows, key, at, [tie], width, "_p").join(largest, key)
    marked = near.withColumn("_new", F.coalesce(F.col(at) - F.col(f"_p.{at}") >= F.greatest("_g", F.lit(1)), F.lit(True)))
    runs = run_starts(marked, key, at, "_new", width, "_start").withColumn("_start", F.floor(F.col("_start") / width))
    schema = hits.schema

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*key, "_start", at, tie], kind="stable")
        keep, last, before = [], None, None
        for stretch, pos, g in zip(zip(*(pdf[k] for k in [*key, "_start"])), pdf[at], pdf[gap]):
            if stretch != before:
                last, before = None, stretch
            ok = g == 0 or last is None or pos >= last + g
            keep.append(ok)
            if ok and g != 0:
                last = pos
        return pdf.loc[keep, schema.names]

    # many short stretches share a call; a call holds about a quarter of what a task of a shuffle holds
    calls = 4 * int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.withColumn("_call", F.pmod(F.xxhash64(*key, "_start"), F.lit(calls))).groupBy("_call").applyInPandas(walk, schema)


def merge_islands(blocks: DataFrame, key: list[str], width: int = OFFSET_BLOCK) -> DataFrame:
    """Neighbouring blocks ``pos, size, status`` of equal status as one."""
    near = neighbour(blocks, key, "pos", ["size", "status"], width, "_p")
    joined = F.coalesce((F.col("_p.status") == F.col("status")) & (F.col("_p.pos") + F.col("_p.size") == F.col("pos")), F.lit(False))
    runs = run_starts(near.withColumn("_f", ~joined), key, "pos", "_f", width, "_i")
    return runs.groupBy(*key, "_i").agg(F.min("pos").alias("pos"), F.sum("size").alias("size"), F.first("status").alias("status")).drop("_i")


def overlay(updates: DataFrame, key: list[str]) -> DataFrame:
    """Ordered range updates ``seq, pos, size, status`` flattened: at every place the latest wins."""
    edges = updates.select(*key, F.explode(F.array("pos", F.col("pos") + F.col("size"))).alias("lo")).distinct()
    pieces = edges.withColumn("hi", F.lead("lo").over(Window.partitionBy(*key).orderBy("lo"))).where("hi IS NOT NULL")
    u = updates.select(*key, "seq", "pos", (F.col("pos") + F.col("size")).alias("end"), "status")
    cond = [pieces[k] == u[k] for k in key] + [pieces["lo"] >= u["pos"], pieces["lo"] < u["end"]]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    top = pieces.join(u, on).groupBy(*[pieces[k] for k in key], "lo", "hi").agg(F.max(F.struct("seq", "status")).alias("t"))
    flat = top.select(*key, F.col("lo").alias("pos"), (F.col("hi") - F.col("lo")).alias("size"), F.col("t.status").alias("status"))
    return merge_islands(flat, key)


def status_bytes(blocks: DataFrame, key: list[str]) -> DataFrame:
    return blocks.groupBy(*key, "status").agg(F.sum("size").alias("n_bytes"))


def unreadable_sectors(blocks: DataFrame, key: list[str], sector: int = 512) -> DataFrame:
    bad = F.sum(F.when(F.col("status").isin("*", "/", "-"), F.col("size")).otherwise(0))
    return blocks.groupBy(*key).agg(F.floor(bad / sector).cast("long").alias("n_sectors"))


def progress(blocks: DataFrame, key: list[str]) -> DataFrame:
    """Finished share of each device and the share no longer untried."""
    total = F.sum("size")
    part = lambda *s: F.sum(F.when(F.col("status").isin(*s), F.col("size")).otherwise(0))
    return blocks.groupBy(*key).agg(
        F.when(total == 0, 1.0).otherwise(part("+") / total).alias("done"), F.when(total == 0, 1.0).otherwise((total - part("?")) / total).alias("passed")
    )


def reconstruct_partitions(hits: DataFrame, key: list[str], disk_lba: str, width: int = OFFSET_BLOCK // 512) -> DataFrame:
    """Partitions from file-system hits ``start_lba, fs_type``: each ends before the next hit."""
    near = neighbour(hits, key, "start_lba", ["fs_type"], width, "_p", ahead=True)
    return near.withColumn("end_lba", F.coalesce("_p.start_lba", F.col(disk_lba)) - 1).select(
        *key, "start_lba", "end_lba", F.greatest(F.col("end_lba") - F.col("start_lba") + 1, F.lit(1)).alias("size_lba"),
        F.concat(F.lit("Recovered "), "fs_type", F.lit(" partition")).alias("name"),
    )


def _micros(at: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(at).cast("timestamp_ntz"))


def rolling_rate(samples: DataFrame, key: list[str], at: str, value: str, tie: str, width: int = TIME_BLOCK) -> DataFrame:
    """Change of a counter per second since the sample before."""
    near = neighbour(samples.withColumn("_us", _micros(at)), key, "_us", [tie, value], width, "_p")
    seconds = (F.col("_us") - F.col("_p._us")) / 1e6
    return near.withColumn("rate", F.when(seconds > 0, (F.col(value) - F.col(f"_p.{value}")) / seconds)).drop("_us", "_p")


def stalls(samples: DataFrame, key: list[str], at: str, tie: str, seconds: int = 90, width: int = TIME_BLOCK) -> DataFrame:
    """Samples after which nothing came for so long."""
    near = neighbour(samples.withColumn("_us", _micros(at)), key, "_us", [tie], width, "_p", ahead=True)
    return near.withColumn("gap_s", (F.col("_p._us") - F.col("_us")) / 1e6).where(F.col("gap_s") >= seconds).drop("_us", "_p")


def upper_median(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """``sorted[n / 2]`` of the non-zero values, without gathering a key's values in one place."""
    rows = df.where(F.col(value) != 0).groupBy(*key, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_c", F.sum("_n").over(w))
    total = rows.groupBy(*key).agg(F.sum("_n").alias("_t"))
    at = F.floor(F.col("_t") / 2)
    return placed.join(total, key).where((F.col("_c") > at) & (F.col("_c") - F.col("_n") <= at)).select(*key, F.col(value).alias("median"), F.col("_t").alias("n"))

