"""Listings of many volumes as one DataFrame.

``volumes``: ``image_id, path, part_offset, fs``, one row per volume in an image file that all executors can read. The
master tables of NTFS are spread over tasks by ranges of records; the other systems are walked folder by folder,
one task per volume.

Defined results: a volume that can't be opened or read has no rows; damaged folders end where they stop making sense.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.operators import hierarchy
from siltbed.operators.filesystems import ext, fat, ntfs
from siltbed.operators.filesystems.common import SCHEMA

RECORDS_PER_TASK = 16_384
WALKS = {"FAT32": fat.fat32_entries, "exFAT": fat.exfat_entries, "ext4": ext.entries}


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in SCHEMA.split(", ")]
    cols = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def _with_ranges(volumes: DataFrame, limit: int | None) -> DataFrame:
    """Volumes with ``first``: where a task begins; an NTFS table of any length is many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row in zip(*(b[c].to_pylist() for c in ("image_id", "path", "part_offset", "fs"))):
                n = 1
                if row[3] == "NTFS":
                    try:
                        with open(row[1], "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                            n = ntfs.n_records(data, row[2])
                    except (OSError, ValueError, struct.error, IndexError, ZeroDivisionError):
                        n = 0
                    n = n if limit is None else min(n, limit)
                rows += [(*row, k) for k in range(0, max(n, 1), RECORDS_PER_TASK)]
            cols = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["image_id", "path", "part_offset", "fs", "first"])

    given = volumes.select(F.col("image_id").cast("long"), "path", F.col("part_offset").cast("long"), "fs")
    return given.mapInArrow(run, "image_id bigint, path string, part_offset bigint, fs string, first bigint")


def list_entries(volumes: DataFrame, ntfs_records: int | None = None) -> DataFrame:
    """All entries; ``path`` is filled except for NTFS, see :func:`ntfs_paths`. ``ntfs_records``: a limit, for previews."""
    plan = _with_ranges(volumes, ntfs_records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, path, offset, fs, first in zip(*(b[c].to_pylist() for c in ("image_id", "path", "part_offset", "fs", "first"))):
                rows: list[tuple] = []
                try:
                    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                        if fs == "NTFS":
                            found = ntfs.entries(data, offset, first, RECORDS_PER_TASK if ntfs_records is None else max(0, min(RECORDS_PER_TASK, ntfs_records - first)))
                        else:
                            found = WALKS[fs](data, offset) if fs in WALKS else iter(())
                        for e in found:
                            rows.append((image, offset, fs, *e))
                            if len(rows) >= 5000:
                                yield _arrow(rows)
                                rows = []
                except (OSError, ValueError, struct.error, IndexError):
                    pass
                yield _arrow(rows)

    return plan.repartition(F.col("image_id"), F.col("part_offset"), F.col("first")).mapInArrow(run, SCHEMA)


def ntfs_paths(entries: DataFrame) -> DataFrame:
    """Paths of NTFS files from their parents: ``image_id, entry_id, path, depth``; circles are left out.

    Folders and files form a forest of record numbers; record 5 is the root, which the hierarchy knows as 2.
    """
    files = entries.where("fs = 'NTFS' AND instr(name, ':') = 0").groupBy("image_id", "entry_id").agg(F.max(F.struct("parent_id", "name")).alias("b"))
    renumber = lambda c: F.when(c == ntfs.ROOT, F.lit(hierarchy.ROOT_INO)).when(c == hierarchy.ROOT_INO, F.lit(ntfs.ROOT)).otherwise(c)
    nodes = files.select("image_id", renumber(F.col("entry_id")).cast(T.LongType()).alias("ino"), renumber(F.col("b.parent_id")).cast(T.LongType()).alias("parent"), F.col("b.name").alias("name"))
    tree = hierarchy.build_hierarchy(nodes, hierarchy.separate_cycles(nodes))
    return tree.select("image_id", renumber(F.col("ino")).alias("entry_id"), "path", "depth")


def deleted_files(entries: DataFrame) -> DataFrame:
    """Deleted files by chance of recovery, then name."""
    rank = F.when(F.col("chance") == "High", 0).when(F.col("chance") == "Medium", 1).when(F.col("chance") == "Low", 2).otherwise(3)
    return entries.where("is_deleted AND NOT is_dir").orderBy(rank, "name", "image_id", "entry_id")


def metadata_index(entries: DataFrame) -> DataFrame:
    """``image_id, part_seq, entry_seq, abs_offset, name`` for exact look-ups of carved hits."""
    known = entries.where("data_offset IS NOT NULL AND NOT is_dir")
    return known.select("image_id", F.col("part_offset").alias("part_seq"), F.col("entry_id").alias("entry_seq"), (F.col("part_offset") + F.col("data_offset")).alias("abs_offset"), F.coalesce("path", "name").alias("name"))
