"""Partition tables and file-system boot areas, from the first bytes of devices.

Defined results: null or short content has no partitions and the file system ``Unknown``; a damaged primary
table falls back to the one at the end of the device.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def le(content: Column, at: int, n: int) -> Column:
    """Unsigned little-endian field of up to 7 bytes."""
    return F.conv(F.concat(*[F.hex(F.substring(content, at + 1 + k, 1)) for k in range(n - 1, -1, -1)]), 16, 10).cast("long")


def mbr_entries(images: DataFrame) -> DataFrame:
    """``image_id, slot, bootable, type_id, start_lba, size_lba`` of ``image_id, content``."""
    slots = F.array(
        *[
            F.struct(F.lit(k).alias("slot"), (le(F.col("content"), 446 + 16 * k, 1) == 0x80).alias("bootable"), le(F.col("content"), 450 + 16 * k, 1).alias("type_id"),
                     le(F.col("content"), 454 + 16 * k, 4).alias("start_lba"), le(F.col("content"), 458 + 16 * k, 4).alias("size_lba"))
            for k in range(4)
        ]
    )
    signed = images.where((F.octet_length("content") >= 512) & (F.hex(F.substring("content", 511, 2)) == "55AA"))
    return signed.select("image_id", F.inline(slots)).where("type_id <> 0 AND start_lba <> 0 AND size_lba <> 0")


def is_protective(content: Column) -> Column:
    return F.hex(F.substring(content, 451, 1)) == "EE"


def gpt_parse(data: bytes, sector: int = 512) -> tuple[list[tuple], bool]:
    """Entries ``(no, type, start_lba, end_lba, name)`` and whether the backup was used."""

    def table(lba: int) -> list[tuple] | None:
        h = data[lba * sector : lba * sector + sector]
        if len(h) < 92 or h[:8] != b"EFI PART":
            return None
        size, crc = struct.unpack_from("<II", h, 12)
        if not 92 <= size <= sector or zlib.crc32(h[:16] + b"\0\0\0\0" + h[20:size]) != crc:
            return None
        at, n, width, entries_crc = struct.unpack_from("<QIII", h, 72)
        raw = data[at * sector : at * sector + n * width]
        if width < 128 or len(raw) < n * width or zlib.crc32(raw) != entries_crc:
            return None
        out = []
        for k in range(n):
            e = raw[k * width : (k + 1) * width]
            first, last = struct.unpack_from("<QQ", e, 32)
            if e[:16] != bytes(16) and first <= last:
                out.append((k, str(uuid.UUID(bytes_le=e[:16])), first, last, e[56:128].decode("utf-16-le", "replace").split("\0")[0]))
        return out

    primary = table(1)
    if primary is not None:
        return primary, False
    return table(len(data) // sector - 1) or [], True


def gpt_entries(images: DataFrame) -> DataFrame:
    """``image_id, slot, type_guid, start_lba, end_lba, name, from_backup``."""
    schema = "image_id bigint, slot int, type_guid string, start_lba bigint, end_lba bigint, name string, from_backup boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for image, data in zip(b["image_id"].to_pylist(), b["content"].to_pylist()):
                entries, backup = gpt_parse(data or b"")
                rows += [(image, *e, backup) for e in entries]
            cols = list(zip(*rows)) or [[]] * 7
            types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in schema.split(", ")])

    return images.select("image_id", "content").mapInArrow(run, schema)


def fs_type(content: Column) -> Column:
    """File system of a boot area, the first rule that fits."""
    at = lambda o, n: F.hex(F.substring(content, o + 1, n))
    word = lambda o, s: at(o, len(s)) == s.encode().hex().upper()
    return (
        F.when(word(3, "-FVE-FS-"), "BitLocker").when(word(3, "NTFS    "), "NTFS").when(word(3, "EXFAT   "), "exFAT")
        .when((at(510, 2) == "55AA") & word(82, "FAT32   "), "FAT32").when(word(32, "NXSB"), "APFS")
        .when(at(1024, 2).isin("482B", "4858"), "HFS+").when(at(1080, 2) == "53EF", "ext4").otherwise("Unknown")
    )


# What a sector holds by its first bytes.
SECTOR_LABELS = [
    ("EB52904E544653", "NTFS boot sector"), ("4546492050415254", "GPT header"), ("53514C69746520666F726D6174", "SQLite"), ("D0CF11E0A1B11AE1", "OLE2"), ("52494646", "RIFF"), ("4D5A", "PE executable"),
    ("504B0304", "ZIP"), ("526172211A07", "RAR"), ("377ABCAF271C", "7-Zip"), ("FFD8FF", "JPEG"), ("89504E47", "PNG"), ("25504446", "PDF"), ("47494638", "GIF"), ("4F676753", "OGG"), ("664C6143", "FLAC"),
    ("494433", "MP3"), ("1A45DFA3", "Matroska"), ("456C6646696C65", "EVTX"), ("2142444E", "PST"),
]


def sector_label(content: Column, lba: Column) -> Column:
    hexed = F.hex(F.substring(content, 1, 16))
    out = F.when((lba == 0) & (F.hex(F.substring(content, 511, 2)) == "55AA"), "MBR")
    for prefix, label in SECTOR_LABELS:
        out = out.when(hexed.startswith(prefix), label)
    return out.otherwise("data")


def byte_classes(content: Column) -> Column:
    """``struct<zero, ff, printable, other>`` counts."""
    raw = F.decode(content, "ISO-8859-1")
    zero, ff = F.regexp_count(raw, F.lit(r"\x00")), F.regexp_count(raw, F.lit(r"\xff"))
    printable = F.regexp_count(raw, F.lit(r"[\x20-\x7e]"))
    return F.struct(zero.alias("zero"), ff.alias("ff"), printable.alias("printable"), (F.octet_length(content) - zero - ff - printable).alias("other"))


def probe(areas: DataFrame) -> DataFrame:
    """The first known file system of each image from its boot areas ``image_id, rank, start_byte, content``.

    ``rank`` orders the places: the device itself, then its MBR slots, then its GPT entries.
    """
    known = areas.select("image_id", "rank", "start_byte", fs_type(F.col("content")).alias("fs")).where("fs <> 'Unknown'")
    return known.groupBy("image_id").agg(F.min(F.struct("rank", "start_byte", "fs")).alias("f")).select("image_id", "f.start_byte", "f.fs")


def scan_boot_areas(chunks: DataFrame, step: int = 512) -> DataFrame:
    """``image_id, start_byte, fs`` of boot areas at every ``step`` bytes of ``image_id, base_offset, content, report`` chunks."""
    marks = ((3, b"NTFS    ", "NTFS"), (82, b"FAT32   ", "FAT32"), (54, b"FAT16   ", "FAT16"), (1080, b"\x53\xef", "ext4"))

    def places(data: bytes, at: int, mark: bytes, starts: np.ndarray) -> np.ndarray:
        """Starts that have ``mark`` at ``at``, all of them compared at once."""
        raw = np.frombuffer(data, np.uint8)
        inside = starts[starts + at + len(mark) <= len(raw)]
        fits = np.ones(len(inside), bool)
        for k, byte in enumerate(mark):
            fits &= raw[inside + at + k] == byte
        return inside[fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for image, base, data, report in zip(*(b[c].to_pylist() for c in ("image_id", "base_offset", "content", "report"))):
                if data is None or base is None:
                    continue
                starts, found = np.arange(-base % step, min(report if report is not None else len(data), len(data)), step), {}
                for at, mark, fs in marks:
                    for start in places(data, at, mark, starts).tolist():
                        found.setdefault(start, fs)
                rows += [(image, base + start, fs) for start, fs in sorted(found.items())]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["image_id", "start_byte", "fs"])

    return chunks.select("image_id", "base_offset", "content", "report").mapInArrow(run, "image_id bigint, start_byte bigint, fs string")


def read_table(images: DataFrame) -> DataFrame:
    """``image_id, slot, start_lba, size_lba, source`` of each first area: GPT where the MBR is protective, else MBR."""
    gpt = gpt_entries(images.where(is_protective(F.col("content"))))
    mbr = mbr_entries(images.where(~F.coalesce(is_protective(F.col("content")), F.lit(False))))
    return mbr.select("image_id", "slot", "start_lba", "size_lba", F.lit("MBR").alias("source")).unionByName(
        gpt.select("image_id", "slot", "start_lba", (F.col("end_lba") - F.col("start_lba") + 1).alias("size_lba"), F.lit("GPT").alias("source"))
    )


def with_fallback(table: DataFrame, recovered: DataFrame) -> DataFrame:
    """``table`` and, for images that have no entry in it, the partitions ``recovered`` by a scan."""
    missing = recovered.join(table.select("image_id").distinct(), "image_id", "left_anti")
    return table.unionByName(missing.select("image_id", "slot", "start_lba", "size_lba", F.lit("scan").alias("source")))
