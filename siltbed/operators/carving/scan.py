"""Signature scan of device images, sizes and extraction, in Arrow batches of byte ranges.

An image is read in chunks of ``image_id, base_offset, content, report`` rows: ``content`` carries some bytes of the next
chunk, and only matches that begin in the first ``report`` bytes count, so every match is found exactly once.

Defined results: chunks without content give nothing; a match whose file would begin before the device is
dropped; several formats may be found at one offset; hits are ordered by offset, then by signature.
"""

from __future__ import annotations

import mmap
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.operators import intervals
from siltbed.operators.carving.checks import passes, prefiltered
from siltbed.operators.carving.signatures import SIGNATURES, Signature, header_positions
from siltbed.operators.carving.sizes import REQUIRED, resolve

CHUNK = 4 << 20
#: The longest header is 20 bytes; checks look further, so each chunk sees a little more of the next.
OVERLAP = 4096
CHUNK_SCHEMA = "image_id bigint, base_offset bigint, content binary, report int"
HITS = "image_id bigint, byte_offset bigint, signature string, extension string, ordinal int, gap bigint, gap_group string"


def image_chunks(spark: SparkSession, paths: list[tuple[int, str]], chunk: int = CHUNK, start: int = 0, end: int | None = None) -> DataFrame:
    """Chunk rows of raw image files ``(image_id, path)``; each task reads its own byte ranges.

    ``start`` and ``end`` limit the range. A chunk that can't be read is left out.
    """
    ranges = []
    for image, path in paths:
        size = os.path.getsize(path)
        stop = size if end is None else min(end, size)
        ranges.append((image, path, start, max(0, -(-(stop - start) // chunk)), stop))
    plan = spark.createDataFrame(ranges, "image_id bigint, path string, start bigint, n bigint, stop bigint")
    rows = plan.where("n > 0").select("image_id", "path", "stop", F.explode(F.expr(f"transform(sequence(0L, n - 1), k -> start + k * {chunk}L)")).alias("base_offset"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, path, stop, base in zip(*(b[c].to_pylist() for c in ("image_id", "path", "stop", "base_offset"))):
                try:
                    with open(path, "rb") as f:
                        f.seek(base)
                        data = f.read(min(chunk + OVERLAP, stop - base))
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array([image], pa.int64()), pa.array([base], pa.int64()), pa.array([data], pa.binary()), pa.array([min(chunk, stop - base)], pa.int32())],
                    names=["image_id", "base_offset", "content", "report"],
                )

    return rows.repartition(F.col("base_offset")).mapInArrow(read, CHUNK_SCHEMA)


def find_all(sig: Signature, data: bytes, base: int, report: int) -> Iterator[int]:
    """Offsets of the files whose headers begin in the first ``report`` bytes and pass the check."""
    for at in sig.positions(data, report):
        if base + at >= sig.header_offset and passes(sig.check, data, at):
            yield base + at - sig.header_offset


class Matcher:
    """All headers at once: one look-up over pairs of bytes finds the places worth comparing.

    Each header is represented by one pair of its fixed bytes, preferably without zeros, which fill disks. Headers
    with a single fixed byte are looked up by what their checks ask of other bytes.
    """

    def __init__(self, signatures: list[Signature]) -> None:
        groups: dict[tuple, list[Signature]] = {}
        for s in signatures:
            groups.setdefault(s.header, []).append(s)
        self.pairs: dict[int, list[tuple[int, int, list[tuple[int, bytes]], list[Signature]]]] = {}
        self.single: list[tuple[tuple, list[Signature]]] = []
        self.table = np.zeros(65536, bool)
        for header, same in groups.items():
            fit = [k for k in range(len(header) - 1) if header[k] is not None and header[k + 1] is not None]
            if not fit:
                self.single.append((header, same))
                continue
            at = min(fit, key=lambda k: (sum(b in (0, 0xFF, 0x20) for b in header[k : k + 2]), k))
            code = header[at] << 8 | header[at + 1]
            self.table[code] = True
            segments = [(m.start(), bytes(header[m.start() : m.end()])) for m in re.finditer("x+", "".join("." if b is None else "x" for b in header))]
            self.pairs.setdefault(code, []).append((at, len(header), segments, same))

    def find(self, data: bytes, report: int) -> Iterator[tuple[int, Signature]]:
        """Matches that begin in the first ``report`` bytes and pass their checks."""
        raw = np.frombuffer(data, np.uint8)
        codes = raw[:-1].astype(np.uint16) << 8 | raw[1:] if len(raw) > 1 else raw[:0].astype(np.uint16)
        for at, code in zip((places := np.flatnonzero(self.table[codes])).tolist(), codes[places].tolist()):
            for offset, size, segments, same in self.pairs[code]:
                start = at - offset
                if 0 <= start < report and start + size <= len(data) and all(data[start + k : start + k + len(x)] == x for k, x in segments):
                    for s in same:
                        if passes(s.check, data, start):
                            yield start, s
        for header, same in self.single:
            found = prefiltered(same[0].check, data, header, report) if len(same) == 1 else None
            for start in header_positions(header, data, report) if found is None else found:
                for s in same:
                    if passes(s.check, data, start):
                        yield start, s


def scan(chunks: DataFrame, signatures: list[Signature] = SIGNATURES) -> DataFrame:
    """All header matches that pass their checks, before gaps are enforced."""
    matcher = Matcher(signatures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for image, base, data, report in zip(*(b[c].to_pylist() for c in ("image_id", "base_offset", "content", "report"))):
                for at, s in matcher.find(data or b"", report):
                    if base + at >= s.header_offset:
                        rows.append((image, base + at - s.header_offset, s.name, s.extension, s.ordinal, s.min_hit_gap, s.suppress_group or s.name))
            cols = list(zip(*rows)) or [[]] * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in HITS.split(", ")])

    return chunks.select("image_id", "base_offset", "content", "report").mapInArrow(run, HITS)


def suppress(hits: DataFrame) -> DataFrame:
    """Hits after the minimum gaps; those without one skip the ordered walk."""
    free = hits.where("gap = 0")
    held = intervals.suppress_gap(hits.where("gap > 0"), ["image_id", "gap_group"], "byte_offset", "gap", "ordinal")
    return free.unionByName(held)


def sized(hits: DataFrame, paths: dict[int, str], signatures: list[Signature] = SIGNATURES) -> DataFrame:
    """Hits with ``size`` and ``status`` (Ok, Truncated, Skipped) by size rule, footer, and the limits of the format."""
    table = {s.name: s for s in signatures}

    def extent(s: Signature, data: mmap.mmap | bytes, at: int, end: int) -> tuple[int, str]:
        cap = min(s.max_size, end - at)
        hint = resolve(s.size_rule, data, at, s.max_size)
        if hint is None and s.size_rule in REQUIRED:
            return 0, "Skipped"
        size = cap if hint is None else min(hint, cap)
        if hint is None and s.footer:
            where = data.rfind(s.footer, at, at + cap) if s.footer_last else data.find(s.footer, at, at + cap)
            if where >= 0:
                size = min(where - at + len(s.footer) + s.footer_extra, cap)
        if s.min_size and size < s.min_size:
            return 0, "Skipped"
        return size, "Truncated" if size >= s.max_size else "Ok"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, mmap.mmap | bytes] = {}
        for b in batches:
            sizes, states = [], []
            for image, at, name in zip(b["image_id"].to_pylist(), b["byte_offset"].to_pylist(), b["signature"].to_pylist()):
                if image not in opened:
                    with open(paths[image], "rb") as f:
                        opened[image] = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
                size, state = extent(table[name], opened[image], at, len(opened[image]))
                sizes.append(size)
                states.append(state)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64()), pa.array(states, pa.string())], names=[*b.schema.names, "size", "status"])

    return hits.mapInArrow(run, HITS + ", size bigint, status string")


def summary(extracted: DataFrame) -> DataFrame:
    """Counts per status and the bytes written."""
    return extracted.groupBy("status").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def duplicates(hits: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """``hits`` with ``duplicate``: whether an earlier hit has the same first 4 KiB.

    ``fingerprints``: ``image_id, byte_offset, fingerprint`` (null where they can't be read: no duplicate). The
    first hit of each fingerprint is an aggregate, so many copies are reduced before the shuffle.
    """
    first = fingerprints.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min(F.struct("image_id", "byte_offset")).alias("f"))
    marked = fingerprints.distinct().join(first, "fingerprint", "left")
    known = marked.select("image_id", "byte_offset", (F.struct("image_id", "byte_offset") != F.col("f")).alias("duplicate"))
    return hits.join(known, ["image_id", "byte_offset"], "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def fingerprints(hits: DataFrame, paths: dict[int, str], size: int = 4096) -> DataFrame:
    """``image_id, byte_offset, fingerprint`` from the first bytes at each hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            out = []
            for image, at in zip(b["image_id"].to_pylist(), b["byte_offset"].to_pylist()):
                try:
                    with open(paths[image], "rb") as f:
                        f.seek(at)
                        out.append(hashlib.sha256(f.read(size)).hexdigest())
                except (OSError, KeyError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b["image_id"], b["byte_offset"], pa.array(out, pa.string())], names=["image_id", "byte_offset", "fingerprint"])

    return hits.select("image_id", "byte_offset").mapInArrow(run, "image_id bigint, byte_offset bigint, fingerprint string")
