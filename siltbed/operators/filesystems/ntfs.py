"""NTFS volumes: file records of the master table, names, times, streams and runs."""

from __future__ import annotations

import bisect
import itertools
import struct
from collections.abc import Iterator

from siltbed.operators.filesystems.common import Entry, filetime, u16, u32, u64

ROOT = 5


class Boot:
    """Geometry of a volume from its boot sector."""

    def __init__(self, boot: bytes) -> None:
        if len(boot) < 512 or boot[3:11] != b"NTFS    ":
            raise ValueError("no NTFS volume")
        self.cluster = u16(boot, 11) * boot[13]
        self.table = u64(boot, 48) * self.cluster
        size = struct.unpack_from("<b", boot, 64)[0]
        self.record = 1 << -size if size <= 0 else size * self.cluster
        self.sector = u16(boot, 11)


def fixed_up(record: bytes, sector: int) -> bytes:
    """The record with the ends of its sectors put back; a sector that doesn't match stays as it is."""
    at, n = u16(record, 4), u16(record, 6)
    out = bytearray(record)
    if at + 2 * n > len(record):
        return record
    mark = record[at : at + 2]
    for k in range(1, n):
        end = k * sector
        if end <= len(out) and out[end - 2 : end] == mark:
            out[end - 2 : end] = record[at + 2 * k : at + 2 * k + 2]
    return bytes(out)


def runs(raw: bytes) -> Iterator[tuple[int | None, int]]:
    """Runs of clusters ``(first or None where sparse, count)``."""
    at, lcn = 0, 0
    while at < len(raw) and raw[at]:
        a, b = raw[at] & 15, raw[at] >> 4
        if at + 1 + a + b > len(raw):
            return
        count = int.from_bytes(raw[at + 1 : at + 1 + a], "little")
        if b:
            lcn += int.from_bytes(raw[at + 1 + a : at + 1 + a + b], "little", signed=True)
            yield lcn, count
        else:
            yield None, count
        at += 1 + a + b


def parse_record(raw: bytes, number: int, boot: Boot) -> list[Entry]:
    """The file of a record and one entry per named stream (``file:stream``); nothing for a void record."""
    if raw[:4] != b"FILE":
        return []
    r = fixed_up(raw, boot.sector)
    flags, at = u16(r, 22), u16(r, 20)
    name, space, parent, created, modified, size, first, streams = "", 99, None, None, None, 0, None, []
    while at + 16 <= len(r):
        kind, length = u32(r, at), u32(r, at + 4)
        if kind == 0xFFFFFFFF or length < 16 or at + length > len(r):
            break
        a = r[at : at + length]
        resident, label = a[8] == 0, a[u16(a, 10) : u16(a, 10) + 2 * a[9]].decode("utf-16-le", "replace")
        body = a[u16(a, 20) : u16(a, 20) + u32(a, 16)] if resident and length >= 24 else b""
        if kind == 0x10 and len(body) >= 16:
            created, modified = filetime(u64(body, 0)), filetime(u64(body, 8))
        elif kind == 0x30 and len(body) >= 66:
            rank = {1: 0, 3: 0, 0: 1}.get(body[65], 2)
            if rank < space:
                space, parent = rank, u64(body, 0) & 0xFFFFFFFFFFFF
                name = body[66 : 66 + 2 * body[64]].decode("utf-16-le", "replace")
        elif kind == 0x80:
            amount = len(body) if resident else u64(a, 48) if length >= 56 else 0
            start = None if resident or length < 34 else next((x for x, _ in runs(a[u16(a, 32) :]) if x is not None), None)
            if label:
                streams.append((label, amount, start))
            size = size or amount
            if first is None and not label:
                first = start
        at += length
    if not name:
        return []
    gone, folder = not flags & 1, bool(flags & 2)
    where = lambda lcn: None if lcn is None else lcn * boot.cluster
    chance = "Unknown" if not gone else "High" if first is not None and size > 0 else "Low" if size > 0 else "Unknown"
    out = [Entry(number, parent, name, None, size, folder, gone, created, modified, where(first), chance)]
    return out + [Entry(number, parent, f"{name}:{label}", None, n, False, gone, created, modified, where(lcn), chance) for label, n, lcn in streams]


def table_runs(data: bytes, base: int, boot: Boot) -> tuple[int | None, list[tuple[int, int]]]:
    """Records of the table and its stretches ``(place, bytes)``, by the data of record 0; ``None, []`` where that can't be read."""
    at = base + boot.table
    r = bytes(data[at : at + boot.record])
    if len(r) < boot.record or r[:4] != b"FILE":
        return None, []
    r = fixed_up(r, boot.sector)
    at = u16(r, 20)
    while at + 16 <= len(r):
        kind, length = u32(r, at), u32(r, at + 4)
        if kind == 0xFFFFFFFF or length < 16 or at + length > len(r):
            return None, []
        if kind == 0x80 and r[at + 8] and length >= 56:
            stretches = [(base + lcn * boot.cluster, n * boot.cluster) for lcn, n in runs(r[at + u16(r, at + 32) : at + length]) if lcn is not None]
            return u64(r, at + 48) // boot.record, stretches
        at += length
    return None, []


def n_records(data: bytes, base: int = 0) -> int:
    """Records to look at: those that record 0 counts or, where it can't be read, all that fit behind the table's begin."""
    boot = Boot(bytes(data[base : base + 512]))
    known, _ = table_runs(data, base, boot)
    return known if known is not None else max(0, len(data) - base - boot.table) // boot.record


def _piece(data: bytes, stretches: list[tuple[int, int]], starts: list[int], at: int, n: int) -> bytes:
    """``n`` bytes of a fragmented table from ``at`` on."""
    out, k = b"", max(0, bisect.bisect_right(starts, at) - 1)
    while len(out) < n and k < len(stretches):
        place, length = stretches[k]
        inside = at + len(out) - starts[k]
        out += bytes(data[place + inside : place + min(length, inside + n - len(out))])
        k += 1
        if inside >= length:
            break
    return out


def entries(data: bytes, base: int = 0, first: int = 0, count: int | None = None) -> Iterator[Entry]:
    """Entries of ``count`` records (all: None) from ``first`` on, read along the stretches of the table.

    Void records are passed over: the table ends with the records that record 0 counts, or with the data.
    Where record 0 can't be read, or its stretches begin elsewhere or are too short, the table is taken as contiguous.
    """
    boot = Boot(bytes(data[base : base + 512]))
    known, stretches = table_runs(data, base, boot)
    if not stretches or stretches[0][0] != base + boot.table or sum(n for _, n in stretches) < (known or 0) * boot.record:
        stretches = [(base + boot.table, max(0, len(data) - base - boot.table))]
    starts = [0, *itertools.accumulate(n for _, n in stretches[:-1])]
    total = n_records(data, base)
    for k in range(first, total if count is None else min(first + count, total)):
        raw = _piece(data, stretches, starts, k * boot.record, boot.record)
        if len(raw) < boot.record:
            return
        yield from parse_record(raw, k, boot)
