"""What all listings share: the row, fields of bytes, times."""

from __future__ import annotations

import struct
from typing import NamedTuple

SCHEMA = (
    "image_id bigint, part_offset bigint, fs string, entry_id bigint, parent_id bigint, name string, path string, size bigint, is_dir boolean, "
    "is_deleted boolean, created bigint, modified bigint, data_offset bigint, chance string"
)


class Entry(NamedTuple):
    """One file or folder; times are Unix seconds, ``data_offset`` counts from the start of the volume."""

    entry_id: int
    parent_id: int | None
    name: str
    path: str | None
    size: int
    is_dir: bool
    is_deleted: bool
    created: int | None = None
    modified: int | None = None
    data_offset: int | None = None
    chance: str = "Unknown"


def u16(d: bytes, at: int) -> int:
    return struct.unpack_from("<H", d, at)[0]


def u32(d: bytes, at: int) -> int:
    return struct.unpack_from("<I", d, at)[0]


def u64(d: bytes, at: int) -> int:
    return struct.unpack_from("<Q", d, at)[0]


def filetime(value: int) -> int | None:
    """Unix seconds of a count of 100 ns since 1601; None for 0."""
    return value // 10_000_000 - 11_644_473_600 if value else None


def days_from_civil(year: int, month: int, day: int) -> int:
    """Days since 1970-01-01."""
    y = year - (month <= 2)
    era = y // 400
    doy = (153 * ((month + 9) % 12) + 2) // 5 + day - 1
    yoe = y - era * 400
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468


def dos_time(date: int, time: int) -> int | None:
    """Unix seconds of a FAT date and time; None for an empty or impossible date."""
    year, month, day = 1980 + (date >> 9), (date >> 5) & 15, date & 31
    if not date or not 1 <= month <= 12 or not 1 <= day <= 31:
        return None
    return days_from_civil(year, month, day) * 86_400 + (time >> 11) * 3600 + ((time >> 5) & 63) * 60 + (time & 31) * 2
