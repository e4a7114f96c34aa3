"""What the first 64 KiB of a recovered file tell about it, and names stored inside.

Defined results: formats without a reader give only the format; damaged or short content gives what could be read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 64 << 10


def jpeg(d: bytes) -> dict[str, str]:
    at, out = 2, {}
    while at + 9 <= len(d) and d[at] == 0xFF:
        kind, n = d[at + 1], struct.unpack_from(">H", d, at + 2)[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", d, at + 5)
            out["size"] = f"{w}x{h}"
            break
        if kind == 0xE1 and (m := re.search(rb"(\d{4}:\d\d:\d\d \d\d:\d\d:\d\d)\0", d[at : at + 2 + n])):
            out["date"] = m[1].decode()
        at += 2 + n
    return out


def png(d: bytes) -> dict[str, str]:
    w, h, bits, kind = struct.unpack_from(">IIBB", d, 16)
    return {"size": f"{w}x{h}", "color": {0: "gray", 2: "rgb", 3: "palette", 4: "gray+alpha", 6: "rgb+alpha"}.get(kind, "unknown"), "bits": str(bits)}


def bmp(d: bytes) -> dict[str, str]:
    w, h = struct.unpack_from("<ii", d, 18)
    return {"size": f"{w}x{abs(h)}", "bits": str(struct.unpack_from("<H", d, 28)[0])}


def gif(d: bytes) -> dict[str, str]:
    w, h = struct.unpack_from("<HH", d, 6)
    return {"size": f"{w}x{h}", "version": d[3:6].decode("latin-1")}


def _id3_text(raw: bytes) -> str:
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(code, "replace").strip("\0")


def mp3(d: bytes) -> dict[str, str]:
    names, out, at = {b"TIT2": "title", b"TPE1": "artist", b"TALB": "album"}, {}, 10
    while at + 10 <= len(d) and d[at : at + 4].isalnum():
        n = struct.unpack_from(">I", d, at + 4)[0] if d[3] < 4 else sum(b << (7 * (3 - k)) for k, b in enumerate(d[at + 4 : at + 8]))
        if d[at : at + 4] in names:
            out[names[d[at : at + 4]]] = _id3_text(d[at + 10 : at + 10 + n])
        at += 10 + n
    return out


def flac(d: bytes) -> dict[str, str]:
    rate = int.from_bytes(d[18:21], "big") >> 4
    return {"rate": str(rate), "channels": str(((d[20] >> 1) & 7) + 1)} if len(d) >= 26 else {}


def archive(d: bytes) -> dict[str, str]:
    names, at = [], 0
    while len(names) < 8 and d[at : at + 4] == b"PK\3\4" and at + 30 <= len(d):
        size, n, extra = struct.unpack_from("<I", d, at + 18)[0], *struct.unpack_from("<HH", d, at + 26)
        names.append(d[at + 30 : at + 30 + n].decode("utf-8", "replace"))
        at += 30 + n + extra + size
    return {"entries": ", ".join(names)}


def pdf(d: bytes) -> dict[str, str]:
    return {k.lower(): m[1].decode("latin-1") for k in ("Title", "Author", "Creator") if (m := re.search(rb"/" + k.encode() + rb"\s*\(([^)]{0,200})\)", d))}


def sqlite(d: bytes) -> dict[str, str]:
    page = struct.unpack_from(">H", d, 16)[0]
    return {"page_size": str(65536 if page == 1 else page), "pages": str(struct.unpack_from(">I", d, 28)[0])}


def exe(d: bytes) -> dict[str, str]:
    at = struct.unpack_from("<I", d, 60)[0]
    machine, n = struct.unpack_from("<HH", d, at + 4)
    kind = struct.unpack_from("<H", d, at + 24 + 68)[0]
    return {"machine": {0x14C: "x86", 0x8664: "x64", 0xAA64: "arm64"}.get(machine, hex(machine)), "sections": str(n), "subsystem": {2: "windows", 3: "console"}.get(kind, str(kind))}


READERS: dict[str, Callable[[bytes], dict[str, str]]] = {
    "jpg": jpeg, "png": png, "bmp": bmp, "gif": gif, "mp3": mp3, "flac": flac, "zip": archive, "docx": archive, "jar": archive, "epub": archive, "pdf": pdf, "db": sqlite, "sqlite": sqlite, "exe": exe, "dll": exe,
}


def describe(extension: str | None, content: bytes | None) -> dict[str, str]:
    """Facts about a file; ``format`` is always there."""
    ext = (extension or "").lower()
    out = {"format": ext.upper()}
    if ext in READERS and content:
        try:
            out |= READERS[ext](content[:WINDOW])
        except (struct.error, IndexError, UnicodeDecodeError):
            pass
    return out


def lnk_name(d: bytes) -> str | None:
    """Last part of the target path of a shell link."""
    try:
        at = 76
        flags = struct.unpack_from("<I", d, 20)[0]
        if flags & 1:
            at += 2 + struct.unpack_from("<H", d, at)[0]
        if not flags & 2:
            return None
        base, suffix = struct.unpack_from("<I", d, at + 16)[0], struct.unpack_from("<I", d, at + 24)[0]
        text = lambda o: d[at + o : d.index(b"\0", at + o)].decode("latin-1") if o else ""
        return re.split(r"[\\/]", (text(base) + text(suffix)).rstrip("\\/"))[-1] or None
    except (struct.error, ValueError, IndexError):
        return None


def prefetch_name(d: bytes) -> str | None:
    """Program name in a prefetch file, in lower case."""
    raw = d[16:74].decode("utf-16-le", "replace").split("\0")[0]
    return re.sub(r'[\\/:*?<>|"]', "_", raw).lower() or None


def preview(extension: Column, content: Column) -> Column:
    """Facts of each row's file as a map."""

    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for e, c in batches:
            yield pd.Series([describe(x, y) for x, y in zip(e, c)], dtype=object)

    return run(extension, content)
