"""Whether an extracted file is whole: Complete, Truncated, Corrupt or Unknown.

Judged from the whole content where the format has a walk, else from its first 8 KiB and last 64 KiB. OLE2, 7-Zip and
PST have no rule here and are Unknown. Defined results: null content is Unknown, empty content Corrupt where there is a rule.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed.operators.carving.sizes import vint_ebml

HEAD, TAIL = 8 << 10, 64 << 10


def _printable(raw: bytes) -> bool:
    return len(raw) > 0 and all(0x20 <= b < 0x7F for b in raw)


def jpeg(d: bytes) -> bool:
    at = 2
    while at + 4 <= len(d) and d[at] == 0xFF and 0xE0 <= d[at + 1] <= 0xEF:
        at += 2 + struct.unpack_from(">H", d, at + 2)[0]
    return d.endswith(b"\xff\xd9") and b"\xff\xd8" not in d[at:HEAD]


def png(d: bytes) -> bool:
    at = 8
    if d[:8] != b"\x89PNG\r\n\x1a\n":
        return False
    while at + 12 <= len(d):
        n, kind = struct.unpack_from(">I", d, at)[0], d[at + 4 : at + 8]
        if not kind.isalpha() or at + 12 + n > len(d):
            return False
        if n <= 65536 and zlib.crc32(d[at + 4 : at + 8 + n]) != struct.unpack_from(">I", d, at + 8 + n)[0]:
            return False
        if kind == b"IEND":
            return n == 0
        at += 12 + n
    return False


def html(d: bytes) -> bool:
    try:
        tail, head = d[-TAIL:].decode("utf-8", "strict" if len(d) <= TAIL else "ignore"), d[:HEAD].decode("utf-8", "strict" if len(d) <= HEAD else "ignore")
    except UnicodeDecodeError:
        return False
    if not tail.rstrip().endswith(("</html>", "</HTML>")):
        return False
    return "<body" not in head or len(re.sub(r"\s", "", re.sub(r"<[^>]*>", "", head))) >= 32


def gif(d: bytes) -> bool:
    return d.endswith(b"\x3b")


def pdf(d: bytes) -> bool:
    tail = d[-1024:]
    found = re.findall(rb"startxref\s+(\d+)", tail)
    if b"%%EOF" not in tail or not found or not 0 < int(found[-1]) < len(d):
        return False
    place = d[int(found[-1]) :][:64].lstrip()
    return place.startswith(b"xref") or place[:1].isdigit()


def zip_end(d: bytes) -> bool:
    at = d[-TAIL:].rfind(b"PK\x05\x06")
    end = d[-TAIL:][at : at + 22] if at >= 0 else b""
    if len(end) < 20:
        return False
    offset = struct.unpack_from("<I", end, 16)[0]
    return offset == 0xFFFFFFFF or offset <= len(d)


def sqlite(d: bytes) -> bool:
    if d[:16] != b"SQLite format 3\0" or len(d) < 101:
        return False
    page, n, kinds = struct.unpack_from(">H", d, 16)[0], struct.unpack_from(">I", d, 28)[0], (0, 2, 5, 10, 13)
    page = 65536 if page == 1 else page
    if page < 512 or n == 0 or d[100] not in kinds:
        return False
    seen = [d[k * page] in kinds for k in range(1, 6) if k < n and k * page < len(d)]
    return not (len(seen) >= 2 and sum(seen) * 2 <= len(seen))


def evtx(d: bytes) -> bool:
    return d[:8] == b"ElfFile\0" and d[4096:4104] == b"ElfChnk\0" and len(d) >= 4148 and 512 <= struct.unpack_from("<I", d, 4144)[0] <= 65536


def riff(d: bytes) -> bool:
    order = {b"RIFF": "<", b"FORM": ">"}.get(d[:4])
    if order is None or not _printable(d[8:12]):
        return False
    at, good = 12, 0
    for _ in range(10):
        if at + 8 > len(d):
            break
        n = struct.unpack_from(order + "I", d, at + 4)[0]
        good += _printable(d[at : at + 4]) and n < len(d)
        at += 8 + n + n % 2
    return good >= 3


def exe(d: bytes) -> bool:
    if d[:2] != b"MZ" or len(d) < 64:
        return False
    at = struct.unpack_from("<I", d, 60)[0]
    if at < 64 or at + 24 > len(d) or d[at : at + 4] != b"PE\0\0":
        return False
    n, optional = struct.unpack_from("<H", d, at + 6)[0], struct.unpack_from("<H", d, at + 20)[0]
    table = at + 24 + optional
    if not 1 <= n <= 96 or optional > 8192 or table + 40 * n > len(d):
        return False
    good = 0
    for k in range(min(n, 32)):
        name, (size, where) = d[table + 40 * k : table + 40 * k + 8].rstrip(b"\0"), struct.unpack_from("<II", d, table + 40 * k + 16)
        good += _printable(name) and where + size <= len(d)
    return good * 2 > min(n, 32)


def boxes(d: bytes) -> bool:
    at, kinds = 0, set()
    for _ in range(64):
        if at + 8 > len(d):
            break
        n, kind = struct.unpack_from(">I", d, at)[0], d[at + 4 : at + 8]
        if n == 1 and at + 16 <= len(d):
            n = struct.unpack_from(">Q", d, at + 8)[0]
        n = len(d) - at if n == 0 else n
        if not _printable(kind) or n < 8 or at + n > len(d):
            return False
        kinds.add(kind)
        at += n
    return b"ftyp" in kinds and bool(kinds & {b"moov", b"mdat"})


def ebml(d: bytes) -> bool:
    head = vint_ebml(d, 4) if d[:4] == b"\x1a\x45\xdf\xa3" else None
    if head is None:
        return False
    at = head[1] + head[0]
    body = vint_ebml(d, at + 4) if d[at : at + 4] == b"\x18\x53\x80\x67" else None
    return body is not None and (body[2] or body[0] > 0)


def flac(d: bytes) -> bool:
    at = 4
    if d[:4] != b"fLaC":
        return False
    for k in range(16):
        if at + 4 > len(d):
            return False
        kind, n = d[at] & 0x7F, int.from_bytes(d[at + 1 : at + 4], "big")
        if kind > 6 or (k == 0 and (kind != 0 or n != 34)) or at + 4 + n > len(d):
            return False
        if d[at] & 0x80:
            return True
        at += 4 + n
    return True


def elf(d: bytes) -> bool:
    if d[:4] != b"\x7fELF" or len(d) < 64 or d[4] not in (1, 2) or d[5] not in (1, 2):
        return False
    o, wide = "<" if d[5] == 1 else ">", d[4] == 2
    table = struct.unpack_from(o + ("Q" if wide else "I"), d, 32 if wide else 28)[0]
    size, n = struct.unpack_from(o + "HH", d, 54 if wide else 42)
    if n == 0:
        return True
    if n > 256 or size != (56 if wide else 32) or table + size * n > len(d):
        return False
    good = 0
    for k in range(min(n, 16)):
        at = table + size * k
        where, amount = (struct.unpack_from(o + "Q", d, at + 8)[0], struct.unpack_from(o + "Q", d, at + 32)[0]) if wide else (struct.unpack_from(o + "I", d, at + 4)[0], struct.unpack_from(o + "I", d, at + 16)[0])
        good += amount == 0 or where + amount <= len(d)
    return good * 2 > min(n, 16)


def regf(d: bytes) -> bool:
    return d[:4] == b"regf" and d[4096:4100] == b"hbin"


def tiff(d: bytes) -> bool:
    o = {b"II": "<", b"MM": ">"}.get(d[:2])
    if o is None or len(d) < 8 or struct.unpack_from(o + "H", d, 2)[0] not in (0x2A, 0x55, 0x4F52):
        return False
    sizes, at, seen, good, all_ = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8, 4), struct.unpack_from(o + "I", d, 4)[0], set(), 0, 0
    while at and at not in seen and len(seen) < 16:
        seen.add(at)
        if at + 2 > len(d):
            return False
        n = struct.unpack_from(o + "H", d, at)[0]
        for k in range(min(n, 64)):
            e = at + 2 + 12 * k
            if e + 12 > len(d):
                break
            kind, count, value = struct.unpack_from(o + "HII", d, e + 2)
            all_ += 1
            good += 1 <= kind < len(sizes) and (count * sizes[kind] <= 4 or value + count * sizes[kind] <= len(d))
        nxt = at + 2 + 12 * n
        at = struct.unpack_from(o + "I", d, nxt)[0] if nxt + 4 <= len(d) else 0
    return all_ > 0 and good * 2 > all_


RULES: dict[str, Callable[[bytes], bool]] = {
    **dict.fromkeys(("jpg", "jpeg"), jpeg), "png": png, **dict.fromkeys(("html", "htm"), html), "gif": gif, "pdf": pdf, **dict.fromkeys(("zip", "epub", "odt", "jar", "docx", "xlsx", "pptx"), zip_end),
    **dict.fromkeys(("db", "sqlite"), sqlite), "evtx": evtx, **dict.fromkeys(("wav", "avi", "webp", "aif", "aiff"), riff), **dict.fromkeys(("exe", "dll"), exe),
    **dict.fromkeys(("mp4", "mov", "m4v", "m4a", "3gp", "heic", "cr3"), boxes), **dict.fromkeys(("mkv", "webm"), ebml), "flac": flac, **dict.fromkeys(("elf", "so"), elf), **dict.fromkeys(("dat", "regf"), regf),
    **dict.fromkeys(("tif", "tiff", "arw", "cr2", "nef", "pef", "dcr", "sr2", "rw2", "orf"), tiff),
}


def judge(extension: str | None, content: bytes | None, truncated: bool = False) -> str:
    """State of one file."""
    if truncated:
        return "Truncated"
    rule = RULES.get((extension or "").lower())
    if rule is None or content is None:
        return "Unknown"
    try:
        return "Complete" if rule(content) else "Corrupt"
    except (struct.error, IndexError, ValueError):
        return "Corrupt"


def quality(extension: Column, content: Column, truncated: Column) -> Column:
    """State of each row's file."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for e, c, t in batches:
            yield pd.Series([judge(x, y, bool(z)) for x, y, z in zip(e, c, t)], dtype=object)

    return run(extension, content, F.coalesce(truncated, F.lit(False)))
