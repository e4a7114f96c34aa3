"""Sizes of files from their own structure.

``resolve(rule, data, start, limit)`` gives the bytes from ``start`` on, or None where the structure doesn't tell. ``data`` is
any object that slices to bytes (a buffer or a mapped image), so a walk may jump far ahead.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Walk = Callable[..., int | None]


def _u(d: bytes, at: int, n: int, order: str) -> int | None:
    raw = bytes(d[at : at + n])
    return int.from_bytes(raw, "little" if order == "le" else "big") if len(raw) == n else None


def linear(d: bytes, p: int, at: int, n: int, order: str, scale: int, add: int) -> int | None:
    value = _u(d, p + at, n, order) if n in (2, 4, 8) else None
    return None if value is None else min(value * scale + add, (1 << 63) - 1)


def ole2(d: bytes, p: int, limit: int) -> int | None:
    shift, n = _u(d, p + 30, 2, "le"), _u(d, p + 44, 4, "le")
    if shift is None or n is None or not 7 <= shift <= 16:
        return None
    sector = 1 << shift
    return (n * (sector // 4) + 1) * sector


def sqlite(d: bytes, p: int, limit: int) -> int | None:
    page, n = _u(d, p + 16, 2, "be"), _u(d, p + 28, 4, "be")
    page = 65536 if page == 1 else page
    return page * n if page and n and page >= 512 else None


def seven_zip(d: bytes, p: int, limit: int) -> int | None:
    a, b = _u(d, p + 12, 8, "le"), _u(d, p + 20, 8, "le")
    return None if a is None or b is None else min(32 + a + b, (1 << 63) - 1)


def ogg_stream(d: bytes, p: int, limit: int) -> int | None:
    at = p
    for _ in range(100_000):
        if bytes(d[at : at + 4]) != b"OggS":
            return at - p or None
        head = bytes(d[at : at + 27])
        if len(head) < 27:
            return None
        table = bytes(d[at + 27 : at + 27 + head[26]])
        at += 27 + head[26] + sum(table)
        if head[5] & 4:
            return at - p
    return None


def mp4(d: bytes, p: int, limit: int) -> int | None:
    at = p
    for _ in range(2000):
        size, kind = _u(d, at, 4, "be"), bytes(d[at + 4 : at + 8])
        if size is None or len(kind) < 4 or not all(0x20 <= b < 0x7F for b in kind) or size == 0:
            break
        if size == 1:
            size = _u(d, at + 8, 8, "be")
            if size is None or size < 16:
                break
        elif size < 8:
            break
        at += size
        if at - p > limit:
            break
    return at - p or None


_TIFF_SIZES = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8, 4)


def tiff(d: bytes, p: int, limit: int) -> int | None:
    order = {b"II": "le", b"MM": "be"}.get(bytes(d[p : p + 2]))
    first = _u(d, p + 4, 4, order) if order else None
    if first is None:
        return None
    seen, todo, end = set(), [first], 8
    while todo and len(seen) < 64:
        at = todo.pop()
        if at in seen or at < 8:
            continue
        seen.add(at)
        n = _u(d, p + at, 2, order)
        if n is None or n > 1000:
            continue
        tags: dict[int, list[int]] = {}
        end = max(end, at + 2 + 12 * n + 4)
        for k in range(n):
            e = p + at + 2 + 12 * k
            tag, kind, count = _u(d, e, 2, order), _u(d, e + 2, 2, order), _u(d, e + 4, 4, order)
            if tag is None or kind is None or count is None or not 1 <= kind < len(_TIFF_SIZES):
                continue
            width = _TIFF_SIZES[kind]
            where = e + 8
            if count * width > 4:
                far = _u(d, e + 8, 4, order) or 0
                end, where = max(end, far + count * width), p + far
            if tag in (0x111, 0x117, 0x144, 0x145, 0x201, 0x202, 0x14A) and kind in (3, 4) and count <= 100_000:
                tags[tag] = [v for j in range(count) if (v := _u(d, where + j * width, width, order)) is not None]
        for a, b in ((0x111, 0x117), (0x144, 0x145), (0x201, 0x202)):
            end = max([end, *(x + y for x, y in zip(tags.get(a, []), tags.get(b, [])))])
        todo += tags.get(0x14A, [])
        if following := _u(d, p + at + 2 + 12 * n, 4, order):
            todo.append(following)
    return end if seen and end > 8 else None


def raf(d: bytes, p: int, limit: int) -> int | None:
    v = [_u(d, p + k, 4, "be") for k in (84, 88, 92, 96)]
    return None if None in v else max(v[0] + v[1], v[2] + v[3]) or None


def mpeg_ts(d: bytes, p: int, limit: int, off: int, stride: int) -> int | None:
    at, good, misses = p, 0, 0
    while at - p < limit and misses < 10:
        b = bytes(d[at + off : at + off + 1])
        if not b:
            break
        if b == b"\x47":
            good, misses = at + stride - p, 0
        else:
            misses += 1
        at += stride
    return good or None


def pe(d: bytes, p: int, limit: int) -> int | None:
    at = _u(d, p + 60, 4, "le")
    if at is None or not 64 <= at <= 16384 or bytes(d[p + at : p + at + 4]) != b"PE\0\0":
        return None
    n, optional = _u(d, p + at + 6, 2, "le"), _u(d, p + at + 20, 2, "le")
    if n is None or optional is None or not 1 <= n <= 256:
        return None
    table = at + 24 + optional
    end = table + 40 * n
    for k in range(n):
        size, where = _u(d, p + table + 40 * k + 16, 4, "le"), _u(d, p + table + 40 * k + 20, 4, "le")
        end = max(end, (size or 0) + (where or 0) if size else 0)
    return end


def elf(d: bytes, p: int, limit: int) -> int | None:
    wide, order = bytes(d[p + 4 : p + 5]) == b"\x02", {b"\x01": "le", b"\x02": "be"}.get(bytes(d[p + 5 : p + 6]))
    if order is None:
        return None
    places = ((32, 8), (40, 8), (54, 2), (56, 2), (58, 2), (60, 2)) if wide else ((28, 4), (32, 4), (42, 2), (44, 2), (46, 2), (48, 2))
    v = [_u(d, p + a, n, order) for a, n in places]
    if None in v:
        return None
    ph, sh, ph_size, ph_n, sh_size, sh_n = v
    end = max(sh + sh_size * sh_n if sh else 0, ph + ph_size * ph_n if ph else 0)
    for k in range(ph_n):
        e = p + ph + k * ph_size
        a, n = (_u(d, e + 8, 8, order), _u(d, e + 32, 8, order)) if wide else (_u(d, e + 4, 4, order), _u(d, e + 16, 4, order))
        if a is not None and n is not None:
            end = max(end, a + n)
    return end or None


def vint_rar5(d: bytes, at: int) -> tuple[int, int] | None:
    value = 0
    for k in range(10):
        b = bytes(d[at + k : at + k + 1])
        if not b:
            return None
        value |= (b[0] & 0x7F) << (7 * k)
        if not b[0] & 0x80:
            return value, at + k + 1
    return None


def rar(d: bytes, p: int, limit: int) -> int | None:
    new = bytes(d[p + 6 : p + 8]) == b"\x01\0"
    at = p + (8 if new else 7)
    begin = at
    for _ in range(100_000):
        if new:
            size = vint_rar5(d, at + 4)
            kind = vint_rar5(d, size[1]) if size else None
            flags = vint_rar5(d, kind[1]) if kind else None
            if not flags:
                break
            extra = vint_rar5(d, flags[1]) if flags[0] & 1 else (0, flags[1])
            data = vint_rar5(d, extra[1]) if extra and flags[0] & 2 else (0, 0)
            if extra is None or data is None:
                break
            at, last = size[1] + size[0] + data[0], kind[0] == 5
        else:
            kind, flags, size = _u(d, at + 2, 1, "le"), _u(d, at + 3, 2, "le"), _u(d, at + 5, 2, "le")
            if size is None or size < 7 or not 0x72 <= kind <= 0x7B:
                break
            at, last = at + size + (_u(d, at + 7, 4, "le") or 0 if flags & 0x8000 or kind == 0x74 else 0), kind == 0x7B
        if last:
            return at - p
        if at - p > limit:
            break
    return at - p if at > begin else None


def vint_ebml(d: bytes, at: int) -> tuple[int, int, bool] | None:
    """Value, end, and whether the size is unknown."""
    b = bytes(d[at : at + 1])
    if not b or b[0] == 0:
        return None
    n = 9 - b[0].bit_length()
    raw = bytes(d[at : at + n])
    if len(raw) < n:
        return None
    value = int.from_bytes(raw, "big") & ((1 << (7 * n)) - 1)
    return value, at + n, value == (1 << (7 * n)) - 1


def ebml(d: bytes, p: int, limit: int) -> int | None:
    head = vint_ebml(d, p + 4)
    if head is None or head[2]:
        return None
    at = head[1] + head[0]
    if bytes(d[at : at + 4]) != b"\x18\x53\x80\x67":
        return None
    body = vint_ebml(d, at + 4)
    return None if body is None or body[2] else body[1] + body[0] - p


_NOT_TEXT = re.compile(rb"\0|[^\t\n\r\x20-\x7e\x80-\xbf\xc2-\xf4]{8}")


def text_bound(d: bytes, p: int, limit: int) -> int | None:
    raw = bytes(d[p : p + limit])
    m = _NOT_TEXT.search(raw)
    raw = raw[: m.start()] if m else raw
    return len(re.sub(rb"[^\t\n\r\x20-\x7e\x80-\xbf\xc2-\xf4]+\Z", b"", raw)) or None


def ttf(d: bytes, p: int, limit: int) -> int | None:
    n = _u(d, p + 4, 2, "be")
    if not n or n > 100:
        return None
    ends = [(_u(d, p + 12 + 16 * k + 8, 4, "be"), _u(d, p + 12 + 16 * k + 12, 4, "be")) for k in range(n)]
    return None if any(None in e for e in ends) else max(a + b for a, b in ends)


def pdf(d: bytes, p: int, limit: int) -> int | None:
    head = bytes(d[p : p + 256])
    m = re.search(rb"/L[ ]+[ \t]*(\d+)", head) if b"/Linearized" in head else None
    return int(m[1]) or None if m else None


def gif(d: bytes, p: int, limit: int) -> int | None:
    flags = _u(d, p + 10, 1, "le")
    if flags is None:
        return None
    at = p + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    for _ in range(10_000):
        kind = bytes(d[at : at + 1])
        if kind == b"\x3b":
            return at + 1 - p
        if kind == b"\x21":
            at += 2
        elif kind == b"\x2c":
            local = _u(d, at + 9, 1, "le")
            if local is None:
                return None
            at += 10 + (3 << ((local & 7) + 1) if local & 0x80 else 0) + 1
        else:
            return None
        while True:
            n = _u(d, at, 1, "le")
            if n is None or at - p > limit:
                return None
            at += n + 1
            if n == 0:
                break
    return None


def png(d: bytes, p: int, limit: int) -> int | None:
    at = p + 8
    for _ in range(10_000):
        n, kind = _u(d, at, 4, "be"), bytes(d[at + 4 : at + 8])
        if n is None or n > 1 << 28 or len(kind) < 4 or not kind.isalpha():
            return None
        at += 12 + n
        if kind == b"IEND":
            return at - p
    return None


def jpeg(d: bytes, p: int, limit: int) -> int | None:
    at = p + 2
    for _ in range(512):
        marker, n = bytes(d[at : at + 2]), _u(d, at + 2, 2, "be")
        if len(marker) < 2 or marker[0] != 0xFF or n is None:
            return None
        if marker[1] == 0xD9:
            return at + 2 - p
        at += 2 + n
        if marker[1] == 0xDA:
            while at - p < limit:
                piece = bytes(d[at : at + (1 << 20)])
                end = piece.find(b"\xff\xd9")
                if end >= 0:
                    return at + end + 2 - p
                if len(piece) < 1 << 20:
                    return None
                at += len(piece) - 1
            return None
    return None


def iso9660(d: bytes, p: int, limit: int) -> int | None:
    n, block = _u(d, p + 32768 + 80, 4, "le"), _u(d, p + 32768 + 128, 2, "le")
    return n * block if n and block in {1 << k for k in range(9, 16)} else None


_ASF_FILE = bytes.fromhex("A1DCAB8C47A9CF118EE400C00C205365")


def asf(d: bytes, p: int, limit: int) -> int | None:
    n, at = _u(d, p + 24, 4, "le"), p + 30
    for _ in range(min(n or 0, 1000)):
        size = _u(d, at + 16, 8, "le")
        if size is None or size < 24:
            return None
        if bytes(d[at : at + 16]) == _ASF_FILE:
            return _u(d, at + 40, 8, "le") or None
        at += size
    return None


def tar(d: bytes, p: int, limit: int) -> int | None:
    at, zeros = p, 0
    for _ in range(200_000):
        head = bytes(d[at : at + 512])
        if len(head) < 512:
            return at - p or None
        if not any(head):
            zeros, at = zeros + 1, at + 512
            if zeros == 2:
                return at - p
            continue
        zeros = 0
        octal = head[124:136].strip(b" \0")
        if not re.fullmatch(rb"[0-7]*", octal):
            return None
        at += 512 + -(-int(octal or b"0", 8) // 512) * 512
    return at - p


def mpeg_ps(d: bytes, p: int, limit: int) -> int | None:
    end, last, at, cap = None, p, p, min(limit, 1 << 32)
    while at - p < cap and at - last <= 2 << 20:
        piece = bytes(d[at : at + (1 << 20) + 3])
        stop = piece.find(b"\0\0\1\xb9")
        if stop >= 0:
            return at + stop + 4 - p
        k = piece.rfind(b"\0\0\1\xba")
        if k >= 0:
            last = at + k
            end = last + 2048 - p
        if len(piece) <= 3:
            break
        at += 1 << 20
    return end


def au(d: bytes, p: int, limit: int) -> int | None:
    a, b = _u(d, p + 4, 4, "be"), _u(d, p + 8, 4, "be")
    return None if a is None or b is None or a < 24 or b == 0xFFFFFFFF else a + b


def midi(d: bytes, p: int, limit: int) -> int | None:
    n, at = _u(d, p + 10, 2, "be"), p + 14
    for _ in range(n or 0):
        size = _u(d, at + 4, 4, "be")
        if bytes(d[at : at + 4]) != b"MTrk" or size is None:
            return None
        at += 8 + size
    return at - p if n else None


def adts(d: bytes, p: int, limit: int) -> int | None:
    at, frames, rate = p, 0, None
    while frames < 200_000 and at - p < limit:
        h = bytes(d[at : at + 6])
        if len(h) < 6 or h[0] != 0xFF or h[1] & 0xF6 != 0xF0:
            break
        size = ((h[3] & 3) << 11) | (h[4] << 3) | (h[5] >> 5)
        if not 7 <= size <= 8191 or (rate is not None and (h[2] >> 2) & 15 != rate):
            break
        rate, at, frames = (h[2] >> 2) & 15, at + size, frames + 1
    return at - p if frames >= 8 else None


WALKS: dict[str, Walk] = {
    f.__name__: f
    for f in (ole2, sqlite, seven_zip, ogg_stream, mp4, tiff, raf, pe, elf, rar, ebml, text_bound, ttf, pdf, gif, png, jpeg, iso9660, asf, tar, mpeg_ps, au, midi, adts)
}
#: Rules without whose answer a hit is no file at all.
REQUIRED = {"adts"}
_LINEAR = re.compile(r"linear(?:_scaled)?\(@(\d+),len=(\d+),(le|be)(?:,x(\d+))?,\+(\d+)\)")
_TS = re.compile(r"mpeg_ts\(off=(\d+),stride=(\d+)\)")


def resolve(rule: str, data: bytes, start: int, limit: int) -> int | None:
    """Size by a rule of the signature table; None where there is no rule or it can't tell."""
    if not rule:
        return None
    try:
        if m := _LINEAR.fullmatch(rule):
            return linear(data, start, int(m[1]), int(m[2]), m[3], int(m[4] or 1), int(m[5]))
        if m := _TS.fullmatch(rule):
            return mpeg_ts(data, start, limit, int(m[1]), int(m[2]))
        return WALKS[rule](data, start, limit)
    except (struct.error, IndexError, OverflowError):
        return None


def size_of(rule: Column, content: Column) -> Column:
    """Size by the rule of each row's content, null where there is none."""

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rules, contents in batches:
            yield pd.Series([None if c is None else resolve(r, c, 0, len(c)) for r, c in zip(rules, contents)], dtype="Int64")

    return run(rule, content)
