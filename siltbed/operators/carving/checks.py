"""Structural checks of a header match: may the bytes at ``p`` start a file of this format?

``CHECKS[name]`` is ``(need, test)``. With fewer than ``need`` bytes left the match is accepted, except for the
names in :data:`STRICT`. Tests read only the buffer that the match lies in.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import numpy as np

Test = Callable[[bytes, int], bool]


def le16(d: bytes, o: int) -> int:
    return struct.unpack_from("<H", d, o)[0]


def be16(d: bytes, o: int) -> int:
    return struct.unpack_from(">H", d, o)[0]


def le32(d: bytes, o: int) -> int:
    return struct.unpack_from("<I", d, o)[0]


def be32(d: bytes, o: int) -> int:
    return struct.unpack_from(">I", d, o)[0]


def le64(d: bytes, o: int) -> int:
    return struct.unpack_from("<Q", d, o)[0]


def _digits(d: bytes, a: int, b: int) -> bool:
    return d[a:b].isdigit()


def _near(d: bytes, p: int, *words: bytes, within: int = 512) -> bool:
    window = d[p : p + within]
    return any(w in window for w in words)


def _embedded_jpeg(d: bytes, p: int) -> bool:
    """An earlier start of an image in the buffer that has not ended before this one."""
    before = d.rfind(b"\xff\xd8", 0, p)
    return before >= 0 and d.find(b"\xff\xd9", before, p) < 0


# Methods a ZIP entry may be packed with, and brands that belong to other box formats.
ZIP_METHODS = {0, 8, 9, 12, 14, 19, 93, 95, 96, 97, 98, 99}
OTHER_BRANDS = (b"qt", b"M4V", b"M4A", b"3gp", b"3g2", b"jp", b"heic", b"heix", b"mif1", b"avif", b"crx")


def _zip_name(d: bytes, p: int) -> bytes:
    return d[p + 30 : p + 30 + le16(d, p + 26)]


def _zip(d: bytes, p: int) -> bool:
    n = le16(d, p + 26)
    if le16(d, p + 4) > 63 or not 1 <= n <= 512 or le16(d, p + 8) not in ZIP_METHODS or _zip_name(d, p).endswith(b"/"):
        return False
    last = d.rfind(b"PK\x03\x04", 0, p)
    return last < 0 or d.find(b"PK\x05\x06", last, p) >= 0


def _packed(d: bytes, p: int, kind: bytes, within: int) -> bool:
    return le16(d, p + 26) == 8 and _zip_name(d, p) == b"mimetype" and kind in d[p + 38 : p + 38 + within]


def _box(d: bytes, p: int) -> bool:
    return 12 <= be32(d, p) <= 512


def _mp4(d: bytes, p: int) -> bool:
    size, brand = be32(d, p), d[p + 8 : p + 12]
    if not _box(d, p) or not all(0x20 <= b < 0x7F for b in brand) or brand.startswith(OTHER_BRANDS):
        return False
    nxt = p + size
    return nxt + 8 > len(d) or (be32(d, nxt) >= 8 and all(chr(b).isalnum() and b < 128 or b == 32 for b in d[nxt + 4 : nxt + 8]))


def _doctype(kind: bytes) -> Test:
    def test(d: bytes, p: int) -> bool:
        if d[p + 4] == 0:
            return False
        window = d[p : p + 80]
        at = window.find(b"\x42\x82")
        if at < 0:
            return len(window) < 80
        length = window[at + 2] & 0x7F if at + 2 < len(window) else 0
        return window[at + 3 : at + 3 + length].rstrip(b"\0") == kind

    return test


def _ifd(order: str, p: int, d: bytes) -> list[int] | None:
    """Tags of the first directory; None when it lies outside the buffer."""
    u16, u32 = (le16, le32) if order == "<" else (be16, be32)
    at = p + u32(d, p + 4)
    if at + 2 > len(d):
        return None
    n = u16(d, at)
    return [u16(d, at + 2 + 12 * k) for k in range(n) if at + 4 + 12 * k <= len(d)] if 1 <= n <= 500 else []


def _tiff(order: str) -> Test:
    def test(d: bytes, p: int) -> bool:
        if not 8 <= (le32 if order == "<" else be32)(d, p + 4) <= 65536:
            return False
        if order == "<" and (d[p + 8 : p + 12] == b"CR\x02\0" or _near(d, p, b"SONY", b"NIKON", b"Kodak", b"KODAK")):
            return False
        tags = _ifd(order, p, d)
        return tags is None or 256 in tags

    return test


def _sony(private: bool) -> Test:
    low = 3 if private else 5

    def test(d: bytes, p: int) -> bool:
        return low <= le16(d, p + 8) <= 50 and _near(d, p, b"SONY") and (0x7200 in (_ifd("<", p, d) or [])) == private

    return test


def _exe(d: bytes, p: int) -> bool:
    at = le32(d, p + 60)
    return 64 <= at <= 16384 and (p + at + 4 > len(d) or d[p + at : p + at + 4] == b"PE\0\0")


def _rar(d: bytes, p: int) -> bool:
    if d[p + 6] not in (0, 1):
        return False
    if d[p + 6] == 1 or len(d) - p < 12:
        return True
    flags = le16(d, p + 10)
    return d[p + 9] == 0x73 and not (flags & 1 and not flags & 0x100)


def _mpeg(d: bytes, p: int) -> bool:
    if d[p + 4] & 0xC0 == 0x40:
        return len(d) - p < 14 or bool(d[p + 4] & 4 and d[p + 6] & 4 and d[p + 8] & 4 and d[p + 9] & 1 and d[p + 12] & 3 == 3 and d[p + 13] & 0xF8 == 0xF8)
    return d[p + 4] & 0xF0 == 0x20 and bool(d[p + 4] & 1)


def _eml(d: bytes, p: int) -> bool:
    line = d[p + 5 : p + 85].split(b"\n")[0]
    return b"@" in line and all(0x20 <= b < 0x7F or b in (9, 13) for b in line)


def _ico(d: bytes, p: int) -> bool:
    n = le16(d, p + 4)
    if not 1 <= n <= 200:
        return False
    planes, bpp, size, at = le16(d, p + 10), le16(d, p + 12), le32(d, p + 14), le32(d, p + 18)
    return d[p + 9] == 0 and planes <= 1 and bpp in (0, 1, 4, 8, 16, 24, 32) and 1 <= size <= 1 << 20 and 6 + 16 * n <= at <= 1 << 20 and (planes, bpp) != (0, 0)


def _swf(d: bytes, p: int) -> bool:
    if not (3 <= d[p + 3] <= 45 and 21 <= le32(d, p + 4) <= 104857600):
        return False
    kind, b = d[p : p + 1], d[p + 8]
    return 1 <= b >> 3 <= 25 if kind == b"F" else (b & 15 == 8 and b >> 4 <= 7) if kind == b"C" else True


def _ttf(d: bytes, p: int) -> bool:
    n, search, sel = be16(d, p + 4), be16(d, p + 6), be16(d, p + 8)
    return 4 <= n <= 50 and sel < 16 and search == 16 << sel and 1 << sel <= n < 2 << sel


def _sync(*places: int, late: tuple[int, ...]) -> Test:
    def test(d: bytes, p: int) -> bool:
        more = [x for x in late if p + max(late) < len(d)]
        return all(d[p + x] == 0x47 for x in (*places, *more))

    return test


def _iso(d: bytes, p: int) -> bool:
    if d[p + 5] != 1 or (p > 0 and d[p - 1] != 1):
        return False
    return len(d) - p < 87 or (le32(d, p + 79) == be32(d, p + 83) != 0)


def _aac(d: bytes, p: int) -> bool:
    def frame(at: int) -> tuple[int, int] | None:
        if at + 6 > len(d):
            return None
        return ((d[at + 3] & 3) << 11) | (d[at + 4] << 3) | (d[at + 5] >> 5), (d[at + 2] >> 2) & 15

    if d[p + 1] & 6 or (d[p + 2] >> 2) & 15 > 12:
        return False
    one = frame(p)
    if one is None:
        return True
    if not 7 <= one[0] <= 8191:
        return False
    second = p + one[0]
    two = frame(second)
    if two is None:
        return True
    if d[second] != 0xFF or d[second + 1] & 0xF6 != 0xF0 or two[1] != one[1] or not 7 <= two[0] <= 8191:
        return False
    third = second + two[0]
    return third + 2 > len(d) or (d[third] == 0xFF and d[third + 1] & 0xF6 == 0xF0)


def _pcx(d: bytes, p: int) -> bool:
    x0, y0, x1, y1 = struct.unpack_from("<4H", d, p + 4)
    return d[p + 1] in (0, 2, 3, 4, 5) and d[p + 2] <= 1 and d[p + 3] in (1, 2, 4, 8) and x1 >= x0 and y1 >= y0 and d[p + 64] == 0 and d[p + 65] in (1, 3, 4) and le16(d, p + 66) > 0


def _qcow(d: bytes, p: int) -> bool:
    return be32(d, p + 4) in (2, 3) and 9 <= be32(d, p + 20) <= 21


def _pcap(d: bytes, p: int) -> bool:
    u16 = le16 if d[p] == 0xD4 else be16
    return u16(d, p + 4) == 2 and u16(d, p + 6) == 4


def _gz(d: bytes, p: int) -> bool:
    return d[p + 2] == 8 and not d[p + 3] & 0x20 and d[p + 8] in (0, 2, 4) and (d[p + 9] <= 13 or d[p + 9] == 255)


def _bmp(d: bytes, p: int) -> bool:
    size = le32(d, p + 2)
    return size >= 26 and 14 <= le32(d, p + 10) <= size and le32(d, p + 14) in (12, 40, 52, 56, 108, 124)


def _wmv(d: bytes, p: int) -> bool:
    return 30 <= le64(d, p + 16) <= 10485760 and d[p + 24] == 1 and d[p + 25] == 2 and 1 <= le32(d, p + 26) <= 1023


#: Formats whose check refuses a match too close to the end of the buffer.
STRICT = {"plist", "chm", "indd", "wtv"}
CHECKS: dict[str, tuple[int, Test]] = {
    "zip": (30, _zip),
    "jpeg_jfif": (11, lambda d, p: d[p + 6 : p + 11] == b"JFIF\0" and not _embedded_jpeg(d, p)),
    "jpeg_exif": (10, lambda d, p: d[p + 6 : p + 10] == b"Exif" and not _embedded_jpeg(d, p)),
    "jpeg_dqt": (6, lambda d, p: 67 <= be16(d, p + 4) <= 518 and not _embedded_jpeg(d, p)),
    "jpeg_com": (6, lambda d, p: be16(d, p + 4) >= 2 and not _embedded_jpeg(d, p)),
    "png": (20, lambda d, p: be32(d, p + 8) == 13 and d[p + 12 : p + 16] == b"IHDR"),
    "pdf": (8, lambda d, p: d[p + 4 : p + 5] == b"-" and d[p + 5] in b"12" and d[p + 6 : p + 7] == b"." and _digits(d, p + 7, p + 8)),
    "gif": (6, lambda d, p: d[p + 4] in b"79" and d[p + 5 : p + 6] == b"a"),
    "bmp": (18, _bmp),
    "mp3": (10, lambda d, p: 2 <= d[p + 3] <= 4 and d[p + 5] & 15 == 0 and not any(b & 0x80 for b in d[p + 6 : p + 10])),
    "mp4": (12, _mp4),
    "rar": (7, _rar),
    "seven_zip": (7, lambda d, p: d[p + 6] == 0),
    "sqlite": (18, lambda d, p: be16(d, p + 16) in {1, *(1 << k for k in range(9, 16))}),
    "mkv": (5, _doctype(b"matroska")),
    "webm": (5, _doctype(b"webm")),
    "flac": (5, lambda d, p: d[p + 4] & 0x7F == 0),
    "exe": (64, _exe),
    "vmdk": (8, lambda d, p: 1 <= le32(d, p + 4) <= 3),
    "ogg": (6, lambda d, p: d[p + 4] == 0 and bool(d[p + 5] & 2)),
    "evtx": (42, lambda d, p: le32(d, p + 32) == 128 and le16(d, p + 38) == 3),
    "pst": (10, lambda d, p: d[p + 8 : p + 10] == b"MS"),
    "xml": (13, lambda d, p: d[p + 5 : p + 13] == b" version"),
    "html": (14, lambda d, p: d[p + 9 : p + 10] == b" " and d[p + 10 : p + 14].lower() == b"html"),
    "rtf": (7, lambda d, p: d[p + 6] in b"\\ \r\n"),
    "vcard": (12, lambda d, p: d[p + 11] in b"\r\n"),
    "ical": (16, lambda d, p: d[p + 15] in b"\r\n"),
    "ole2": (30, lambda d, p: d[p + 28 : p + 30] == b"\xfe\xff"),
    "arw": (10, _sony(False)),
    "sr2": (10, _sony(True)),
    "cr2": (8, lambda d, p: 8 <= le32(d, p + 4) <= 4096),
    "rw2": (10, lambda d, p: 8 <= le32(d, p + 4) <= 4096 and ((at := p + le32(d, p + 4)) + 2 > len(d) or 3 <= le16(d, at) <= 50)),
    "raf": (20, lambda d, p: d[p + 15 : p + 16] == b" " and _digits(d, p + 16, p + 20)),
    "tiff_le": (8, _tiff("<")),
    "tiff_be": (8, _tiff(">")),
    "nef": (8, lambda d, p: 8 <= le32(d, p + 4) <= 4096 and _near(d, p, b"NIKON")),
    "heic": (8, _box),
    "mov": (12, _box),
    "m4v": (12, _box),
    "m4a": (12, _box),
    "cr3": (8, _box),
    "3gp": (12, lambda d, p: _box(d, p) and d[p + 8 : p + 11] in (b"3gp", b"3g2")),
    "wmv": (30, _wmv),
    "flv": (9, lambda d, p: d[p + 4] & 0xFA == 0 and be32(d, p + 5) == 9),
    "mpeg": (5, _mpeg),
    "webp": (12, lambda d, p: d[p + 8 : p + 12] == b"WEBP" and le32(d, p + 4) >= 4),
    "gz": (10, _gz),
    "eml": (85, _eml),
    "elf": (16, lambda d, p: d[p + 4] in (1, 2) and d[p + 5] in (1, 2) and d[p + 6] == 1),
    "regf": (28, lambda d, p: le32(d, p + 20) == 1 and 2 <= le32(d, p + 24) <= 6),
    "psd": (26, lambda d, p: be16(d, p + 4) in (1, 2) and 1 <= be16(d, p + 6) <= 56),
    "vhd": (68, lambda d, p: 2 <= be32(d, p + 60) <= 4),
    "vhdx": (8, lambda d, p: True),
    "qcow2": (24, _qcow),
    "midi": (10, lambda d, p: be32(d, p + 4) == 6 and be16(d, p + 8) <= 2),
    "aiff": (12, lambda d, p: d[p + 11] in b"FC" and 5 <= be32(d, p + 4) <= 209715192),
    "xz": (8, lambda d, p: d[p + 6] == 0 and d[p + 7] in (0, 1, 4, 10)),
    "bzip2": (10, lambda d, p: d[p + 3] in b"123456789" and d[p + 4 : p + 10] == b"1AY&SY"),
    "realmedia": (10, lambda d, p: be16(d, p + 4) <= 1 and be32(d, p + 6) >= 18),
    "ico": (22, _ico),
    "orf": (8, lambda d, p: 8 <= le32(d, p + 4) <= 4096),
    "pef": (8, lambda d, p: 8 <= le32(d, p + 4) <= 4096 and _near(d, p, b"PENTAX ")),
    "macho": (20, lambda d, p: 1 <= le32(d, p + 12) <= 12 and 1 <= le32(d, p + 16) <= 512),
    "epub": (38, lambda d, p: _packed(d, p, b"epub+zip", 32)),
    "odt": (38, lambda d, p: _packed(d, p, b"opendocument", 50)),
    "jar": (30, lambda d, p: 1 <= le16(d, p + 26) <= 256 and _zip_name(d, p).startswith(b"META-INF")),
    "msg": (30, lambda d, p: le16(d, p + 28) == 0xFFFE and _near(d, p, b"__substg1.0_", "__substg1.0_".encode("utf-16-le"), within=4096)),
    "wavpack": (10, lambda d, p: le32(d, p + 4) > 0 and 0x402 <= le16(d, p + 8) <= 0x410),
    "cdr": (12, lambda d, p: d[p + 11] in b"456789ABCDEFGHIJKLMNOPQRSTUVWXYZ "),
    "swf": (9, _swf),
    "dcr": (8, lambda d, p: 8 <= le32(d, p + 4) <= 65536 and d[p + 8 : p + 10] != b"CR" and not _near(d, p, b"NIKON", b"SONY", b"PENTAX") and _near(d, p, b"Kodak", b"KODAK")),
    "crw": (14, lambda d, p: d[p + 6 : p + 14] == b"HEAPCCDR"),
    "mrw": (12, lambda d, p: d[p + 8 : p + 11] in (b"PRD", b"TTW", b"WBG")),
    "kdbx": (12, lambda d, p: le16(d, p + 10) in (3, 4)),
    "kdb": (12, lambda d, p: le16(d, p + 10) in (1, 2)),
    "e01": (10, lambda d, p: le16(d, p + 8) == 1),
    "pcap": (8, _pcap),
    "dmp": (12, lambda d, p: le32(d, p + 8) > 0),
    "plist": (34, lambda d, p: True),
    "chm": (12, lambda d, p: True),
    "indd": (16, lambda d, p: True),
    "wtv": (16, lambda d, p: True),
    "ts": (377, _sync(0, 188, 376, late=(564, 752))),
    "m2ts": (389, _sync(4, 196, 388, late=(580, 772))),
    "luks": (8, lambda d, p: be16(d, p + 6) in (1, 2)),
    "x3f": (8, lambda d, p: d[p + 5] in (2, 3)),
    "ape": (8, lambda d, p: 3930 <= le16(d, p + 6) <= 4100),
    "au": (16, lambda d, p: be32(d, p + 4) >= 24 and be32(d, p + 12) in {*range(1, 8), *range(23, 28)}),
    "ttf": (12, _ttf),
    "woff": (14, lambda d, p: d[p + 4 : p + 8] in (b"\0\1\0\0", b"OTTO", b"true") and be32(d, p + 8) >= 44 and 1 <= be16(d, p + 12) <= 50),
    "woff2": (14, lambda d, p: d[p + 4 : p + 8] in (b"\0\1\0\0", b"OTTO") and 1 <= be16(d, p + 12) <= 50),
    "otf": (6, lambda d, p: 1 <= be16(d, p + 4) <= 50),
    "blend": (9, lambda d, p: d[p + 7] in b"-_" and d[p + 8] in b"vV"),
    "iso": (6, _iso),
    "dicom": (10, lambda d, p: le16(d, p + 4) == 2 and d[p + 8 : p + 10].isalpha() and d[p + 8 : p + 10].isupper()),
    "tar": (8, lambda d, p: d[p + 6 : p + 8] in (b"00", b"  ")),
    "php": (6, lambda d, p: d[p + 5 : p + 6].isspace()),
    "shebang": (7, lambda d, p: d[p + 2 : p + 3] == b"/" and d[p + 3] in b"bu" and all(0x20 <= b < 0x7F for b in d[p + 4 : p + 7])),
    "java_class": (8, lambda d, p: 45 <= be16(d, p + 6) <= 80),
    "cab": (12, lambda d, p: le32(d, p + 4) == 0 and le32(d, p + 8) > 0),
    "dex": (8, lambda d, p: _digits(d, p + 4, p + 7) and d[p + 7] == 0),
    "aac": (3, _aac),
    "djvu": (16, lambda d, p: d[p + 12 : p + 16] in (b"DJVU", b"DJVM", b"DJVI", b"THUM")),
    "xcf": (15, lambda d, p: d[p + 10 : p + 15] == b"file\0" or re.fullmatch(rb"\d{3}\0", d[p + 10 : p + 14]) is not None),
    "pcx": (68, _pcx),
    "lzh": (5, lambda d, p: d[p + 3] in b"01234567ds"),
    "hdf5": (9, lambda d, p: d[p + 8] <= 3),
    "fits": (30, lambda d, p: d[p + 9 : p + 10] == b" " and d[p + 29 : p + 30] == b"T"),
    "vdi": (12, lambda d, p: 1 <= le32(d, p + 8) <= 4),
    "lnk": (28, lambda d, p: 0 < le32(d, p + 24) < 1 << 16),
    "prefetch": (8, lambda d, p: d[p + 4 : p + 8] == b"SCCA"),
    "evt": (16, lambda d, p: le32(d, p + 8) == 1 and le32(d, p + 12) == 1),
    "pem": (12, lambda d, p: d[p + 10 : p + 11] == b" " and 65 <= d[p + 11] <= 90),
    "par2": (16, lambda d, p: le64(d, p + 8) >= 64),
    "wav": (8, lambda d, p: le32(d, p + 4) >= 36),
    "avi": (8, lambda d, p: le32(d, p + 4) >= 12),
    "pyc": (8, lambda d, p: le32(d, p + 4) <= 3),
    "dpx": (12, lambda d, p: re.fullmatch(rb"V\d\.0", d[p + 8 : p + 12]) is not None),
    "exr": (8, lambda d, p: d[p + 4] == 2 and d[p + 5] & 0xF0 == 0 and d[p + 6] == d[p + 7] == 0),
}


#: For headers of one byte: what the check asks of single bytes, looked up for all matches at once.
PREFILTER: dict[str, dict[int, tuple[int, ...]]] = {
    "ts": {188: (0x47,), 376: (0x47,)},
    "m2ts": {196: (0x47,), 388: (0x47,)},
    "pcx": {1: (0, 2, 3, 4, 5), 2: (0, 1), 3: (1, 2, 4, 8), 64: (0,), 65: (1, 3, 4)},
}


def prefiltered(name: str, data: bytes, header: tuple[int | None, ...], report: int) -> list[int] | None:
    """Places of a one-byte header that may pass the check; None where there is no such list for the format.

    A place too close to the end to be looked up stays in.
    """
    fixed = [(k, b) for k, b in enumerate(header) if b is not None]
    if name not in PREFILTER or len(fixed) != 1:
        return None
    (at, byte), all_ = fixed[0], np.frombuffer(data, np.uint8)
    last = max(0, min(report, len(data) - len(header) + 1))
    places = np.flatnonzero(all_[at : at + last] == byte)
    enough = places + CHECKS[name][0] <= len(data)
    for offset, allowed in PREFILTER[name].items():
        table = np.zeros(256, bool)
        table[list(allowed)] = True
        keep = ~enough | table[all_[np.minimum(places + offset, len(data) - 1)]]
        places, enough = places[keep], enough[keep]
    return places.tolist()


def passes(name: str, data: bytes, at: int) -> bool:
    """Whether a match at ``at`` may start a file; formats without a check always may."""
    if not name or name not in CHECKS:
        return True
    need, test = CHECKS[name]
    if len(data) - at < need:
        return name not in STRICT
    return bool(test(data, at))
