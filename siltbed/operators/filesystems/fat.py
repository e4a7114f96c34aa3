"""FAT32 and exFAT volumes: cluster chains, folders, deleted entries."""

from __future__ import annotations

from collections.abc import Iterator

from siltbed.operators.filesystems.common import Entry, dos_time, u16, u32, u64

END = 0x0FFFFFF8
MAX_CLUSTERS = 1 << 20


class Fat32:
    """Geometry and reading of a FAT32 volume that begins at ``base``."""

    def __init__(self, data: bytes, base: int) -> None:
        boot = bytes(data[base : base + 512])
        if len(boot) < 512 or boot[510:] != b"\x55\xaa" or boot[82:90] != b"FAT32   ":
            raise ValueError("no FAT32 volume")
        self.data, self.base = data, base
        self.sector, self.cluster = u16(boot, 11), u16(boot, 11) * boot[13]
        self.fat = u16(boot, 14) * self.sector
        self.first = self.fat + boot[16] * u32(boot, 36) * self.sector
        self.root = u32(boot, 44)
        if not self.cluster:
            raise ValueError("no FAT32 volume")

    def next(self, cluster: int) -> int:
        raw = bytes(self.data[self.base + self.fat + 4 * cluster : self.base + self.fat + 4 * cluster + 4])
        return u32(raw, 0) & 0x0FFFFFFF if len(raw) == 4 else END

    def offset(self, cluster: int) -> int:
        return self.first + (cluster - 2) * self.cluster

    def chain(self, cluster: int) -> Iterator[int]:
        seen = set()
        while 2 <= cluster < END and cluster not in seen and len(seen) < MAX_CLUSTERS:
            seen.add(cluster)
            yield cluster
            cluster = self.next(cluster)

    def read(self, cluster: int, size: int | None = None) -> bytes:
        out = b"".join(bytes(self.data[self.base + self.offset(c) : self.base + self.offset(c) + self.cluster]) for c in self.chain(cluster))
        return out if size is None else out[:size]


def _long_name(parts: dict[int, str]) -> str:
    return "".join(parts[k] for k in sorted(parts)).split("\0")[0].rstrip("￿")


def fat32_entries(data: bytes, base: int = 0) -> Iterator[Entry]:
    """Everything below the root, breadth first through the live folders; a folder met twice is read once."""
    v = Fat32(data, base)
    todo: list[tuple[int, int, str]] = [(v.root, v.root, "")]
    seen = {v.root}
    while todo:
        cluster, parent, where = todo.pop(0)
        raw, parts = v.read(cluster), {}
        for at in range(0, len(raw) - 31, 32):
            e = raw[at : at + 32]
            if e[0] == 0:
                break
            if e[11] == 0x0F:
                parts[(e[0] & 0x1F) if e[0] != 0xE5 else 100 - len(parts)] = (e[1:11] + e[14:26] + e[28:32]).decode("utf-16-le", "replace")
                continue
            gone, short = e[0] == 0xE5, e[:11]
            if e[11] & 0x08 or short[:2] in (b". ", b".."):
                parts = {}
                continue
            name = short[:8].decode("latin-1").rstrip() + ("." + short[8:].decode("latin-1").rstrip() if short[8:].strip() else "")
            name = _long_name(parts) or ("_" + name[1:] if gone else name)
            parts = {}
            first, size, folder = u16(e, 20) << 16 | u16(e, 26), u32(e, 28), bool(e[11] & 0x10)
            path = f"{where}/{name}"
            chance = "Unknown" if size == 0 or not gone else "Medium" if first >= 2 else "Low"
            yield Entry(v.base + v.offset(cluster) + at, parent, name, path, size, folder, gone, dos_time(u16(e, 16), u16(e, 14)), dos_time(u16(e, 24), u16(e, 22)), v.offset(first) if first >= 2 else None, chance)
            if folder and not gone and first >= 2 and first not in seen:
                seen.add(first)
                todo.append((first, cluster, path))


def _exfat_time(value: int) -> int | None:
    return dos_time(value >> 16, value & 0xFFFF)


def exfat_entries(data: bytes, base: int = 0) -> Iterator[Entry]:
    """Everything below the root of an exFAT volume, breadth first through the live folders."""
    boot = bytes(data[base : base + 512])
    if len(boot) < 512 or boot[3:11] != b"EXFAT   ":
        raise ValueError("no exFAT volume")
    sector, cluster = 1 << boot[108], 1 << (boot[108] + boot[109])
    fat, heap = u32(boot, 80) * sector, u32(boot, 88) * sector
    offset = lambda c: heap + (c - 2) * cluster

    def entry_of(c: int) -> int:
        raw = bytes(data[base + fat + 4 * c : base + fat + 4 * c + 4])
        return u32(raw, 0) if len(raw) == 4 else 0

    def read(first: int, size: int | None, straight: bool) -> bytes:
        if straight and size is not None:
            return bytes(data[base + offset(first) : base + offset(first) + size])
        out, c, seen = [], first, set()
        while 2 <= c < 0xFFFFFFF7 and c not in seen and len(seen) < MAX_CLUSTERS:
            seen.add(c)
            out.append(bytes(data[base + offset(c) : base + offset(c) + cluster]))
            c = entry_of(c)
        return b"".join(out)

    root = u32(boot, 96)
    todo, known = [(root, None, False, "", root)], {root}
    while todo:
        first, size, straight, where, parent = todo.pop(0)
        raw, at = read(first, size, straight), 0
        while at + 32 <= len(raw):
            kind = raw[at]
            if kind == 0:
                break
            if kind not in (0x85, 0x05):
                at += 32
                continue
            n, e = raw[at + 1], raw[at : at + 32]
            sets = [raw[at + 32 * k : at + 32 * (k + 1)] for k in range(1, n + 1)]
            stream = next((s for s in sets if len(s) == 32 and s[0] & 0x7F == 0x40), None)
            if stream is None:
                at += 32
                continue
            text = b"".join(s[2:] for s in sets if len(s) == 32 and s[0] & 0x7F == 0x41).decode("utf-16-le", "replace")
            name, start, length = text[: stream[3]], u32(stream, 20), u64(stream, 24)
            gone, folder, path = kind == 0x05, bool(u16(e, 4) & 0x10), f"{where}/{text[: stream[3]]}"
            chance = "Unknown" if not gone or length == 0 else "High" if entry_of(start) == 0 else "Low"
            yield Entry(base + offset(first) + at, parent, name, path, length, folder, gone, _exfat_time(u32(e, 8)), _exfat_time(u32(e, 12)), offset(start) if start >= 2 else None, chance)
            if folder and not gone and start >= 2 and start not in known:
                known.add(start)
                todo.append((start, length, bool(stream[1] & 2), path, first))
            at += 32 * (1 + n)
