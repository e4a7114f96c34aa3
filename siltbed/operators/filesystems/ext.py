"""ext4 volumes: superblock, inodes, extents and indirect blocks, folder entries."""

from __future__ import annotations

from collections.abc import Iterator

from siltbed.operators.filesystems.common import Entry, u16, u32

ROOT = 2
MAX_BLOCKS = 1 << 18


class Volume:
    """Reading of inodes and blocks of the volume that begins at ``base``."""

    def __init__(self, data: bytes, base: int) -> None:
        sb = bytes(data[base + 1024 : base + 2048])
        if len(sb) < 1024 or sb[56:58] != b"\x53\xef":
            raise ValueError("no ext4 volume")
        self.data, self.base = data, base
        self.block = 1024 << u32(sb, 24)
        self.per_group, self.inodes = u32(sb, 40), u32(sb, 0)
        self.inode_size = u16(sb, 88) or 128
        wide = bool(u32(sb, 96) & 0x80)
        self.group_size = max(u16(sb, 254), 32) if wide else 32
        self.groups = base + (u32(sb, 20) + 1) * self.block

    def at(self, offset: int, n: int) -> bytes:
        return bytes(self.data[offset : offset + n])

    def blk(self, number: int) -> bytes:
        return self.at(self.base + number * self.block, self.block)

    def inode(self, number: int) -> bytes | None:
        if not 1 <= number <= self.inodes or not self.per_group:
            return None
        group, index = divmod(number - 1, self.per_group)
        g = self.at(self.groups + group * self.group_size, self.group_size)
        if len(g) < 32:
            return None
        table = u32(g, 8) | (u32(g, 40) << 32 if self.group_size >= 64 else 0)
        raw = self.at(self.base + table * self.block + index * self.inode_size, self.inode_size)
        return raw if len(raw) == self.inode_size else None

    def _extents(self, node: bytes, depth: int = 0) -> Iterator[int]:
        if len(node) < 12 or u16(node, 0) != 0xF30A or depth > 5:
            return
        for k in range(u16(node, 2)):
            e = node[12 + 12 * k : 24 + 12 * k]
            if len(e) < 12:
                return
            if u16(node, 6) == 0:
                start = u32(e, 8) | u16(e, 6) << 32
                yield from range(start, start + (u16(e, 4) & 0x7FFF or 0x8000))
            else:
                yield from self._extents(self.blk(u32(e, 4) | u16(e, 8) << 32), depth + 1)

    def _indirect(self, number: int, level: int) -> Iterator[int]:
        if not number:
            return
        if level == 0:
            yield number
            return
        raw = self.blk(number)
        for k in range(0, len(raw) - 3, 4):
            yield from self._indirect(u32(raw, k), level - 1)

    def blocks(self, inode: bytes) -> Iterator[int]:
        """Blocks of a file in order, at most :data:`MAX_BLOCKS`."""

        def every() -> Iterator[int]:
            if u32(inode, 32) & 0x80000:
                yield from self._extents(inode[40:100])
                return
            for k in range(12):
                yield from self._indirect(u32(inode, 40 + 4 * k), 0)
            for level in (1, 2, 3):
                yield from self._indirect(u32(inode, 84 + 4 * level), level)

        for k, b in enumerate(every()):
            if k >= MAX_BLOCKS:
                return
            yield b


def entries(data: bytes, base: int = 0) -> Iterator[Entry]:
    """Everything below the root, breadth first; an entry without inode number is a deleted one."""
    v = Volume(data, base)
    todo, seen = [(ROOT, "")], {ROOT}
    while todo:
        folder, where = todo.pop(0)
        inode = v.inode(folder)
        if inode is None:
            continue
        for b in v.blocks(inode):
            raw, at = v.blk(b), 0
            while at + 8 <= len(raw):
                number, length, n, kind = u32(raw, at), u16(raw, at + 4), raw[at + 6], raw[at + 7]
                if length < 8 or at + length > len(raw):
                    break
                name = raw[at + 8 : at + 8 + n].decode("utf-8", "replace")
                if n and name not in (".", ".."):
                    own = v.inode(number) if number else None
                    size = u32(own, 4) | u32(own, 108) << 32 if own and kind != 2 else 0
                    times = (u32(own, 12) or None, u32(own, 16) or None) if own else (None, None)
                    start = next(iter(v.blocks(own)), None) if own and kind == 1 else None
                    yield Entry(number, folder, name, f"{where}/{name}", size, kind == 2, number == 0, times[0], times[1], None if start is None else start * v.block)
                    if kind == 2 and number and number not in seen:
                        seen.add(number)
                        todo.append((number, f"{where}/{name}"))
                at += length
