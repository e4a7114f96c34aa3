"""Listings of small volumes that are built here."""

import struct

from siltbed.operators.filesystems import common, ext, fat, listing, ntfs


def fat32_volume():
    img = bytearray(512 * 200)
    boot = bytearray(512)
    struct.pack_into("<HBHB", boot, 11, 512, 1, 32, 1)
    struct.pack_into("<I", boot, 36, 10)
    struct.pack_into("<I", boot, 44, 2)
    boot[82:90], boot[510:] = b"FAT32   ", b"\x55\xaa"
    img[:512] = boot
    for c, nxt in {2: 3, 3: 0x0FFFFFFF, 4: 0x0FFFFFFF, 5: 0x0FFFFFFF, 6: 6}.items():
        struct.pack_into("<I", img, 32 * 512 + 4 * c, nxt)

    def entry(name, attr, first, size, date=0x5821, time=0x6000):
        e = bytearray(32)
        e[:11], e[11] = name, attr
        struct.pack_into("<HH", e, 14, time, date)
        struct.pack_into("<H", e, 20, first >> 16)
        struct.pack_into("<HHHI", e, 22, time, date, first & 0xFFFF, size)
        return bytes(e)

    def long(seq, text):
        raw = text.encode("utf-16-le").ljust(26, b"\0")
        return bytes([seq]) + raw[:10] + b"\x0f\0\0" + raw[10:22] + b"\0\0" + raw[22:26]

    at = lambda c: (32 + 10 + c - 2) * 512
    root = entry(b"VOLUME     ", 8, 0, 0) + long(0x42, "name.txt") + long(0x01, "a long file n")[:32]
    root = entry(b"VOLUME     ", 8, 0, 0) + long(0x42, ".txt") + long(0x01, "a long name x") + entry(b"ALONGN~1TXT", 0x20, 5, 77) + entry(b"\xe5LD     JPG", 0x20, 9, 10) + entry(b"SUB        ", 0x10, 4, 0)
    root += b"".join(entry(b"F%03d    TXT" % k, 0x20, 0, 0) for k in range(12))
    img[at(2) : at(2) + 512] = root[:512].ljust(512, b"\0")
    img[at(3) : at(3) + 512] = root[512:1024].ljust(512, b"\0")
    sub = entry(b".          ", 0x10, 4, 0) + entry(b"..         ", 0x10, 0, 0) + entry(b"IN      BIN", 0x20, 5, 3) + entry(b"LOOP       ", 0x10, 4, 0)
    img[at(4) : at(4) + len(sub)] = sub
    return bytes(img)


def test_fat32():
    rows = {e.path: e for e in fat.fat32_entries(fat32_volume())}
    assert rows["/a long name x.txt"].size == 77 and rows["/SUB/IN.BIN"].size == 3
    gone = rows["/_LD.JPG"]
    assert gone.is_deleted and gone.chance == "Medium" and not rows["/SUB"].is_deleted
    assert "/F011.TXT" in rows and "/SUB/LOOP" in rows
    assert rows["/SUB/IN.BIN"].modified == 1704110400  # 2024-01-01 12:00


def test_dos_time():
    assert common.dos_time(0x5821, 0x6000) == 1704110400 and common.dos_time(0, 5) is None and common.dos_time(0x5800, 0) is None
    assert common.filetime(116_444_736_000_000_000) == 0 and common.filetime(0) is None


def exfat_volume():
    img = bytearray(512 * 100)
    img[3:11] = b"EXFAT   "
    struct.pack_into("<I", img, 80, 2)
    struct.pack_into("<I", img, 88, 10)
    struct.pack_into("<I", img, 96, 2)
    img[108], img[109] = 9, 0
    struct.pack_into("<I", img, 2 * 512 + 8, 0xFFFFFFFF)

    def files(kind, name, first, size, attr=0x20):
        head = bytearray(32)
        head[0], head[1] = kind, 2
        struct.pack_into("<H", head, 4, attr)
        struct.pack_into("<II", head, 8, 0x58216000, 0x58216000)
        stream = bytearray(32)
        stream[0], stream[1], stream[3] = (kind & 0x80) | 0x40, 2, len(name)
        struct.pack_into("<IQ", stream, 20, first, size)
        return bytes(head) + bytes(stream) + bytes([(kind & 0x80) | 0x41, 0]) + name.encode("utf-16-le").ljust(30, b"\0")

    root = files(0x85, "live.bin", 5, 9) + files(0x05, "gone.bin", 6, 9) + files(0x85, "dir", 3, 512, 0x10)
    img[10 * 512 : 10 * 512 + len(root)] = root
    inner = files(0x85, "in.txt", 7, 1)
    img[11 * 512 : 11 * 512 + len(inner)] = inner
    return bytes(img)


def test_exfat():
    rows = {e.path: e for e in fat.exfat_entries(exfat_volume())}
    assert set(rows) == {"/live.bin", "/gone.bin", "/dir", "/dir/in.txt"}
    assert rows["/gone.bin"].chance == "High" and rows["/live.bin"].data_offset == 13 * 512 and rows["/dir/in.txt"].modified == 1704110400


def ntfs_volume(records):
    boot = bytearray(512)
    boot[3:11] = b"NTFS    "
    struct.pack_into("<HB", boot, 11, 512, 2)
    struct.pack_into("<Q", boot, 48, 4)
    boot[64] = 0xF6  # 1024 bytes
    img = bytearray(4 * 1024) + b"".join(records)
    img[:512] = boot
    return bytes(img)


def record(name, parent, live=True, folder=False, size=0, lcn=None, stream=None):
    def attribute(kind, body, label=""):
        raw = label.encode("utf-16-le")
        at = 24 + len(raw) + (-len(raw)) % 8
        n = at + len(body) + (-len(body)) % 8
        return struct.pack("<IIBBHHHIHH", kind, n, 0, len(label), 24, 0, 0, len(body), at, 0) + raw.ljust(at - 24, b"\0") + body.ljust(n - at, b"\0")

    def outside(size, lcn):
        run = bytes([0x21, 1]) + struct.pack("<h", lcn) + b"\0"
        return (struct.pack("<IIBBHHHQQHHIQQQ", 0x80, 72, 1, 0, 64, 0, 0, 0, 0, 64, 0, 0, size, size, size) + run).ljust(72, b"\0")

    body = attribute(0x10, struct.pack("<QQQQ", 116_444_736_000_000_000 + 10**7, 116_444_736_000_000_000 + 2 * 10**7, 0, 0))
    body += attribute(0x30, struct.pack("<Q", parent) + bytes(56) + bytes([len(name), 1]) + name.encode("utf-16-le"))
    body += outside(size, lcn) if lcn else attribute(0x80, b"x" * size) if size else b""
    body += attribute(0x80, b"hidden", stream) if stream else b""
    r = bytearray(1024)
    r[:4] = b"FILE"
    struct.pack_into("<HH", r, 4, 48, 3)
    struct.pack_into("<HH", r, 20, 56, (1 if live else 0) | (2 if folder else 0))
    r[56 : 56 + len(body)] = body
    struct.pack_into("<I", r, 56 + len(body), 0xFFFFFFFF)
    r[48:50] = b"\x07\x07"
    for k in (1, 2):
        r[48 + 2 * k : 50 + 2 * k] = r[512 * k - 2 : 512 * k]
        r[512 * k - 2 : 512 * k] = b"\x07\x07"
    return bytes(r)


def test_ntfs_and_listing(spark, tmp_path):
    recs = [record(f"sys{k}", 5) for k in range(5)] + [record(".", 5, folder=True), record("docs", 5, folder=True), record("a.txt", 6, size=30, stream="note"), record("old.jpg", 5, live=False, size=5000, lcn=33), record("lost.jpg", 5, live=False)]
    paths = {1: ntfs_volume(recs), 2: fat32_volume(), 3: exfat_volume(), 4: b"nothing"}
    for k, data in paths.items():
        (tmp_path / f"{k}.img").write_bytes(data)
    volumes = spark.createDataFrame([(k, str(tmp_path / f"{k}.img"), 0, fs) for k, fs in ((1, "NTFS"), (2, "FAT32"), (3, "exFAT"), (4, "ext4"), (5, "NTFS"))], "image_id long, path string, part_offset long, fs string")
    found = listing.list_entries(volumes, ntfs_records=100).cache()
    rows = {r.name: r for r in found.where("image_id = 1").collect()}
    assert rows["old.jpg"].chance == "High" and rows["old.jpg"].data_offset == 33 * 1024 and rows["lost.jpg"].chance == "Unknown"
    assert rows["a.txt"]["size"] == 30 and rows["a.txt:note"]["size"] == 6 and rows["a.txt"].modified == 2
    got = {r.path for r in listing.ntfs_paths(found).collect()}
    assert {"/docs/a.txt", "/docs", "/old.jpg"} <= got
    assert found.where("image_id = 2").count() == 17 and found.where("image_id = 3").count() == 4 and found.where("image_id > 3").count() == 0
    assert [r.name for r in listing.deleted_files(found).where("image_id < 3").collect()][:2] == ["old.jpg", "_LD.JPG"]
    assert listing.metadata_index(found).where("abs_offset = 33792").first().name == "old.jpg"
    assert list(ntfs.runs(bytes([0x21, 4, 16, 0, 0x01, 2, 0x11, 3, 0xFE, 0]))) == [(16, 4), (None, 2), (14, 3)]


def test_ntfs_goes_on_behind_void_records(spark, tmp_path):
    files = [record(f"f{k}", 5, size=9) for k in range(6)]
    gaps = files[:2] + [bytes(1024)] + files[2:4] + [b"BAAD" + bytes(1020), bytes(1024)] + files[4:]
    assert [(e.entry_id, e.name) for e in ntfs.entries(ntfs_volume(gaps))] == [(0, "f0"), (1, "f1"), (3, "f2"), (4, "f3"), (7, "f4"), (8, "f5")]
    assert [e.name for e in ntfs.entries(ntfs_volume(gaps), 0, 2, 3)] == ["f2", "f3"]
    # record 0 says that the table has five records
    table = [record("$MFT", 5, size=5 * 1024 + 7, lcn=4)] + gaps[1:]
    assert [e.name for e in ntfs.entries(ntfs_volume(table))] == ["$MFT", "f1", "f2", "f3"]
    (tmp_path / "gaps.img").write_bytes(ntfs_volume(gaps))
    volumes = spark.createDataFrame([(1, str(tmp_path / "gaps.img"), 0, "NTFS")], "image_id long, path string, part_offset long, fs string")
    found = listing.list_entries(volumes, ntfs_records=100)
    assert {r.name for r in found.collect()} == {f"f{k}" for k in range(6)}


def ext4_volume():
    img = bytearray(1024 * 64)
    struct.pack_into("<I", img, 1024, 32)
    struct.pack_into("<I", img, 1024 + 20, 1)
    struct.pack_into("<I", img, 1024 + 24, 0)
    struct.pack_into("<I", img, 1024 + 40, 32)
    img[1024 + 56 : 1024 + 58] = b"\x53\xef"
    struct.pack_into("<H", img, 1024 + 88, 128)
    struct.pack_into("<I", img, 2048 + 8, 5)

    def inode(n, size, first, extents):
        at = 5 * 1024 + (n - 1) * 128
        struct.pack_into("<I", img, at + 4, size)
        struct.pack_into("<II", img, at + 12, 111, 222)
        if extents:
            struct.pack_into("<I", img, at + 32, 0x80000)
            struct.pack_into("<HHHHI", img, at + 40, 0xF30A, 1, 4, 0, 0)
            struct.pack_into("<IHHI", img, at + 52, 0, 1, 0, first)
        else:
            struct.pack_into("<I", img, at + 40, first)

    def dirent(number, name, kind, length):
        return (struct.pack("<IHBB", number, length, len(name), kind) + name).ljust(length, b"\0")

    inode(2, 1024, 20, True)
    inode(12, 1024, 21, False)
    inode(13, 999, 22, True)
    img[20 * 1024 : 21 * 1024] = dirent(2, b".", 2, 12) + dirent(2, b"..", 2, 12) + dirent(12, b"sub", 2, 16) + dirent(0, b"gone", 1, 984)
    img[21 * 1024 : 22 * 1024] = dirent(13, b"file.txt", 1, 24) + dirent(12, b"self", 2, 1000)
    return bytes(img)


def test_ext4():
    rows = {e.path: e for e in ext.entries(ext4_volume())}
    assert set(rows) == {"/sub", "/gone", "/sub/file.txt", "/sub/self"}
    f = rows["/sub/file.txt"]
    assert (f.size, f.created, f.modified, f.data_offset) == (999, 111, 222, 22 * 1024) and rows["/gone"].is_deleted


def test_fragmented_table(spark, tmp_path):
    """Half of the table's clusters lie elsewhere, in reverse; what lies behind its first stretch is no record."""
    names = [f"f{k}" for k in range(12)]
    flat = ntfs_volume([record("$MFT", 5, size=12 * 1024, lcn=4), *[record(n, 5) for n in names[1:]]])
    boot = ntfs.Boot(flat[:512])
    whole = flat[boot.table :]
    per = boot.cluster // boot.record
    clusters = [whole[k : k + boot.cluster] for k in range(0, 12 * boot.record, boot.cluster)]
    half = len(clusters) // 2
    far = (boot.table // boot.cluster) + half + 3
    rest = len(clusters) - half
    data = bytearray(flat[: boot.table]) + b"".join(clusters[:half]) + b"\xee" * (3 * boot.cluster) + b"".join(clusters[half:])
    runs = bytes([0x11, half, boot.table // boot.cluster, 0x11, rest, far - boot.table // boot.cluster, 0])
    at = boot.table + ntfs.u16(data, boot.table + 20)
    while ntfs.u32(data, at) != 0x80:
        at += ntfs.u32(data, at + 4)
    place = at + ntfs.u16(data, at + 32)
    data[place : place + len(runs)] = runs
    assert per >= 1 and ntfs.table_runs(bytes(data), 0, boot)[1] == [(boot.table, half * boot.cluster), (far * boot.cluster, rest * boot.cluster)]
    assert [e.name for e in ntfs.entries(bytes(data))] == ["$MFT", *names[1:]]
    (tmp_path / "split.img").write_bytes(data)
    volumes = spark.createDataFrame([(1, str(tmp_path / "split.img"), 0, "NTFS")], "image_id long, path string, part_offset long, fs string")
    assert listing.list_entries(volumes).count() == 12
