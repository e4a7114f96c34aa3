"""Imaging passes against a loop over sectors; map files; quality of extracted files."""

import random
import struct

from pyspark.sql import functions as F

from siltbed.operators import imaging
from siltbed.operators.carving import quality as Q
from siltbed.sources import mapfiles
from tests.test_operators import png


def cells(df):
    return {p: r.status for r in df.collect() for p in range(r.pos, r.pos + r["size"])}


def test_passes_like_a_loop(spark):
    rng = random.Random(4)
    bad = sorted(rng.sample(range(200), 12))
    blocks = spark.createDataFrame([(1, 0, 200, "?")], "device long, pos long, size long, status string")
    b = spark.createDataFrame([(1, s) for s in bad] + [(1, 9999)], "device long, sector long")
    one = imaging.copy_pass(blocks, b, chunk=16).cache()
    assert cells(one) == {s: "*" if any(x // 16 == s // 16 for x in bad) else "+" for s in range(200)}
    two = imaging.trim_pass(one, b, chunk=16).cache()
    want = {}
    for s in range(200):
        first = next((x for x in bad if x // 16 == s // 16), None)
        want[s] = "+" if first is None or s < first else "-" if s == first else "/"
    assert cells(two) == want
    assert cells(imaging.scrape_pass(two, b)) == {s: "-" if s in bad else "+" for s in range(200)}
    assert imaging.copy_pass(blocks.limit(0), b).count() == 0
    assert imaging.known_bad(blocks, b, 200).count() == 12


def test_map_files(spark, tmp_path):
    blocks = spark.createDataFrame([(0, 512, "+"), (512, 1024, "-"), (1536, 10, "?")], "pos long, size long, status string")
    mapfiles.write_map(blocks, str(tmp_path / "m"))
    back = mapfiles.read_map(spark, str(tmp_path / "m"))
    assert sorted((r.pos, r["size"], r.status, r.checksum_ok) for r in back.collect()) == [(0, 512, "+", True), (512, 1024, "-", True), (1536, 10, "?", True)]
    (tmp_path / "x.txt").write_text("# note\n# crc32: 00000000\n0x0 ?\n0x0 0x200 +\n0x200 0x200 -\njunk\n0x400 0x0 +\n")
    rows = mapfiles.read_map(spark, str(tmp_path / "x.txt")).collect()
    assert [(r.pos, r.status, r.checksum_ok) for r in rows] == [(0, "+", False), (512, "-", False)]


def test_quality(spark):
    flac = b"fLaC" + bytes([0x80, 0, 0, 34]) + bytes(34)
    mp4 = struct.pack(">I4s4s", 12, b"ftyp", b"isom") + struct.pack(">I4s", 8, b"mdat")
    cases = [
        ("png", png(), "Complete"), ("png", png()[:-3], "Corrupt"), ("gif", b"GIF89a;", "Complete"), ("jpg", b"\xff\xd8\xff\xd9", "Complete"), ("jpg", b"\xff\xd8\xff", "Corrupt"), ("flac", flac, "Complete"), ("flac", flac[:-1], "Corrupt"),
        ("mp4", mp4, "Complete"), ("mp4", mp4[:12], "Corrupt"), ("html", b"<html><body>" + b"x" * 40 + b"</body></html>\n", "Complete"), ("html", b"<html><body></body></html>", "Corrupt"), ("pdf", b"%PDF-1.4\nxref\nstartxref\n9\n%%EOF", "Complete"),
        ("pdf", b"%PDF-1.4", "Corrupt"), ("ole", b"x", "Unknown"), ("zip", b"PK\x05\x06" + bytes(18), "Complete"), (None, b"x", "Unknown"), ("png", None, "Unknown"), ("png", b"", "Corrupt"), ("dat", b"regf" + bytes(4092) + b"hbin", "Complete"),
    ]
    df = spark.createDataFrame([(k, e, c) for k, (e, c, _) in enumerate(cases)], "id int, e string, c binary")
    got = {r.id: r.q for r in df.select("id", Q.quality(F.col("e"), F.col("c"), F.lit(False)).alias("q")).collect()}
    assert [got[k] for k in range(len(cases))] == [x for _, _, x in cases]
    assert Q.judge("png", png(), True) == "Truncated"
    rng = random.Random(1)
    for e in Q.RULES:
        for _ in range(20):
            assert Q.judge(e, rng.randbytes(rng.randint(0, 300))) in ("Complete", "Corrupt")


def test_preview(spark):
    from siltbed.operators.carving import preview as V

    zipped = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 20, 0, 0, 0, 0, 0, 3, 3, 5, 0) + b"a.txtabc" + struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 20, 0, 0, 0, 0, 0, 0, 0, 1, 0) + b"b"
    assert V.describe("zip", zipped)["entries"] == "a.txt, b"
    assert V.describe("gif", b"GIF89a" + struct.pack("<HH", 7, 9) + b"\0" * 5)["size"] == "7x9"
    assert V.describe("pdf", b"%PDF /Title (Report) /Author(A)") == {"format": "PDF", "title": "Report", "author": "A"}
    assert V.describe("xyz", b"abc") == {"format": "XYZ"} and V.describe("exe", b"MZ") == {"format": "EXE"} and V.describe(None, None) == {"format": ""}
    link = bytearray(76 + 40)
    struct.pack_into("<I", link, 20, 2)
    struct.pack_into("<I", link, 76 + 16, 28)
    body = bytes(link[:104]) + b"C:\\dir\\file.txt\0"
    assert V.lnk_name(body) == "file.txt" and V.lnk_name(b"x") is None
    assert V.prefetch_name(bytes(16) + "CMD.EXE".encode("utf-16-le") + bytes(60)) == "cmd.exe"
    df = spark.createDataFrame([("gif", b"GIF89a" + struct.pack("<HH", 7, 9) + b"\0" * 5), (None, None)], "e string, c binary")
    assert [r.v["format"] for r in df.select(V.preview(F.col("e"), F.col("c")).alias("v")).collect()] == ["GIF", ""]
