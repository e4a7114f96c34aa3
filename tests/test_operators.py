"""Core operators on small inputs: reference vectors, nulls, ties, repeated rows, empty tables."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from siltbed.functions import formats
from siltbed.operators import artifacts as A
from siltbed.operators import health as H
from siltbed.operators import intervals as I
from siltbed.operators import partitions as P
from siltbed.operators import profiles as R
from siltbed.operators import textblocks as X
from siltbed.operators.carving import scan as C
from siltbed.operators.carving import sizes as Z
from siltbed.operators.carving.checks import CHECKS, passes, prefiltered
from siltbed.operators.carving.signatures import SIGNATURES, header_positions, user_signature
from siltbed.streaming import guards


def scanned(spark, *texts):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "id long, body string, value string")
    return sorted((r.id, r.kind, r.byte_offset, r.value, r.confidence) for r in A.scan(df, "body", None, "id").collect())


def test_artifacts(spark):
    got = scanned(
        spark, "contact us at alice@example.com for help", "é from: bob@test.org", "See https://example.com.", "card: 4111111111111111 expiry 12/26", "1234567890123456 4111111111111112",
        "GB82WEST12345698765432 GB00WEST12345698765432 DE89370400440532013000", "123-45-6789 000-45-6789 666-45-6789 123-00-6789 555-867-5309 912-34-5678", "C:\\Windows\\System32\\cmd.exe executed", None, "",
    )
    assert got == [
        (0, "Email", 14, "alice@example.com", "Low"), (1, "Email", 9, "bob@test.org", "Low"), (2, "URL", 4, "https://example.com", "High"), (3, "Credit Card", 6, "****-****-****-1111", "High"),
        (5, "IBAN", 0, "GB82WEST12345698765432", "High"), (5, "IBAN", 46, "DE89370400440532013000", "High"), (6, "SSN", 0, "123-45-6789", "High"), (6, "SSN", 61, "912-34-5678", "High"),
        (7, "Windows Path", 0, "C:\\Windows\\System32\\cmd.exe executed", "High"),
    ]


def test_artifact_dedup_keeps_first(spark):
    df = spark.createDataFrame([(5, "SSN", "a", "High"), (3, "SSN", "a", "High"), (3, "SSN", "a", "High"), (9, "IBAN", "a", "High")], "byte_offset long, kind string, value string, confidence string")
    assert sorted(tuple(r) for r in A.deduplicate(df).collect()) == [(3, "SSN", "a", "High"), (9, "IBAN", "a", "High")]


@pytest.mark.parametrize(
    ("text", "kind", "extension"),
    [
        ("<?php echo 1;", "Php", "php"), ("#!/usr/bin/env python\nx", "Script", "py"), ("#!/bin/sh\nx", "Script", "sh"), ("#!/usr/bin/ruby", "Script", "rb"), ("#!/usr/bin/node", "Script", "js"), ('<?xml version="1.0"?>', "Markup", "xml"),
        ("<!doctype html><html>", "Markup", "html"), ('{"a":1,"b":2}', "Json", "json"), ("---\na: 1", "Yaml", "yaml"), ("SELECT a FROM b WHERE c", "Sql", "sql"), ("#include <x>\nvoid f(int a)", "CSource", "c"),
        ("# T\n**b** [x](y)", "Markdown", "md"), ("plain", "Generic", "txt"), ("", "Generic", "txt"), (None, None, None),
    ],
)
def test_classify(spark, text, kind, extension):
    r = spark.createDataFrame([(text,)], "t string").select(X.classify(F.col("t")).alias("c")).first().c
    assert (r and r.kind, r and r.extension) == (kind, extension)


def test_segments_like_a_state_machine():
    rng = random.Random(5)

    def machine(data):
        text = lambda b: b in (9, 10, 13) or 0x20 <= b <= 0x7E or 0x80 <= b <= 0xBF or 0xC2 <= b <= 0xF4
        out, run, start, gap = [], 0, None, 0
        for i, b in enumerate(data):
            if start is None:
                run = run + 1 if text(b) else 0
                if run == 3:
                    start, gap = i - 2, 0
            elif text(b):
                gap = 0
            else:
                gap += 1
                if gap > 8:
                    out.append((start, i - gap + 1))
                    start, run = None, 0
        if start is not None:
            out.append((start, len(data)))
        return out

    for _ in range(300):
        data = bytes(rng.choice([65, 66, 10, 0, 1, 0xC0, 0xF5]) if rng.random() < 0.8 else 0 for _ in range(rng.randint(0, 80)))
        assert [(a, a + len(b)) for a, b in X.segment_bytes(data)] == machine(data)


def test_carve_text_blocks(spark):
    chunk = b"\0" * 20 + b"A" * 300 + b"\0" * 20 + b"short" + b"\0" * 20
    df = spark.createDataFrame([(1, 1000, chunk), (2, 0, None), (3, 0, b"")], "image_id long, base_offset long, content binary")
    assert [(r.image_id, r.byte_offset, r.length, r.quality) for r in X.carve(df).collect()] == [(1, 1020, 300, 100)]


def test_carve_text_blocks_over_borders(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    data = b"".join(rng.choice([b"text ", b"\0", b"\xc3\xa9"]) * rng.choice([1, 2, 4, 8, 9, 10, 60, 150]) for _ in range(150))
    data = b"A" * 5000 + bytes(9) + data + b"B" * 999 + bytes(4)
    want = []
    for at, block in X.segment_bytes(data):
        good = sum(b in b"\t\n\r" or 32 <= b < 127 for b in block) * 100 // len(block)
        if len(block) >= X.MIN_BLOCK and good >= X.MIN_QUALITY:
            want.append((at, len(block), good, block.decode("utf-8", "replace")))
    assert len(want) > 3
    path = tmp_path / "text.img"
    path.write_bytes(data)
    rows = lambda df: sorted((r.byte_offset, r.length, r.quality, r.content) for r in df.collect())
    # overlapping chunks with a report bound
    assert rows(X.carve(C.image_chunks(spark, [(7, str(path))], chunk=2000))) == want
    plain = [(7, k, data[k : k + 300]) for k in range(0, len(data), 300)]
    assert rows(X.carve(spark.createDataFrame(plain, "image_id long, base_offset long, content binary"))) == want
    # in small cuts, down to blocks of a few bytes
    monkeypatch.setattr(X, "MAX_BLOCK", 40)
    for _ in range(300):
        part = b"".join(rng.choice([b"x", b"\0"]) * rng.choice([1, 2, 3, 5, 8, 9, 20]) for _ in range(rng.randint(1, 12)))
        cuts = sorted({0, len(part), *(rng.randint(0, len(part)) for _ in range(6))})
        names = ["base_offset", "n", "lead", "tail", "single", "first", "opens", "last"]
        outlines = [dict(zip(names, (a, *X._outline(part[a:b])))) for a, b in zip(cuts, cuts[1:])]
        got: dict = {}
        for (a, *state), b in zip(X._follow(outlines), cuts[1:]):
            for block, at, content, _ in X._pieces(part[a:b], a, *state):
                got.setdefault(block, []).append((at, content))
        assert [(k, b"".join(x for _, x in sorted(v))) for k, v in sorted(got.items())] == list(X.segment_bytes(part))


def test_preview(spark):
    assert spark.createDataFrame([("hello\r\nworld",)], "t string").select(X.preview(F.col("t")).alias("p")).first().p == "hello↵↵world"


def test_suppress_gap_like_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2]), rng.randint(0, 3000), rng.choice([0, 50, 200]), k) for k in range(400)] + [(None, 1, 1, 900), (1, None, 1, 901)]
    want = []
    for key in (1, 2):
        last = None
        for r in sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: (r[1], r[3])):
            if r[2] == 0 or last is None or r[1] >= last + r[2]:
                want.append(r)
                last = r[1] if r[2] else last
    df = spark.createDataFrame(rows, "k long, at long, gap long, id long")
    got = [tuple(r) for r in I.suppress_gap(df, ["k"], "at", "gap", "id", width=128).collect()]
    assert sorted(got) == sorted(want)
    assert I.suppress_gap(df.limit(0), ["k"], "at", "gap", "id").count() == 0


def test_map_overlay_like_an_array(spark):
    rng = random.Random(2)
    rows = [(1, s, rng.randint(0, 150), rng.randint(1, 60), rng.choice("+-*?")) for s in range(40)]
    cells = {}
    for _, _, pos, size, status in rows:
        cells.update(dict.fromkeys(range(pos, pos + size), status))
    got = I.overlay(spark.createDataFrame(rows, "k long, seq long, pos long, size long, status string"), ["k"]).collect()
    assert {p: r.status for r in got for p in range(r.pos, r.pos + r["size"])} == cells
    ordered = sorted(got, key=lambda r: r.pos)
    assert all(a.pos + a["size"] != b.pos or a.status != b.status for a, b in zip(ordered, ordered[1:]))


def test_reconstruct_partition(spark):
    df = spark.createDataFrame([(1, 2048, "NTFS", 409600)], "image_id long, start_lba long, fs_type string, disk long")
    r = I.reconstruct_partitions(df, ["image_id"], "disk").first()
    assert (r.end_lba, r.size_lba, r.name) == (409599, 407552, "Recovered NTFS partition")


def test_profile_and_extension_stats(spark):
    listing = spark.createDataFrame([("photo.jpg", 2000, False, False), ("old.jpg", 1000, False, True), ("song.mp3", 5000, False, False), ("dir", None, True, False), (None, 1, False, False)], "name string, size long, is_dir boolean, is_deleted boolean")
    got = {r.category: (r.active_count, r.deleted_count, r.active_bytes, r.deleted_bytes) for r in R.profile(listing).collect()}
    assert got == {"Images": (1, 1, 2000, 1000), "Audio": (1, 0, 5000, 0)}
    assert R.drive_type(R.profile(listing)).first().drive_type == "Photo"
    assert R.drive_type(R.profile(listing.limit(0))).first().drive_type == "Empty"
    assert {r.ext: r.avg_bytes for r in R.extension_stats(listing).collect()} == {"jpg": 1500, "mp3": 5000}


def test_join_name_size_and_hash(spark):
    carved = spark.createDataFrame([(1, "A.txt", 10), (2, "a.TXT", 13), (3, "b", 1), (4, None, 1), (5, "a.txt", None)], "carved_id long, name string, size long")
    source = spark.createDataFrame([(1, "a.txt", 10), (2, "a.txt", 10), (3, "a.txt", 15), (4, "c", 1)], "source_id long, name string, size long")
    got = {r.carved_id: (r.verdict, r.source_id, r.delta) for r in R.join_name_size(carved, source).collect()}
    assert got == {1: ("matched", 1, 0), 2: ("mismatch", 3, -2), 3: ("unrecognised", None, None), 4: ("unrecognised", None, None), 5: ("unrecognised", None, None)}
    assert [r.source_id for r in R.not_recovered(carved, source).collect()] == [4]
    c = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", "z"), (4, "q", "w"), (5, "a", None)], "carved_id long, name string, content string")
    s = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "source_id long, name string, content string")
    assert {r.carved_id: r.verdict for r in R.join_hash(c, s).collect()} == {1: "identical", 2: "alt_source", 3: "damaged", 4: "source_missing", 5: "carved_unreadable"}


def png():
    part = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", b"\0" * 13) + part(b"IDAT", b"x" * 40) + part(b"IEND", b"")


def test_signatures_and_checks():
    assert len(SIGNATURES) == 140 and {s.check for s in SIGNATURES if s.check} == set(CHECKS)
    assert passes("png", png() + b"\0" * 9, 0) and not passes("pdf", b"%PDF+1.4", 0)
    assert passes("zip", b"PK\x03\x04", 0) and not passes("plist", b"bplist00", 0)
    assert user_signature("x", ".abc", "FF ??", "", 5).extension == "abc"
    with pytest.raises(ValueError):
        user_signature("x", "abc", "", "", 5)


def test_header_positions():
    rng = random.Random(8)
    for _ in range(200):
        header = tuple(rng.choice([None, 1, 2]) for _ in range(rng.randint(1, 5)))
        data, report = bytes(rng.choice([1, 2]) for _ in range(rng.randint(0, 30))), rng.randint(0, 30)
        fits = [k for k in range(min(report, max(0, len(data) - len(header) + 1))) if all(b is None or data[k + j] == b for j, b in enumerate(header))]
        assert list(header_positions(header, data, report)) == (fits if any(b is not None for b in header) else [])


def test_prefilter_loses_nothing():
    rng = random.Random(3)
    for s in SIGNATURES:
        for _ in range(20):
            data = bytearray(rng.choices([0x47, 0x0A, 0, 1, 5, 8], k=rng.randint(0, 900)))
            report = rng.randint(0, len(data))
            found = prefiltered(s.check, bytes(data), s.header, report)
            if found is not None:
                want = [p for p in s.positions(bytes(data), report) if passes(s.check, bytes(data), p)]
                assert [p for p in found if passes(s.check, bytes(data), p)] == want


def test_matcher_finds_what_single_searches_find():
    rng = random.Random(6)
    matcher = C.Matcher(SIGNATURES)
    for _ in range(150):
        data = bytearray(rng.randbytes(rng.randint(0, 1500)))
        for s in rng.sample(SIGNATURES, 6):
            at = rng.randint(0, len(data))
            data[at : at + len(s.header)] = bytes(rng.randrange(256) if b is None else b for b in s.header)
        data, report = bytes(data), rng.randint(0, len(data))
        want = {(p, s.name) for s in SIGNATURES for p in s.positions(data, report) if passes(s.check, data, p)}
        assert {(p, s.name) for p, s in matcher.find(data, report)} == want


def test_sizes():
    assert Z.resolve("linear(@4,len=4,le,+8)", b"RIFF" + struct.pack("<I", 100), 0, 1000) == 108
    assert Z.png(b"junk" + png() + b"tail", 4, 1 << 20) == len(png())
    assert Z.gif(b"GIF89a\1\0\1\0\0\0\0\x3b..", 0, 100) == 14
    assert Z.midi(b"MThd\0\0\0\6\0\0\0\1\0\1MTrk\0\0\0\2ab", 0, 100) == 24
    assert Z.tar(b"a" * 124 + b"00000000003\0" + b"\0" * 376 + b"x" * 512 + b"\0" * 1024, 0, 1 << 20) == 2048
    assert Z.adts(b"\xff\xf1" + b"\0" * 9, 0, 100) is None
    for s in SIGNATURES:
        assert Z.resolve(s.size_rule, b"", 0, 100) is None


def test_scan_image_across_chunks(spark, tmp_path):
    body = bytearray(b"\x11" * 300_000)
    for at in (100, 65_530, 200_000):
        body[at : at + len(png())] = png()
    path = tmp_path / "disk.img"
    path.write_bytes(bytes(body))
    chunks = C.image_chunks(spark, [(7, str(path))], chunk=65_536)
    pngs = [s for s in SIGNATURES if s.name == "PNG Image"]
    hits = C.scan(chunks, pngs)
    assert sorted(r.byte_offset for r in hits.collect()) == [100, 65_530, 200_000]
    out = C.sized(hits, {7: str(path)}, pngs).collect()
    assert {(r["size"], r.status) for r in out} == {(len(png()), "Ok")}
    assert C.scan(C.image_chunks(spark, [(7, str(path))], chunk=65_536, start=150_000), pngs).count() == 1


def gpt_image(damage=False):
    entry = bytes(range(16)) + bytes(16) + struct.pack("<QQQ", 34, 99, 0) + "Data".encode("utf-16-le").ljust(72, b"\0")
    table = entry + bytes(128 * 3)
    head = lambda at: struct.pack("<8sIIIIQQQQ16sQIII", b"EFI PART", 0x10000, 92, 0, 0, 1, 199, 34, 150, bytes(16), at, 4, 128, zlib.crc32(table))
    sign = lambda h: h[:16] + struct.pack("<I", zlib.crc32(h)) + h[20:]
    img = bytearray(512 * 200)
    img[450], img[510:512] = 0xEE, b"\x55\xaa"
    img[512 : 512 + 92], img[1024 : 1024 + 512] = sign(head(2)), table
    img[512 * 199 : 512 * 199 + 92], img[512 * 190 : 512 * 190 + 512] = sign(head(190)), table
    if damage:
        img[600] ^= 0xFF
        img[520] ^= 0xFF
    return bytes(img)


def test_partition_tables(spark):
    df = spark.createDataFrame([(1, gpt_image()), (2, gpt_image(True)), (3, b"short"), (4, None)], "image_id long, content binary")
    got = sorted((r.image_id, r.start_lba, r.end_lba, r.name, r.from_backup) for r in P.gpt_entries(df).collect())
    assert got == [(1, 34, 99, "Data", False), (2, 34, 99, "Data", True)]
    assert P.mbr_entries(df).count() == 0
    assert [r.p for r in df.select(P.is_protective(F.col("content")).alias("p")).collect()][:2] == [True, True]


def test_smart(spark):
    rows = [
        (1, '{"smart_status":{"passed":true},"temperature":{"current":40}}'), (2, '{"smart_status":{"passed":false}}'), (3, '{"smart_status":{"passed":true},"temperature":{"current":55}}'), (4, '{"smart_status":{"passed":true},"temperature":{"current":65}}'),
        (5, '{"smart_status":{"passed":true},"ata_smart_attributes":{"table":[{"id":5,"raw":{"value":3}}]}}'), (6, "{x"), (7, None), (8, "{}"),
    ]
    got = {r.id: r.verdict for r in H.verdict(spark.createDataFrame(rows, "id long, j string"), "j", "id").collect()}
    assert got == {1: "Healthy", 2: "Critical", 3: "Warning", 4: "Critical", 5: "Warning", 6: "Unknown", 7: "Unknown", 8: "Critical"}
    text = spark.createDataFrame([("Error: UNC 8 sectors at LBA = 0x000bc4a2 = 771234",), (None,), ("none",)], "m string")
    assert [r.x for r in text.select(H.bad_lba(F.col("m")).alias("x")).collect()] == [771234, None, None]


def test_guard_stream(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}", s * 100 if s < 300 else 30_000 + (s - 300) * 10, 60.0 if 30 <= s < 60 else 45.0) for s in range(0, 600, 10)]
    src = spark.createDataFrame(rows, "device long, ts string, bytes_done long, temperature double").withColumn("ts", F.to_timestamp("ts"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = guards.guard_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("guard_events").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.event for r in spark.table("guard_events").orderBy("ts").collect()] == ["pause: heat", "resume: heat", "pause: speed"]


def test_formats(spark):
    df = spark.createDataFrame([(1024, "/a/../b:c", 127), (1536, None, 128), (1073741824, "", 256), (5, "x", 0), (None, "y", None)], "n long, p string, v int")
    got = df.select(formats.human_bytes(F.col("n")).alias("h"), formats.carved_name(F.col("p"), F.lit("jpg"), F.lit(7)).alias("c")).collect()
    assert [r.h for r in got] == ["1.00 KiB", "1.50 KiB", "1.00 GiB", "5 B", None]
    assert [r.c for r in got] == ["a/b_c", "file_jpg_7.jpg", "file_jpg_7.jpg", "x", "y"]
