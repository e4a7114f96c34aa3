"""Files, checkpoints and signatures written and read again; boot areas; duplicates."""

import hashlib

from pyspark.sql import functions as F

from siltbed.operators import imaging
from siltbed.operators import partitions as P
from siltbed.operators.carving import scan as C
from siltbed.operators.carving.signatures import user_signature
from siltbed.sources import sinks
from tests.test_imaging import cells


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("/a/../b?.txt", b"one", 1_000_000), (None, b"x", 1), ("c.txt", None, 1), ("d.txt", b"", None)], "file_name string, content binary, modified long")
    got = {r.file_name: (r.n_bytes, r.sha256) for r in sinks.write_files(df, str(tmp_path)).collect()}
    assert got == {"a/b_.txt": (3, hashlib.sha256(b"one").hexdigest()), "d.txt": (0, hashlib.sha256(b"").hexdigest())}
    assert (tmp_path / "a" / "b_.txt").read_bytes() == b"one" and (tmp_path / "a" / "b_.txt").stat().st_mtime == 1_000_000
    assert [r.line for r in sinks.sha256_lines(df.limit(1)).collect()] == [hashlib.sha256(b"one").hexdigest() + "  /a/../b?.txt"]
    names = spark.createDataFrame([(1, "a.tar.gz"), (2, "a.tar.gz"), (3, "x"), (4, "x")], "file_id long, file_name string")
    assert {r.file_id: r.file_name for r in sinks.unique_names(names).collect()} == {1: "a.tar.gz", 2: "a.tar[2].gz", 3: "x", 4: "x[2]"}


def test_checkpoints(spark, tmp_path):
    folder = str(tmp_path / "cp")
    for state in ("Unextracted", "Ok"):
        sinks.append_checkpoint(spark.createDataFrame([(5, "PNG", state)], "byte_offset long, signature string, state string"), folder)
    assert [tuple(r) for r in sinks.compact_checkpoint(spark, folder).collect()] in ([(5, "PNG", "Ok")], [(5, "PNG", "Unextracted")])


def test_signatures(tmp_path):
    own = [user_signature('My "x"', "abc", "FF ?? D8", "00 01", 10)]
    sinks.save_user_signatures(own, str(tmp_path / "s.toml"))
    assert sinks.load_user_signatures(str(tmp_path / "s.toml")) == own


def test_text_stubs(spark):
    df = spark.createDataFrame([(255, 10, "Generic", None, 50, 90, "eng", "hi")], "byte_offset long, length long, kind string, extension string, confidence int, quality int, lang string, preview string")
    r = sinks.text_stubs(df).first()
    assert r.file_name == "text_000000FF.txt" and b"preview: hi" in r.content


def test_boot_areas(spark):
    img = bytearray(4096)
    img[515:523] = b"NTFS    "
    df = spark.createDataFrame([(1, 0, bytes(img), 4096), (2, 0, None, 0)], "image_id long, base_offset long, content binary, report int")
    assert [tuple(r) for r in P.scan_boot_areas(df).collect()] == [(1, 512, "NTFS")]
    areas = spark.createDataFrame([(1, 2, 99, bytes(img[512:])), (1, 0, 0, b"")], "image_id long, rank int, start_byte long, content binary")
    assert [tuple(r) for r in P.probe(areas).collect()] == [(1, 99, "NTFS")]


def test_duplicates(spark, tmp_path):
    (tmp_path / "i").write_bytes(b"A" * 8192 + b"B" * 100)
    hits = spark.createDataFrame([(1, 0), (1, 4096), (1, 8192), (2, 0)], "image_id long, byte_offset long")
    prints = C.fingerprints(hits, {1: str(tmp_path / "i")})
    got = {(r.image_id, r.byte_offset): r.duplicate for r in C.duplicates(hits, prints).collect()}
    assert got == {(1, 0): False, (1, 4096): True, (1, 8192): False, (2, 0): False}


def test_sweep_and_retry(spark):
    blocks = spark.createDataFrame([(1, 0, 8, "?"), (1, 8, 4, "*"), (1, 12, 2, "-"), (1, 14, 2, "/")], "device long, pos long, size long, status string")
    bad = spark.createDataFrame([(1, 3), (1, 12), (1, 13)], "device long, sector long")
    assert cells(imaging.sweep_pass(blocks, bad, chunk=4)) == dict(enumerate("+++-++++****--//"))
    recovers = spark.createDataFrame([(1, 12, 2), (1, 13, 9)], "device long, sector long, attempt int")
    assert cells(imaging.retry_pass(blocks, bad, recovers)) == dict(enumerate("????????****+-//"))
