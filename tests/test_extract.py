"""Bytes of hits against plain slices, with missing, null, overlapping and clashing chunks."""

from siltbed.operators.carving import extract
from siltbed.sources import sinks


def test_pieces_and_whole_files(spark):
    body = bytes(range(256)) * 4
    chunks = [(1, k * 100, body[k * 100 : k * 100 + 120], 9) for k in range(11) if k not in (3, 7)] + [(1, 700, None, 9), (None, 0, b"x", 9), (2, 5, b"", 9)]
    c = spark.createDataFrame(chunks, "image_id long, base_offset long, content binary, size int")
    hits = [(1, 0, 50), (1, 90, 300), (1, 640, 400), (1, 640, 400), (1, 5000, 10), (1, None, 4), (1, 3, 0), (1, 4, None), (2, 0, 3)]
    h = spark.createDataFrame(hits, "image_id long, byte_offset long, size long")

    def want(at, size):
        held = {k for k in range(len(body)) if any(k // 100 - back not in (3, 7) and k - (k // 100 - back) * 100 < 120 for back in (0, 1) if k // 100 - back >= 0)}
        return bytes(body[k] if k in held and k < len(body) else 0 for k in range(at, at + size)), sum(k not in held for k in range(at, at + size))

    for piece in (64, 1000):
        got = {(r.image_id, r.byte_offset, r.size): (bytes(r.content), r.n_zero) for r in extract.extract_to_vec(h, c, piece).collect()}
        assert got == {(1, a, n): want(a, n) for a, n in ((0, 50), (90, 300), (640, 400), (5000, 10))} | {(2, 0, 3): (b"\0\0\0", 3)}
        pieces = extract.read_pieces(h, c, piece).where("image_id = 1 AND byte_offset = 640").orderBy("piece_no").collect()
        assert b"".join(bytes(p.content) for p in pieces) == want(640, 400)[0] and [p.piece_no for p in pieces] == list(range(len(pieces)))
    assert extract.extract_to_vec(h, c, 64, whole=100).where("content IS NULL").count() == 2
    assert extract.extract_to_vec(h.limit(0), c).count() == 0
    assert extract.extract_to_vec(h.limit(1), c.limit(0)).first().n_zero == 50


def test_names_are_numbered_over_blocks(spark):
    ids = [3, 250_000, 7, 1_000_001, 99_999]
    df = spark.createDataFrame([(i, "a.b.txt") for i in ids] + [(1, "plain"), (2, "plain"), (5, None)], "file_id long, file_name string")
    got = {r.file_id: r.file_name for r in sinks.unique_names(df.where("file_name IS NOT NULL")).collect()}
    assert got == {3: "a.b.txt", 7: "a.b[2].txt", 99_999: "a.b[3].txt", 250_000: "a.b[4].txt", 1_000_001: "a.b[5].txt", 1: "plain", 2: "plain[2]"}
