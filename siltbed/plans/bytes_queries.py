"""Binary structures made from table columns: sizes, quality, partitions, extraction, small formats.

Every query writes bytes whose right reading follows from a number of the row, so that plain SQL can say what
must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import formats
from siltbed.operators import drift
from siltbed.operators import partitions as P
from siltbed.operators.carving import extract, quality, sizes
from siltbed.operators.carving.signatures import SIGNATURES
from siltbed.plans.lineage import cut
from siltbed.sources import sinks
from siltbed.sources.tables import table


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id`` and a small number ``n`` of each device."""
    d = table(spark, sf_dir, "devices", "image_id").where("image_id IS NOT NULL").distinct()
    return d.withColumn("n", F.col("image_id") % 40 + 1)


_SQL_N = "n AS (SELECT DISTINCT image_id, image_id % 40 + 1 AS n FROM devices WHERE image_id IS NOT NULL)"


def be(value: Column | int, width: int) -> Column:
    value = F.lit(value) if isinstance(value, int) else value
    return F.lpad(F.hex(value.cast("long")), 2 * width, "0")


def le(value: Column | int, width: int) -> Column:
    value = (F.lit(value) if isinstance(value, int) else value).cast("long")
    return F.concat(*[F.lpad(F.hex(F.shiftright(value, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(width)])


def z(n: int) -> Column:
    return F.lit("00" * n)


def rep(hexed: str | Column, n: Column | int) -> Column:
    return F.repeat(F.lit(hexed) if isinstance(hexed, str) else hexed, F.lit(n) if isinstance(n, int) else n.cast("int"))


def text(value: str | Column) -> Column:
    return F.hex(F.encode(F.lit(value) if isinstance(value, str) else value, "UTF-8"))


def x(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _tiff(kind: int) -> Column:
    N = F.col("n")  # noqa: N806
    return x("49492A00", le(8, 4), le(2, 2), le(0x111, 2), le(kind, 2), le(1, 4), le(100, 4), le(0x117, 2), le(kind, 2), le(1, 4), le(N, 4), z(4))


def _pe(size: Column | int) -> Column:
    return x("4D5A", z(58), le(64, 4), "50450000", z(2), le(1, 2), z(12), le(0, 2), z(2), text(".text"), z(3), z(8), le(size, 4), le(20, 4), z(16))


#: Size in SQL of the made file of each rule.
SIZES = {
    "linear(@4,len=4,le,+8)": "n * 10 + 8",
    "linear_scaled(@4,len=2,be,x512,+16)": "n * 512 + 16",
    "ole2": "(n * 128 + 1) * 512",
    "sqlite": "n * 4096",
    "seven_zip": "32 + 101 * n",
    "ogg_stream": "28 + n",
    "mp4": "24 + n",
    "tiff": "100 + n",
    "raf": "greatest(100 + n, 50 + 3 * n)",
    "mpeg_ts(off=0,stride=188)": "188 * n",
    "pe": "greatest(128, 20 + 512 * n)",
    "elf": "100 * n + 120",
    "rar": "46 + n",
    "ebml": "15 + n",
    "text_bound": "n",
    "ttf": "100 + n",
    "pdf": "1000 * n",
    "gif": "27 + n",
    "png": "32 + n",
    "jpeg": "12 + 2 * n",
    "iso9660": "2048 * n",
    "asf": "1000 * n",
    "tar": "1536 + 512 * n",
    "mpeg_ps": "8 + n",
    "au": "24 + n",
    "midi": "22 + n",
    "adts": "8 * (7 + n)",
}
#: Extensions of the made files whose state is judged; the last has no rule.
JUDGED = ["jpg", "png", "html", "gif", "pdf", "zip", "sqlite", "evtx", "wav", "exe", "mp4", "mkv", "flac", "elf", "regf", "tif", "xyz"]


def _size_cases() -> list[tuple[str, Column]]:
    """Rule of :data:`SIZES` and bytes as hex."""
    N = F.col("n")  # noqa: N806
    frame = x("FFF15000", be(F.floor((N + 7) / 8), 1), be((N + 7) % 8 * 32, 1), z(1), rep("00", N))
    octal = F.lpad(F.conv((N * 512).cast("string"), 10, 8), 11, "0")
    return [
        ("linear(@4,len=4,le,+8)", x("52494646", le(N * 10, 4), z(4))),
        ("linear_scaled(@4,len=2,be,x512,+16)", x(z(4), be(N, 2))),
        ("ole2", x(z(30), le(9, 2), z(12), le(N, 4))),
        ("sqlite", x(z(16), be(4096, 2), z(10), be(N, 4))),
        ("seven_zip", x(z(12), le(N * 100, 8), le(N, 8))),
        ("ogg_stream", x("4F6767530004", z(20), "01", be(N, 1), rep("00", N))),
        ("mp4", x(be(16, 4), text("ftyp"), z(8), be(N + 8, 4), text("mdat"), rep("00", N))),
        ("tiff", _tiff(4)),
        ("raf", x(z(84), be(100, 4), be(N, 4), be(50, 4), be(N * 3, 4))),
        ("mpeg_ts(off=0,stride=188)", rep("47" + "00" * 187, N)),
        ("pe", _pe(N * 512)),
        ("elf", x("7F454C460101", z(22), le(52, 4), le(N * 100, 4), z(6), le(32, 2), le(0, 2), le(40, 2), le(3, 2))),
        ("rar", x("526172211A0700", z(2), "74", le(0, 2), le(32, 2), le(N, 4), z(21), rep("00", N), z(2), "7B", le(0, 2), le(7, 2))),
        ("ebml", x("1A45DFA384", z(4), "18538067", be(N + 16384, 2), rep("00", N))),
        ("text_bound", x(rep("41", N), "00")),
        ("ttf", x(z(4), be(1, 2), z(14), be(100, 4), be(N, 4))),
        ("pdf", text(F.concat(F.lit("%PDF-1.4 /Linearized 1 /L "), (N * 1000).cast("string"), F.lit(" ")))),
        ("gif", x("474946383961", z(4), "00", z(2), "2C", z(8), "0008", be(N, 1), rep("00", N), "00", "3B")),
        ("png", x(z(8), be(N, 4), text("IDAT"), rep("00", N), z(4), be(0, 4), text("IEND"), z(4))),
        ("jpeg", x("FFD8FFE0", be(N + 2, 2), rep("00", N), "FFDA", be(2, 2), rep("11", N), "FFD9")),
        ("iso9660", x(z(32848), le(N, 4), z(44), le(2048, 2))),
        ("asf", x(z(24), le(1, 4), z(2), "A1DCAB8C47A9CF118EE400C00C205365", le(104, 8), z(16), le(N * 1000, 8))),
        ("tar", x(z(124), text(octal), z(1), z(376), rep("41", N * 512), z(1024))),
        ("mpeg_ps", x("000001BA", rep("FF", N), "000001B9")),
        ("au", x(z(4), be(24, 4), be(N, 4))),
        ("midi", x(z(10), be(1, 2), z(2), text("MTrk"), be(N, 4), rep("00", N))),
        ("adts", rep(frame, 8)),
    ]


def carve_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of a made file of every size rule, for each device."""
    cases = F.array(*[F.struct(F.lit(rule).alias("rule"), hexed.alias("h")) for rule, hexed in _size_cases()])
    made = _numbers(spark, sf_dir).select("image_id", F.inline(cases))
    return made.select("image_id", "rule", sizes.size_of(F.col("rule"), F.unhex("h")).alias("size"))


def _quality_cases() -> list[tuple[str, Column, Column]]:
    """Extension, bytes of a whole file and of a damaged one."""
    N = F.col("n")  # noqa: N806
    idat = x(text("IDAT"), rep("00", N))
    png = lambda crc: x("89504E470D0A1A0A", be(N, 4), idat, crc, be(0, 4), text("IEND"), "AE426082")
    chunk = x(text("fact"), le(4, 4), z(4))
    ftyp = x(be(16, 4), text("ftyp"), z(8))
    return [
        ("jpg", x("FFD8FFE0", be(N + 2, 2), rep("00", N), "FFD9"), x("FFD8FFE0", be(N + 2, 2), rep("00", N))),
        ("png", png(be(F.crc32(F.unhex(idat)), 4)), png(z(4))),
        ("html", text("<html><body>" + "word " * 9 + "</body></html>"), text("<html><body>" + "word " * 9)),
        ("gif", x("474946383961", rep("00", N), "3B"), x("474946383961", rep("00", N))),
        ("pdf", text("%PDF-1.4\nxref\nstartxref\n9\n%%EOF"), text("%PDF-1.4\nxref\nstartxref\n9\n")),
        ("zip", x("504B0506", z(12), le(0, 4), z(2)), x("504B0506", z(12), le(999999, 4), z(2))),
        ("sqlite", x(text("SQLite format 3"), "00", be(4096, 2), z(10), be(1, 4), z(68), "0D"), x(text("SQLite format 3"), "00", be(4096, 2), z(10), be(1, 4), z(68), "FF")),
        ("evtx", x(text("ElfFile"), z(4089), text("ElfChnk"), z(41), le(N + 512, 4)), x(text("ElfFile"), z(4089), text("ElfChnk"), z(41), le(1, 4))),
        ("wav", x(text("RIFF"), z(4), text("WAVE"), chunk, chunk, chunk), x(text("RIFF"), z(4), text("WAVE"), chunk, chunk)),
        ("exe", _pe(10), _pe(99999)),
        ("mp4", x(ftyp, be(N + 8, 4), text("mdat"), rep("00", N)), ftyp),
        ("mkv", x("1A45DFA384", z(4), "18538067", be(N + 16384, 2), rep("00", N)), x("1A45DFA384", z(10))),
        ("flac", x(text("fLaC"), "80000022", z(34)), x(text("fLaC"), "80000021", z(34))),
        ("elf", x("7F454C460101", z(58)), x("7F454C460301", z(58))),
        ("regf", x(text("regf"), z(4092), text("hbin")), x(text("regf"), z(4096))),
        ("tif", _tiff(4), _tiff(99)),
        ("xyz", rep("41", N), rep("42", N)),
    ]


def carve_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of a made file of every kind: whole for odd numbers, damaged for even ones, cut for every fifth."""
    N = F.col("n")  # noqa: N806
    made = F.array(*[F.struct(F.lit(e).alias("extension"), F.when(N % 2 == 1, good).otherwise(bad).alias("h")) for e, good, bad in _quality_cases()])
    rows = _numbers(spark, sf_dir).select("image_id", "n", F.inline(made))
    return rows.select("image_id", "extension", quality.quality(F.col("extension"), F.unhex("h"), N % 5 == 0).alias("state"))


def _gpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices of twelve sectors; the first table is damaged for even numbers, the copy at the end is whole."""
    N = F.col("n")  # noqa: N806
    entry = lambda first, last, name: x("A2A0D0EBE5B9334487C068B6B72699C7", z(16), le(first, 8), le(last, 8), z(8), F.hex(F.encode(F.lit(name), "UTF-16LE")), z(72 - 2 * len(name)))
    entries = x(entry(F.lit(2048), N * 100 + 2048, "data"), z(128), entry(N * 100 + 4096, N * 100 + 4100, "tail"), z(128))
    crc = lambda hexed: le(F.crc32(F.unhex(hexed)), 4)

    def header(at: int, damage: Column | None = None) -> Column:
        front, back = x(text("EFI PART"), "00000100", le(92, 4)), x(z(4), z(48), le(at, 8), le(4, 4), le(128, 4), crc(entries))
        whole = x(front, crc(x(front, z(4), back)), back, z(420))
        return whole if damage is None else F.when(damage, x(front, z(4), back, z(420))).otherwise(whole)

    mbr = x(z(446), "00", z(3), "EE", z(3), le(1, 4), le(11, 4), z(48), "55AA")
    body = x(mbr, header(2, N % 2 == 0), entries, rep("00", 512 * 7), entries, header(10))
    return _numbers(spark, sf_dir).select("image_id", F.unhex(body).alias("content"))


def part_gpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of GUID partition tables, from the copy where the first is damaged."""
    return P.gpt_entries(_gpt(spark, sf_dir)).select("image_id", "slot", "start_lba", "end_lba", "name", "from_backup")


def part_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions by table (protective: GPT, else MBR) or, where a device has none, by scanning for boot areas."""
    N = F.col("n")  # noqa: N806
    n = _numbers(spark, sf_dir)
    kind = F.col("image_id") % 3
    mbr = x(z(446), "80", z(3), "07", z(3), le(2048, 4), le(N, 4), z(48), "55AA")
    first = n.where(kind == 0).select("image_id", F.unhex(mbr).alias("content")).unionByName(_gpt(spark, sf_dir).where(kind == 1)).unionByName(n.where(kind == 2).select("image_id", F.unhex(z(512)).alias("content")))
    area = x(rep("00", N * 512 + 3), text("NTFS    "), rep("00", 512))
    chunks = n.where(kind == 2).select("image_id", F.lit(1 << 20).cast("long").alias("base_offset"), F.unhex(area).alias("content")).withColumn("report", F.octet_length("content"))
    found = P.scan_boot_areas(chunks).select("image_id", F.lit(0).alias("slot"), (F.col("start_byte") / 512).cast("long").alias("start_lba"), F.lit(None).cast("long").alias("size_lba"))
    return P.with_fallback(P.read_table(cut(first)), found)


def sector_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label of a made sector for every known beginning, per device."""
    N = F.col("n")  # noqa: N806
    labels = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("h")) for k, (p, _) in enumerate(P.SECTOR_LABELS)], F.struct(F.lit(-1).alias("k"), F.lit("41").alias("h")), F.struct(F.lit(-2).alias("k"), F.lit("00" * 510 + "55AA").alias("h")))
    rows = _numbers(spark, sf_dir).select("image_id", "n", F.inline(labels))
    return rows.select("image_id", "k", P.sector_label(F.unhex(x(F.col("h"), rep("42", N))), F.when(F.col("k") == -2, 0).otherwise(N)).alias("label"))


def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octal text, numbers of seven-bit bytes and checksums over all inodes."""
    i = table(spark, sf_dir, "inodes", "image_id", "ino", "size").distinct().where("ino IS NOT NULL AND ino >= 0")
    seven = F.shiftleft(F.shiftright("ino", 7).bitwiseAND(F.lit(127)), 8) + F.col("ino").bitwiseAND(F.lit(127))
    return i.select("image_id", "ino", "size", formats.octal(F.concat(F.lit(" "), F.conv(F.col("ino").cast("string"), 10, 8))).alias("octal"), formats.syncsafe(seven).alias("syncsafe"))


PIECE = 64


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an image: its text in chunks of 48 bytes, every seventh of which can't be read."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").where("doc_id IS NOT NULL AND length(text) > 0").groupBy("doc_id").agg(F.min("text").alias("text"))
    return d.select(F.col("doc_id").alias("image_id"), F.encode("text", "UTF-8").alias("body"))


def extract_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file from every text: bytes from an offset on, zeros where chunks are missing; as a digest."""
    body = _texts(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("body") - 1) / 48)))
    chunks = body.select("image_id", k.alias("k"), "body").where("k % 7 <> 3").select("image_id", (F.col("k") * 48).alias("base_offset"), F.substring("body", (F.col("k") * 48 + 1).cast("int"), F.lit(48)).alias("content"))
    hits = body.select("image_id", (F.col("image_id") % 50).alias("byte_offset"), (F.col("image_id") % 300 + 1).alias("size"))
    return extract.extract_to_vec(hits, chunks, PIECE).select("image_id", "byte_offset", "size", F.sha2("content", 256).alias("sha256"), "n_zero")


def sink_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecar lines of all documents."""
    return sinks.sha256_lines(_texts(spark, sf_dir).select(F.concat(F.lit("doc_"), F.col("image_id"), F.lit(".txt")).alias("file_name"), F.col("body").alias("content")))


def name_recovered_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all listed files, numbered where they repeat."""
    files = table(spark, sf_dir, "dirents", "dirent_id", "name").where("dirent_id IS NOT NULL AND name IS NOT NULL").groupBy("dirent_id").agg(F.min("name").alias("file_name"))
    return sinks.unique_names(files.select(F.col("dirent_id").alias("file_id"), "file_name"))


def carve_high_density_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose hits are so many that a scan should warn (of the listed blocks, from a hundred on)."""
    b = table(spark, sf_dir, "text_blocks", "image_id", "block_id").where("image_id IS NOT NULL").distinct()
    return b.groupBy("image_id").agg(F.count("*").alias("n_hits")).withColumn("dense", F.col("n_hits") >= 100)


def src_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the two stored shapes, one row per file and offset: first place and signature, last status."""
    v = drift.path_values(table(spark, sf_dir, "checkpoint_lines", "file_id", "line_no", "line"))
    pick = lambda names, value="raw": F.max(F.when(F.col("path").isin(*names), F.col(value)))
    at = F.max(F.when(F.col("path").isin("offset", "hit.byte_offset") & (F.col("type") == "integer"), F.col("value").try_cast("long")))
    lines = v.groupBy("file_id", "line_no").agg(at.alias("byte_offset"), pick(["sig", "hit.signature.name"]).alias("signature"), pick(["status"]).alias("status"))
    status = F.coalesce(F.nullif(F.regexp_extract("status", r'^\{"(\w+)"', 1), F.lit("")), F.col("status"))
    known = lines.where("byte_offset IS NOT NULL AND signature IS NOT NULL").withColumn("status", status)
    return known.groupBy("file_id", "byte_offset").agg(F.min("line_no").alias("first_line"), F.min_by("signature", "line_no").alias("signature"), F.max(F.when(F.col("status").isNotNull(), F.struct("line_no", "status")))["status"].alias("status"))


def cfg_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signature of the table with those the engine knows: by extension, and by extension and header."""
    known = spark.createDataFrame([(s.extension, ",".join("" if b is None else str(b) for b in s.header)) for s in SIGNATURES], "extension string, known_header string")
    given = table(spark, sf_dir, "signatures", "name", "extension", "header", "header_offset", "max_size")
    shown = F.array_join(F.transform("header", lambda b: F.coalesce(b.cast("string"), F.lit(""))), ",")
    both = given.withColumn("shown", shown).join(known, "extension", "left")
    return both.groupBy("name", "extension", "header_offset", "max_size").agg(F.count("known_header").alias("n_known"), F.count(F.when(F.col("shown") == F.col("known_header"), 1)).alias("n_same_header"))


_QUERIES = [carve_sizes, carve_quality, part_gpt, part_fallback, sector_type, number_formats, extract_bytes, sink_sha256, name_recovered_rename, carve_high_density_flag, src_checkpoint, cfg_signatures]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    literal = lambda t: "'" + t.replace("'", "''") + "'"
    body = "d AS (SELECT doc_id AS image_id, hex(encode(min(text))) AS h FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0 GROUP BY 1)"
    known = ", ".join(f"({literal(s.extension)}, {literal(','.join('' if b is None else str(b) for b in s.header))})" for s in SIGNATURES)
    labels = " ".join(f"WHEN {k} THEN {literal(label)}" for k, (_, label) in enumerate(P.SECTOR_LABELS))
    return {
        "carve_sizes": f"WITH {_SQL_N} " + " UNION ALL ".join(f"SELECT image_id, {literal(rule)} AS rule, CAST({size} AS BIGINT) AS size FROM n" for rule, size in SIZES.items()),
        "carve_quality": f"""WITH {_SQL_N}, e AS (SELECT unnest([{', '.join(literal(e) for e in JUDGED)}]) AS extension)
            SELECT image_id, extension, CASE WHEN n % 5 = 0 THEN 'Truncated' WHEN extension = 'xyz' THEN 'Unknown' WHEN n % 2 = 1 THEN 'Complete' ELSE 'Corrupt' END AS state FROM n, e""",
        "part_gpt": f"""WITH {_SQL_N} SELECT image_id, 0 AS slot, CAST(2048 AS BIGINT) AS start_lba, n * 100 + 2048 AS end_lba, 'data' AS name, n % 2 = 0 AS from_backup FROM n
            UNION ALL SELECT image_id, 2, n * 100 + 4096, n * 100 + 4100, 'tail', n % 2 = 0 FROM n""",
        "part_fallback": f"""WITH {_SQL_N} SELECT image_id, 0 AS slot, CAST(2048 AS BIGINT) AS start_lba, n AS size_lba, 'MBR' AS source FROM n WHERE image_id % 3 = 0
            UNION ALL SELECT image_id, 0, 2048, n * 100 + 1, 'GPT' FROM n WHERE image_id % 3 = 1 UNION ALL SELECT image_id, 2, n * 100 + 4096, 5, 'GPT' FROM n WHERE image_id % 3 = 1
            UNION ALL SELECT image_id, 0, 2048 + n, NULL, 'scan' FROM n WHERE image_id % 3 = 2""",
        "sector_type": f"""WITH {_SQL_N}, k AS (SELECT unnest(range(-2, {len(P.SECTOR_LABELS)})) AS k)
            SELECT image_id, CAST(k AS INT) AS k, CASE k WHEN -2 THEN 'MBR' WHEN -1 THEN 'data' {labels} END AS label FROM n, k""",
        "number_formats": "SELECT DISTINCT image_id, ino, size, ino AS octal, ino % 16384 AS syncsafe FROM inodes WHERE ino >= 0",
        "extract_bytes": f"""WITH {body}, hit AS (SELECT image_id, h, image_id % 50 AS o, image_id % 300 + 1 AS size FROM d),
            b AS (SELECT *, unnest(range(o, o + size)) AS i FROM hit), v AS (SELECT *, CASE WHEN i * 2 >= length(h) OR (i // 48) % 7 = 3 THEN '00' ELSE substr(h, i * 2 + 1, 2) END AS c, (i * 2 >= length(h) OR (i // 48) % 7 = 3) AS miss FROM b)
            SELECT image_id, o AS byte_offset, size, sha256(unhex(string_agg(c, '' ORDER BY i))) AS sha256, CAST(sum(CASE WHEN miss THEN 1 ELSE 0 END) AS BIGINT) AS n_zero FROM v GROUP BY 1, 2, 3""",
        "sink_sha256": f"WITH {body} SELECT sha256(unhex(h)) || '  doc_' || image_id || '.txt' AS line FROM d",
        "name_recovered_rename": """WITH f AS (SELECT dirent_id AS file_id, min(name) AS name FROM dirents WHERE dirent_id IS NOT NULL AND name IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_id) AS k FROM f)
            SELECT file_id, CASE WHEN k = 1 THEN name WHEN contains(name, '.') THEN regexp_replace(name, '(.*)\\.([^.]*)$', '\\1', 's') || '[' || k || '].' || regexp_replace(name, '(.*)\\.([^.]*)$', '\\2', 's') ELSE name || '[' || k || ']' END AS file_name FROM r""",
        "carve_high_density_flag": "SELECT image_id, count(*) AS n_hits, count(*) >= 100 AS dense FROM (SELECT DISTINCT image_id, block_id FROM text_blocks WHERE image_id IS NOT NULL) GROUP BY 1",
        "src_checkpoint": """WITH l AS (SELECT DISTINCT file_id, line_no, line FROM checkpoint_lines WHERE file_id IS NOT NULL AND line_no IS NOT NULL AND json_valid(line)), p AS (
              SELECT file_id, line_no, greatest(CASE WHEN json_type(line, '$.offset') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(line, '$.offset') AS BIGINT) END, CASE WHEN json_type(line, '$.hit.byte_offset') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(line, '$.hit.byte_offset') AS BIGINT) END) AS o,
                greatest(json_extract_string(line, '$.sig'), json_extract_string(line, '$.hit.signature.name')) AS sig, CASE WHEN json_type(line, '$.status') = 'OBJECT' THEN json_keys(line, '$.status')[1] ELSE json_extract_string(line, '$.status') END AS status
              FROM l WHERE json_type(line) = 'OBJECT')
            SELECT file_id, o AS byte_offset, min(line_no) AS first_line, arg_min(sig, line_no) AS signature, arg_max(status, line_no) FILTER (WHERE status IS NOT NULL) AS status FROM p WHERE o IS NOT NULL AND sig IS NOT NULL GROUP BY 1, 2""",
        "cfg_signatures": f"""WITH k(extension, h) AS (VALUES {known}) SELECT s.name, s.extension, s.header_offset, s.max_size, count(k.h) AS n_known, count(CASE WHEN k.h = array_to_string(list_transform(s.header, lambda b: coalesce(CAST(b AS VARCHAR), '')), ',') THEN 1 END) AS n_same_header
            FROM signatures s LEFT JOIN k ON k.extension = s.extension GROUP BY 1, 2, 3, 4""",
    }
