"""Carving, partition tables, file systems, health and small functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import formats
from siltbed.operators import health as H
from siltbed.operators import partitions as P
from siltbed.operators.carving import scan as C
from siltbed.operators.carving.signatures import SIGNATURES
from siltbed.sources.tables import table

TEXT_FORMATS = ["XML Document", "HTML Document", "PHP Script", "Shell / Script File (Shebang)"]


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews with their line breaks, each a little device of its own."""
    blocks = table(spark, sf_dir, "text_blocks", "block_id", "preview").where("preview IS NOT NULL").distinct()
    body = F.encode(F.replace("preview", F.lit("↵"), F.lit("\n")), "UTF-8")
    return blocks.select(F.col("block_id").alias("image_id"), F.lit(0).cast("long").alias("base_offset"), body.alias("content"), F.octet_length(body).alias("report"))


def carve_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all signatures in the previews, after minimum gaps."""
    return C.suppress(C.scan(_chunks(spark, sf_dir))).select("image_id", "byte_offset", "signature", "extension")


def carve_find_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the text formats, before gaps."""
    return C.scan(_chunks(spark, sf_dir), [s for s in SIGNATURES if s.name in TEXT_FORMATS]).select("image_id", "byte_offset", "signature")


def _mbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first sector per device, made from its number and size: two partitions and, for even numbers, a third."""
    d = table(spark, sf_dir, "devices", "image_id", "size_bytes").where("image_id IS NOT NULL").groupBy("image_id").agg(F.max("size_bytes").alias("size_bytes"))
    n = F.coalesce(F.col("size_bytes") / 4096, F.lit(0)).cast("long") % 1_000_000 + 1
    le4 = lambda x: F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)])
    entry = lambda flag, kind, start, size: F.concat(F.lit(flag + "000000" + kind + "000000"), le4(start), le4(size))
    third = F.when(F.col("image_id") % 2 == 0, entry("00", "0C", n + 900_000, n * 2)).otherwise(F.lit("0" * 32))
    hexed = F.concat(F.lit("00" * 446), entry("80", "07", F.lit(2048).cast("long"), n), entry("00", "83", n + 4096, n + 7), third, F.lit("0" * 32), F.lit("55AA"))
    return d.select("image_id", F.unhex(hexed).alias("content"))


def part_mbr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mbr_entries(_mbr(spark, sf_dir))


def part_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and size in bytes of the partitions, by the sector size of the device."""
    d = table(spark, sf_dir, "devices", "image_id", "logical_sector").groupBy("image_id").agg(F.max("logical_sector").alias("sector"))
    return part_mbr(spark, sf_dir).join(d, "image_id").select("image_id", "slot", (F.col("start_lba") * F.col("sector")).alias("start_byte"), (F.col("size_lba") * F.col("sector")).alias("n_bytes"))


def fs_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File system by boot area, over areas made from the devices' numbers."""
    d = table(spark, sf_dir, "devices", "image_id").where("image_id IS NOT NULL").distinct()
    word = F.element_at(F.array(*[F.lit(x) for x in ("4E54465320202020", "4558464154202020", "2D4656452D46532D", "0000000000000000")]), (F.col("image_id") % 4 + 1).cast("int"))
    area = F.unhex(F.concat(F.lit("EB5290"), word, F.lit("00" * 1069), F.when(F.col("image_id") % 8 == 3, F.lit("53EF")).otherwise(F.lit("0000"))))
    return d.select("image_id", P.fs_type(area).alias("fs_type"))


def byte_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").where("text IS NOT NULL")
    return docs.select("doc_id", F.inline(F.array(P.byte_classes(F.encode("text", "UTF-8")))))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SMART report per event, with readings made from its value and number."""
    e = table(spark, sf_dir, "events", "event_id", "value").where("event_id IS NOT NULL AND value IS NOT NULL")
    attr = lambda n, raw, failed=F.lit(""): F.struct(F.lit(n).alias("id"), F.lit(f"a{n}").alias("name"), F.lit(100).alias("value"), F.lit(5).alias("thresh"), failed.alias("when_failed"), F.struct(raw.cast("long").alias("value")).alias("raw"))
    k = F.col("event_id")
    body = F.struct(
        (k % 3 * 3600).cast("int").alias("rotation_rate"), F.when(k % 5 != 4, F.struct((k % 11 != 0).alias("passed"))).alias("smart_status"),
        F.struct((F.floor("value") % 70).cast("int").alias("current")).alias("temperature"),
        F.struct(F.array(attr(5, k % 97 % 60 - 40), attr(197, k % 41 - 35), attr(198, k % 29 - 25), attr(3, k % 13 * 2000), attr(9, k, F.when(k % 17 == 0, "past").otherwise(""))).alias("table")).alias("ata_smart_attributes"),
    )
    return e.select("event_id", F.when(k % 50 == 49, F.lit("{broken")).otherwise(F.to_json(body)).alias("report_json"))


def smart_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.verdict(_reports(spark, sf_dir), "report_json", "event_id")


def smart_bad_lbas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id").where("event_id IS NOT NULL")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Error: UNC 8 sectors at LBA = 0x"), F.lower(F.hex(F.col("event_id") * 7919)))).otherwise("Error: ABRT")
    return e.select("event_id", H.bad_lba(text).alias("lba")).where("lba IS NOT NULL")


def thermal_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each device is paused by heat after each event."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value").withColumn("temperature", F.floor("value") % 70)
    return H.thermal_state(e, ["user_id"], "ts", "temperature", "event_id").select("event_id", "paused")


def fmt_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "inodes", "image_id", "ino", "size", "modified").distinct()
    return i.select("image_id", "ino", "size", formats.human_bytes(F.col("size")).alias("shown"), formats.unix_date(F.col("modified")).alias("day"))


def name_for_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dirents", "dirent_id", "name", "xid")
    return d.select("dirent_id", formats.carved_name(F.col("name"), F.lit("bin"), F.coalesce("xid", F.lit(0))).alias("file_name"))


_QUERIES = [carve_scan, carve_find_text, part_mbr, part_bytes, fs_detect, byte_class, smart_verdict, smart_bad_lbas, thermal_guard, fmt_bytes, name_for_hit]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    n = "CAST(trunc(coalesce(size_bytes / 4096.0, 0)) AS BIGINT) % 1000000 + 1"
    mbr = f"""d AS (SELECT image_id, max(size_bytes) AS size_bytes, max(logical_sector) AS sector FROM devices WHERE image_id IS NOT NULL GROUP BY 1), p AS (
        SELECT image_id, sector, 0 AS slot, TRUE AS bootable, CAST(7 AS BIGINT) AS type_id, CAST(2048 AS BIGINT) AS start_lba, {n} AS size_lba FROM d
        UNION ALL SELECT image_id, sector, 1, FALSE, 131, {n} + 4096, {n} + 7 FROM d UNION ALL SELECT image_id, sector, 2, FALSE, 12, {n} + 900000, ({n}) * 2 FROM d WHERE image_id % 2 = 0)"""
    k = "event_id"
    spin = f"CASE WHEN {k} % 3 > 0 THEN {k} % 13 * 2000 ELSE 0 END"
    values = f"""r AS (SELECT event_id, {k} % 50 = 49 AS broken, {k} % 5 <> 4 AND {k} % 11 <> 0 AS passed, CAST(floor(value) AS BIGINT) % 70 AS t, {k} % 97 % 60 - 40 AS a5, {k} % 41 - 35 AS a197, {k} % 29 - 25 AS a198, {spin} AS a3, {k} % 17 = 0 AS failed
        FROM events WHERE event_id IS NOT NULL AND value IS NOT NULL)"""
    bad = ["CASE WHEN NOT passed THEN 'self-test failed' END"] + [f"CASE WHEN {c} >= {hi} THEN '{name}' END" for name, c, _, hi in _limits()]
    warn = [f"CASE WHEN {c} >= {lo} AND {c} < {hi} THEN '{name}' END" for name, c, lo, hi in _limits()] + ["CASE WHEN failed THEN 'attribute failed' END"]
    return {
        "carve_find_text": """WITH b AS (SELECT DISTINCT block_id, replace(preview, '↵', chr(10)) AS s FROM text_blocks WHERE preview IS NOT NULL),
            pos AS (SELECT block_id, s, unnest(range(1, length(s) + 1)) AS i FROM b WHERE contains(s, '<?xml') OR contains(s, '<!DOCTYPE') OR contains(s, '<?php') OR contains(s, '#!')),
            h AS (SELECT *, substr(s, i, 14) AS w, strlen(s) - strlen(substr(s, 1, i - 1)) AS left_, strlen(substr(s, 1, i - 1)) AS at_ FROM pos)
            SELECT block_id AS image_id, at_ AS byte_offset, 'XML Document' AS signature FROM h WHERE starts_with(w, '<?xml') AND (left_ < 13 OR substr(w, 6, 8) = ' version')
            UNION ALL SELECT block_id, at_, 'HTML Document' FROM h WHERE starts_with(w, '<!DOCTYPE') AND (left_ < 14 OR lower(substr(w, 10, 5)) = ' html')
            UNION ALL SELECT block_id, at_, 'PHP Script' FROM h WHERE starts_with(w, '<?php') AND (left_ < 6 OR substr(w, 6, 1) IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)))
            UNION ALL SELECT block_id, at_, 'Shell / Script File (Shebang)' FROM h WHERE starts_with(w, '#!') AND (left_ < 7 OR regexp_matches(substr(w, 3, 5), '^/[bu][ -~]{3}$'))""",
        "part_mbr": f"WITH {mbr} SELECT image_id, slot, bootable, type_id, start_lba, size_lba FROM p",
        "part_bytes": f"WITH {mbr} SELECT image_id, slot, start_lba * sector AS start_byte, size_lba * sector AS n_bytes FROM p",
        "fs_detect": "SELECT image_id, CASE WHEN image_id % 4 = 0 THEN 'NTFS' WHEN image_id % 4 = 1 THEN 'exFAT' WHEN image_id % 4 = 2 THEN 'BitLocker' WHEN image_id % 8 = 3 THEN 'ext4' ELSE 'Unknown' END AS fs_type FROM (SELECT DISTINCT image_id FROM devices WHERE image_id IS NOT NULL)",
        "byte_class": """SELECT doc_id, len(list_filter(h, lambda x: x = '00')) AS zero, len(list_filter(h, lambda x: x = 'FF')) AS ff, len(list_filter(h, lambda x: x >= '20' AND x <= '7E')) AS printable,
            len(list_filter(h, lambda x: x <> '00' AND x <> 'FF' AND NOT (x >= '20' AND x <= '7E'))) AS other FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents WHERE text IS NOT NULL)""",
        "smart_verdict": f"""WITH {values}, x AS (SELECT *, list_filter([{', '.join(bad)}], lambda v: v IS NOT NULL) AS b, list_filter([{', '.join(warn)}], lambda v: v IS NOT NULL) AS w FROM r)
            SELECT event_id, CASE WHEN broken THEN 'Unknown' WHEN len(b) > 0 THEN 'Critical' WHEN len(w) > 0 THEN 'Warning' ELSE 'Healthy' END AS verdict, CASE WHEN broken THEN '' ELSE array_to_string(list_concat(b, w), '; ') END AS reasons FROM x""",
        "smart_bad_lbas": "SELECT event_id, event_id * 7919 AS lba FROM events WHERE event_id % 3 = 0",
        "thermal_guard": """WITH s AS (SELECT event_id, user_id, ts, CASE WHEN CAST(floor(value) AS BIGINT) % 70 >= 55 THEN 1 WHEN CAST(floor(value) AS BIGINT) % 70 <= 50 THEN 0 END AS side FROM events)
            SELECT event_id, coalesce(last_value(side IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS paused FROM s""",
        "fmt_bytes": """SELECT image_id, ino, size, CASE WHEN size >= 1073741824 THEN printf('%.2f GiB', size / 1073741824.0) WHEN size >= 1048576 THEN printf('%.2f MiB', size / 1048576.0) WHEN size >= 1024 THEN printf('%.2f KiB', size / 1024.0) WHEN size IS NOT NULL THEN size || ' B' END AS shown,
            CASE WHEN modified <> 0 THEN strftime(DATE '1970-01-01' + CAST(floor(modified / 86400.0) AS INT), '%Y-%m-%d') END AS day FROM (SELECT DISTINCT image_id, ino, size, modified FROM inodes)""",
        "name_for_hit": """SELECT dirent_id, CASE WHEN length(n) > 0 THEN n ELSE 'file_bin_' || coalesce(xid, 0) || '.bin' END AS file_name FROM (SELECT dirent_id, xid, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(name, '^[/\\\\]+', ''), '[/\\\\]'), lambda x: x <> '..' AND x <> ''),
            lambda x: regexp_replace(x, '[:*?<>|"]', '_', 'g')), '/') AS n FROM dirents)""",
    }


def _limits() -> list[tuple]:
    columns = {"temperature": "t", "reallocated": "a5", "pending": "a197", "uncorrectable": "a198", "spin_up": "a3"}
    return [(name, columns[name], lo, hi) for name, (_, lo, hi) in H.LIMITS.items()]
