"""Sessions, names, groups and small reports over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions import formats
from siltbed.operators import profiles as P
from siltbed.operators import sessions as S
from siltbed.plans.relational_queries import _LISTING, _listing
from siltbed.sources.tables import table


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "checkpoint_lines").distinct().where("line IS NOT NULL")
    raw = F.get_json_object("line", "$.status")
    return lines.where(raw.isNotNull()).select("file_id", "line_no", S.state(raw).alias("state"), S.state_bytes(raw).alias("n_bytes"))


def project_hit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("file_id", "line_no", "state", F.coalesce("n_bytes", F.lit(-1)).alias("n_bytes"))


def session_restore_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.restore_stats(_states(spark, sf_dir), ["file_id"])


def checkpoint_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select(S.requeued(F.col("state")).alias("state")).groupBy("state").agg(F.count("*").alias("n_hits"))


def extract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))


def _drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "devices", "image_id", "serial", "size_bytes", "model").distinct()


def session_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _drives(spark, sf_dir)
    sessions = d.select((F.col("image_id") + 50_000).alias("session_id"), "serial", F.when(F.col("image_id") % 3 > 0, F.col("size_bytes") + F.when(F.col("image_id") % 3 == 2, 1).otherwise(0)).alias("size")).distinct()
    return S.session_match(sessions, d.select(F.col("image_id").alias("drive_id"), "serial", F.col("size_bytes").alias("size")).distinct())


def drive_identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drives whose rows don't all agree on serial, model and size."""
    a, b = _drives(spark, sf_dir).alias("a"), _drives(spark, sf_dir).alias("b")
    same = S.same_drive(F.col("a.serial"), F.col("a.model"), F.col("a.size_bytes"), F.col("b.serial"), F.col("b.model"), F.col("b.size_bytes"))
    return a.join(b, "image_id").groupBy("image_id").agg(F.min(same).alias("same"))


def image_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drives(spark, sf_dir).select("image_id", formats.image_name(F.col("serial"), F.lit("2024-05-06").cast("date")).alias("file_name")).distinct()


def carve_group_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "signatures", "name", "extension").select("name", formats.format_group(F.col("extension")).alias("label"))


def carve_parse_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the signature table as text, ``??`` for any byte."""
    s = table(spark, sf_dir, "signatures", "name", "header")
    text = F.array_join(F.transform("header", lambda b: F.when(b.isNull(), "??").otherwise(F.lpad(F.hex(b.cast("long")), 2, "0"))), " ")
    return s.select("name", text.alias("header_text"), F.size(F.filter("header", lambda b: b.isNotNull())).alias("n_fixed"))


def sig_disabled_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "signatures", "name", "extension")
    return S.without_disabled(s, s.where("extension IN ('zip', 'pdf')"))


def agg_unrecognised_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _listing(spark, sf_dir).where("NOT is_dir AND name IS NOT NULL")
    other = files.where(P.category(F.col("name")) == "Other")
    return other.groupBy(P.extension(F.col("name")).alias("ext")).agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "ext").limit(20)


def sort_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile(_listing(spark, sf_dir)).select("category", "total_count").orderBy(F.desc("total_count"), "category")


def compare_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered share of the source files of each extension, in percent with one decimal."""
    files = _listing(spark, sf_dir).where("NOT is_dir AND name IS NOT NULL")
    got = files.where("image_id = 17").select(F.lower("name").alias("key")).distinct().withColumn("hit", F.lit(1))
    source = files.where("image_id <> 17").select(F.lower("name").alias("key"), P.extension(F.col("name")).alias("ext"))
    return source.join(got, "key", "left").groupBy("ext").agg(F.count("*").alias("n_source"), (F.round(F.sum(F.coalesce("hit", F.lit(0))) * 100 / F.count("*"), 1)).alias("pct"))


def map_range_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _drives(spark, sf_dir).groupBy(F.col("image_id").alias("device")).agg(F.max("size_bytes").alias("size"))
    return S.range_mask(d, 1_000_000_000_000, 1_500_000_000_000)


def agg_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "devices", "image_id", "model").where("image_id IS NOT NULL").groupBy(F.col("image_id").alias("device")).agg(F.max("model").alias("model"))
    hits = table(spark, sf_dir, "text_blocks", "image_id").where("image_id IS NOT NULL").groupBy(F.col("image_id").alias("device")).agg(F.count("*").alias("n_hits"))
    verdicts = d.select("device", F.when(F.col("device") % 2 == 0, "Healthy").otherwise("Warning").alias("verdict"))
    maps = hits.select("device", (F.col("n_hits") % 100 / 100).alias("done"))
    return S.report(d, verdicts, maps, hits)


_QUERIES = [
    project_hit_status, session_restore_stats, checkpoint_requeue, extract_summary, session_match, drive_identity_check, image_name, carve_group_label, carve_parse_hex, sig_disabled_antijoin,
    agg_unrecognised_ext, sort_profile, compare_rates, map_range_mask, agg_report,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    states = """s AS (SELECT file_id, line_no, CASE WHEN regexp_extract(st, '^\\s*\\{?\\s*"?([A-Za-z]+)', 1) <> '' THEN regexp_extract(st, '^\\s*\\{?\\s*"?([A-Za-z]+)', 1) ELSE 'Unextracted' END AS state, TRY_CAST(regexp_extract(st, '"bytes"\\s*:\\s*(\\d+)', 1) AS BIGINT) AS n_bytes
        FROM (SELECT file_id, line_no, json_extract_string(line, '$.status') AS st FROM (SELECT DISTINCT * FROM checkpoint_lines WHERE line IS NOT NULL AND json_valid(line))) WHERE st IS NOT NULL)"""
    groups = "CASE " + " ".join(f"WHEN lower(extension) IN ({', '.join(repr(w) for w in words.split())}) THEN '{g}'" for g, words in formats.GROUPS.items()) + " ELSE 'System' END"
    category = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(w) for w in words.split())}) THEN '{c}'" for c, words in P.CATEGORIES.items()) + " ELSE 'Other' END"
    count = lambda *x: f"CAST(sum(CASE WHEN state IN ({', '.join(repr(v) for v in x)}) THEN 1 ELSE 0 END) AS BIGINT)"
    return {
        "session_match": """WITH d AS (SELECT DISTINCT image_id, serial, size_bytes FROM devices), s AS (SELECT DISTINCT image_id + 50000 AS session_id, serial, CASE WHEN image_id % 3 > 0 THEN size_bytes + CASE WHEN image_id % 3 = 2 THEN 1 ELSE 0 END END AS size FROM d)
            SELECT session_id, d.image_id AS drive_id FROM s JOIN d ON s.serial = d.serial AND s.serial <> '' AND (coalesce(s.size, 0) = 0 OR s.size = d.size_bytes)""",
        "drive_identity_check": """WITH d AS (SELECT DISTINCT image_id, serial, size_bytes, model FROM devices) SELECT a.image_id, bool_and(a.serial IS NOT DISTINCT FROM b.serial AND a.model IS NOT DISTINCT FROM b.model AND a.size_bytes IS NOT DISTINCT FROM b.size_bytes) AS same
            FROM d a JOIN d b ON a.image_id = b.image_id GROUP BY 1""",
        "image_name": "SELECT DISTINCT image_id, CASE WHEN regexp_replace(coalesce(serial, ''), '[^0-9A-Za-z]', '', 'g') <> '' THEN regexp_replace(coalesce(serial, ''), '[^0-9A-Za-z]', '', 'g') ELSE 'disk' END || '_20240506.img' AS file_name FROM devices",
        "carve_group_label": f"SELECT name, {groups} AS label FROM signatures",
        "carve_parse_hex": "SELECT name, array_to_string(list_transform(header, lambda b: CASE WHEN b IS NULL THEN '??' ELSE lpad(upper(to_hex(b)), 2, '0') END), ' ') AS header_text, CAST(len(list_filter(header, lambda b: b IS NOT NULL)) AS INT) AS n_fixed FROM signatures",
        "sig_disabled_antijoin": "SELECT name, extension FROM signatures WHERE extension NOT IN ('zip', 'pdf')",
        "agg_unrecognised_ext": f"WITH {_LISTING} SELECT ext, count(*) AS n_files FROM files WHERE {category} = 'Other' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
        "sort_profile": f"WITH {_LISTING} SELECT {category} AS category, count(*) AS total_count FROM files GROUP BY 1",
        "compare_rates": f"WITH {_LISTING}, g AS (SELECT DISTINCT lower(name) AS key FROM files WHERE image_id = 17) SELECT ext, count(*) AS n_source, round(sum(CASE WHEN g.key IS NULL THEN 0 ELSE 1 END) * 100.0 / count(*), 1) AS pct FROM files LEFT JOIN g ON g.key = lower(name) WHERE image_id <> 17 GROUP BY 1",
        "map_range_mask": """WITH d AS (SELECT image_id AS device, max(size_bytes) AS size FROM devices GROUP BY 1) SELECT * FROM (SELECT device, CAST(0 AS BIGINT) AS pos, least(1000000000000, size) AS size, '+' AS status FROM d
            UNION ALL SELECT device, least(1500000000000, size), greatest(size - 1500000000000, 0), '+' FROM d) WHERE size > 0""",
        "agg_report": """WITH d AS (SELECT image_id AS device, max(model) AS model FROM devices WHERE image_id IS NOT NULL GROUP BY 1), h AS (SELECT image_id AS device, count(*) AS n FROM text_blocks WHERE image_id IS NOT NULL GROUP BY 1)
            SELECT d.device, 'Device: ' || d.device || chr(10) || 'Model: ' || coalesce(model, 'unknown') || chr(10) || 'Health: ' || CASE WHEN d.device % 2 = 0 THEN 'Healthy' ELSE 'Warning' END || chr(10) || 'Imaged: ' || printf('%.1f%%', coalesce(n % 100, 0) * 1.0) || chr(10) || 'Hits: ' || coalesce(n, 0) AS report
            FROM d LEFT JOIN h USING (device)""",
        "project_hit_status": f"WITH {states} SELECT file_id, line_no, state, coalesce(n_bytes, -1) AS n_bytes FROM s",
        "session_restore_stats": f"WITH {states} SELECT file_id, {count('Ok', 'Truncated')} AS written, {count('Skipped')} AS skipped, {count('Duplicate')} AS duplicate, {count('Unextracted', 'Queued', 'Extracting')} AS to_do, count(*) AS n_hits FROM s GROUP BY 1",
        "checkpoint_requeue": f"WITH {states} SELECT CASE WHEN state IN ('Queued', 'Extracting') THEN 'Unextracted' ELSE state END AS state, count(*) AS n_hits FROM s GROUP BY 1",
        "extract_summary": f"WITH {states} SELECT state, count(*) AS n_files, CAST(coalesce(sum(n_bytes), 0) AS BIGINT) AS n_bytes FROM s GROUP BY 1",
    }
