"""Text classification, listings, comparisons and intervals over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.operators import intervals as I
from siltbed.operators import profiles as P
from siltbed.operators import textblocks as X
from siltbed.sources.tables import table


def _documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text", *more)


def _previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews with their line breaks put back."""
    return table(spark, sf_dir, "text_blocks", "block_id", "preview").distinct().withColumn("body", F.replace("preview", F.lit("↵"), F.lit("\n")))


def text_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select(F.lit("d").alias("tbl"), F.col("doc_id").alias("row_id"), F.col("text").alias("body"))
    blocks = _previews(spark, sf_dir).select(F.lit("b").alias("tbl"), F.col("block_id").alias("row_id"), "body")
    return docs.unionByName(blocks).withColumn("c", X.classify(F.col("body"))).select("tbl", "row_id", "c.kind", "c.extension", "c.confidence")


def text_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where(X.gates(F.col("text"))).select("doc_id", F.octet_length("text").alias("n_bytes"), X.quality(F.col("text")).alias("quality"))


def text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.deduplicate(_documents(spark, sf_dir).where("text IS NOT NULL"), "text", "doc_id").select("doc_id")


def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", X.preview(F.col("text")).alias("preview"))


def filter_text_kind_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_blocks", "block_id", "kind", "lang", "byte_offset").where("kind = 'Markdown' AND lang = 'eng'").select("block_id", "byte_offset")


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all images: the newest name of each inode with its newest size."""
    d = table(spark, sf_dir, "dirents", "dirent_id", "image_id", "child_ino", "name", "xid").where("child_ino IS NOT NULL AND image_id IS NOT NULL")
    d = d.groupBy("image_id", F.col("child_ino").alias("ino")).agg(F.max(F.struct("xid", "dirent_id", "name")).alias("b"))
    i = table(spark, sf_dir, "inodes", "image_id", "ino", "size", "mode", "modified", "xid").groupBy("image_id", "ino").agg(F.max(F.struct("xid", "size", "mode", "modified")).alias("i"))
    return d.join(i, ["image_id", "ino"], "left").select(
        "image_id", F.col("b.dirent_id").alias("file_id"), F.col("b.name").alias("name"), F.coalesce("i.size", F.lit(0)).alias("size"),
        (F.coalesce("i.mode", F.lit(0)).bitwiseAND(F.lit(61440)) == 16384).alias("is_dir"), F.col("i").isNull().alias("is_deleted"), F.col("i.modified").alias("modified"),
    )


def agg_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile(_listing(spark, sf_dir))


def infer_drive_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.drive_type(P.profile(_listing(spark, sf_dir)))


def agg_extension_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extension_stats(_listing(spark, sf_dir))


def topk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_files(_listing(spark, sf_dir))


def agg_large_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.large_by_extension(_listing(spark, sf_dir), 1_000_000)


def filter_deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(spark, sf_dir).where("is_deleted AND NOT is_dir").select("file_id", "image_id")


def filter_name_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(spark, sf_dir).where(F.lower("name").contains("report")).select("file_id", "name")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files of image 17 as carved, all other images as the source."""
    files = _listing(spark, sf_dir).where("NOT is_dir AND name IS NOT NULL")
    return (
        files.where("image_id = 17").select(F.col("file_id").alias("carved_id"), "name", "size"),
        files.where("image_id <> 17").select(F.col("file_id").alias("source_id"), "name", "size"),
    )


def join_name_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.join_name_size(*_halves(spark, sf_dir)).select("carved_id", "verdict", F.coalesce(F.abs("delta"), F.lit(-1)).alias("delta"))


def not_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.not_recovered(*_halves(spark, sf_dir)).select("source_id", "size")


def join_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "source")
    name = F.concat_ws("/", F.coalesce(F.lower(F.trim("source")), F.lit("none")), F.length("text").cast("string"))
    carved = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("carved_id"), name.alias("name"), F.col("text").alias("content"))
    source = docs.where("doc_id % 2 = 1").select(F.col("doc_id").alias("source_id"), name.alias("name"), F.col("text").alias("content"))
    return P.join_hash(carved, source)


def join_metadata_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "text_blocks", "block_id", "image_id", "byte_offset", "extension")
    index = blocks.where("extension IS NOT NULL AND image_id IS NOT NULL").select("image_id", F.lit(0).alias("part_seq"), F.col("block_id").alias("entry_seq"), F.col("byte_offset").alias("abs_offset"), F.col("extension").alias("name"))
    return P.join_metadata_index(blocks.select(F.col("block_id").alias("hit_id"), "image_id", "byte_offset"), index)


def suppress_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "text_blocks", "block_id", "image_id", "kind", "byte_offset").distinct().where("image_id IS NOT NULL")
    gap = F.when(F.col("kind") == "Json", 0).otherwise(200_000_000).cast("long")
    return I.suppress_gap(hits.withColumn("gap", gap), ["image_id"], "byte_offset", "gap", "block_id").select("block_id")


def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range updates of a device map: one per event, in order of time."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    status = F.create_map(*[F.lit(x) for kv in {"view": "+", "click": "*", "purchase": "/", "error": "-"}.items() for x in kv])
    return e.where("user_id IS NOT NULL AND event_id IS NOT NULL AND value IS NOT NULL").select(
        F.col("user_id").alias("device"), F.col("event_id").alias("seq"), (F.col("event_id") % 97 * 512).alias("pos"),
        (F.greatest(F.floor("value"), F.lit(1)).cast("long") % 64 * 512 + 512).alias("size"), F.coalesce(status[F.col("event_type")], F.lit("?")).alias("status"),
    )


def map_update_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.overlay(_map(spark, sf_dir), ["device"])


def agg_map_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.status_bytes(map_update_range(spark, sf_dir), ["device"])


def agg_unreadable_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.unreadable_sectors(map_update_range(spark, sf_dir), ["device"])


def progress_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.progress(map_update_range(spark, sf_dir), ["device"])


def part_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "text_blocks", "image_id", "byte_offset", "kind").where("image_id IS NOT NULL AND byte_offset IS NOT NULL")
    hits = b.select("image_id", F.floor(F.col("byte_offset") / 512).alias("start_lba"), F.col("kind").alias("fs_type")).distinct()
    return I.reconstruct_partitions(hits.withColumn("disk_lba", F.lit(1 << 32).cast("long")), ["image_id"], "disk_lba")


def rate_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value")
    return I.rolling_rate(e, ["user_id"], "ts", "value", "event_id").select("event_id", (F.round("rate", 6) + F.lit(0.0)).alias("rate"))


def watchdog_stall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.stalls(table(spark, sf_dir, "events", "event_id", "user_id", "ts"), ["user_id"], "ts", "event_id", 3600).select("event_id", F.round("gap_s", 3).alias("gap_s"))


def agg_median_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.upper_median(table(spark, sf_dir, "events", "user_id", "value"), ["user_id"], "value")


def filter_drive_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "devices").distinct()
    q = "vault"
    hit = F.lower("path").contains(q) | F.lower("model").contains(q) | F.lower("serial").contains(q)
    return d.where(hit).select("image_id", "size_bytes")


_QUERIES = [
    text_classify, text_gates, text_dedup, text_preview, filter_text_kind_lang, agg_profile, infer_drive_type, agg_extension_stats, topk_files, agg_large_by_ext, filter_deleted_files,
    filter_name_ci, join_name_size, not_recovered, join_hash, join_metadata_index, suppress_gap, map_update_range, agg_map_status, agg_unreadable_sectors, progress_fraction,
    part_reconstruct, rate_rolling, watchdog_stall, agg_median_baseline, filter_drive_ci,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_LISTING = """d AS (SELECT image_id, child_ino AS ino, dirent_id, name FROM dirents WHERE child_ino IS NOT NULL AND image_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY image_id, child_ino ORDER BY xid DESC NULLS LAST, dirent_id DESC, name DESC NULLS LAST) = 1),
  i AS (SELECT * FROM inodes QUALIFY row_number() OVER (PARTITION BY image_id, ino ORDER BY xid DESC NULLS LAST, size DESC NULLS LAST, mode DESC NULLS LAST, modified DESC NULLS LAST) = 1),
  listing AS (SELECT d.image_id, d.dirent_id AS file_id, d.name, coalesce(i.size, 0) AS size, (coalesce(i.mode, 0) & 61440) = 16384 AS is_dir, i.ino IS NULL AS is_deleted
    FROM d LEFT JOIN i USING (image_id, ino)),
  files AS (SELECT *, lower(split_part(name, '.', -1)) AS ext FROM listing WHERE NOT is_dir AND name IS NOT NULL)"""
_CATEGORY = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(w) for w in words.split())}) THEN '{c}'" for c, words in P.CATEGORIES.items()) + " ELSE 'Other' END"
_PROFILE = f"""profiled AS (SELECT {_CATEGORY} AS category, CAST(sum(CASE WHEN is_deleted THEN 0 ELSE 1 END) AS BIGINT) AS active_count, CAST(sum(CASE WHEN is_deleted THEN 1 ELSE 0 END) AS BIGINT) AS deleted_count,
  CAST(sum(CASE WHEN is_deleted THEN 0 ELSE size END) AS BIGINT) AS active_bytes, CAST(sum(CASE WHEN is_deleted THEN size ELSE 0 END) AS BIGINT) AS deleted_bytes, count(*) AS total_count FROM files GROUP BY 1)"""
_HEAD = "left(body, 1024)"


def _classify_sql() -> str:
    # exact for contents below 1024 bytes and for longer ones whose head is ASCII; the rest is cut by bytes
    hits = lambda words, both: " + ".join(f"CAST(contains(h, '{w}')" + (f" OR contains(h, '{w.lower()}')" if both else "") + " AS INT)" for w in words)
    cond = [
        (r"regexp_matches(h, '^<\?php[ \t\r\n]')", "Php", "'php'", 99), ("starts_with(h, '#!/')", "Script", "CASE WHEN contains(f, 'python') THEN 'py' WHEN contains(f, 'ruby') THEN 'rb' WHEN contains(f, 'perl') THEN 'pl' WHEN contains(f, 'node') THEN 'js' ELSE 'sh' END", 97),
        ("starts_with(h, '<?xml')", "Markup", "'xml'", 99), ("starts_with(upper(h), '<!DOCTYPE') OR starts_with(upper(h), '<HTML')", "Markup", "'html'", 95),
        ("(starts_with(h, '{') OR starts_with(h, '[')) AND (len(h) - len(replace(h, '\":', ''))) / 2 >= 2", "Json", "'json'", 85), ("starts_with(h, '---' || chr(10)) OR starts_with(h, '---' || chr(13) || chr(10))", "Yaml", "'yaml'", 90),
        (hits(X.SQL_WORDS, True) + " >= 3", "Sql", "'sql'", 70), (hits(X.C_WORDS, False) + " >= 3", "CSource", "'c'", 65), (hits(X.MARKDOWN_SIGNS, False) + " >= 2", "Markdown", "'md'", 65),
    ]
    case = lambda k: "CASE WHEN h IS NULL THEN NULL " + " ".join(f"WHEN {c[0]} THEN {k(c)}" for c in cond)
    return f"""WITH rows_ AS (SELECT 'd' AS tbl, doc_id AS row_id, text AS body FROM documents UNION ALL SELECT 'b', block_id, replace(preview, '↵', chr(10)) FROM (SELECT DISTINCT block_id, preview FROM text_blocks)),
      heads AS (SELECT tbl, row_id, CASE WHEN body IS NULL THEN NULL WHEN strlen(body) <= 1024 THEN body
        ELSE (SELECT string_agg(c, '' ORDER BY k) FROM (SELECT k, body[k] AS c, sum(strlen(body[k])) OVER (ORDER BY k) AS n FROM (SELECT unnest(range(1, 1025)) AS k)) WHERE n <= 1024) END AS h FROM rows_),
      firsts AS (SELECT *, split_part(h, chr(10), 1) AS f FROM heads)
      SELECT tbl, row_id, {case(lambda c: "'" + c[1] + "'")} ELSE 'Generic' END AS kind, {case(lambda c: c[2])} ELSE 'txt' END AS extension, {case(lambda c: str(c[3]))} ELSE 50 END AS confidence FROM firsts"""


def oracle_sql() -> dict:
    mapped = """u AS (SELECT user_id AS device, event_id AS seq, event_id % 97 * 512 AS pos, CAST(greatest(floor(value), 1) AS BIGINT) % 64 * 512 + 512 AS size,
        CASE event_type WHEN 'view' THEN '+' WHEN 'click' THEN '*' WHEN 'purchase' THEN '/' WHEN 'error' THEN '-' ELSE '?' END AS status FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND value IS NOT NULL),
      edges AS (SELECT DISTINCT device, unnest([pos, pos + size]) AS lo FROM u),
      pieces AS (SELECT * FROM (SELECT device, lo, lead(lo) OVER (PARTITION BY device ORDER BY lo) AS hi FROM edges) WHERE hi IS NOT NULL),
      flat AS (SELECT p.device, lo AS pos, hi - lo AS size, arg_max(status, seq) AS status FROM pieces p JOIN u ON u.device = p.device AND lo >= u.pos AND lo < u.pos + u.size GROUP BY p.device, lo, hi),
      marked AS (SELECT *, CASE WHEN lag(status) OVER w = status AND lag(pos + size) OVER w = pos THEN 0 ELSE 1 END AS f FROM flat WINDOW w AS (PARTITION BY device ORDER BY pos)),
      runs AS (SELECT *, sum(f) OVER (PARTITION BY device ORDER BY pos) AS i FROM marked),
      blocks AS (SELECT device, min(pos) AS pos, CAST(sum(size) AS BIGINT) AS size, first(status) AS status FROM runs GROUP BY device, i)"""
    halves = f"WITH {_LISTING}, c AS (SELECT file_id AS carved_id, lower(name) AS key, size FROM files WHERE image_id = 17), s AS (SELECT file_id AS source_id, lower(name) AS key, size FROM files WHERE image_id <> 17)"
    return {
        "text_classify": _classify_sql(),
        "text_gates": "SELECT * FROM (SELECT doc_id, strlen(text) AS n_bytes, CAST(floor(len(list_filter(regexp_extract_all(hex(encode(text)), '..'), lambda x: x IN ('09', '0A', '0D') OR (x >= '20' AND x <= '7E'))) * 100 / greatest(strlen(text), 1)) AS BIGINT) AS quality FROM documents) WHERE n_bytes >= 256 AND quality >= 80",
        "text_dedup": "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text",
        "text_preview": "SELECT doc_id, replace(replace(left(text, 80), chr(13), '↵'), chr(10), '↵') AS preview FROM documents",
        "filter_text_kind_lang": "SELECT block_id, byte_offset FROM text_blocks WHERE kind = 'Markdown' AND lang = 'eng'",
        "agg_profile": f"WITH {_LISTING}, {_PROFILE} SELECT * FROM profiled",
        "infer_drive_type": f"""WITH {_LISTING}, {_PROFILE}, t AS (SELECT coalesce(sum(total_count), 0) AS n, coalesce(sum(total_count) FILTER (category IN ('Images', 'RAW Photos')), 0) * 100 / sum(total_count) AS im, coalesce(sum(total_count) FILTER (category = 'Videos'), 0) * 100 / sum(total_count) AS vi,
            coalesce(sum(total_count) FILTER (category = 'Audio'), 0) * 100 / sum(total_count) AS au, coalesce(sum(total_count) FILTER (category = 'System'), 0) * 100 / sum(total_count) AS sy, coalesce(sum(total_count) FILTER (category = 'Documents'), 0) * 100 / sum(total_count) AS doc FROM profiled)
            SELECT CASE WHEN n = 0 THEN 'Empty' WHEN im > 50 THEN 'Photo' WHEN vi > 40 THEN 'Video' WHEN au > 40 THEN 'Audio' WHEN sy > 40 THEN 'System' WHEN doc > 40 THEN 'Documents' WHEN im + vi + au > 50 THEN 'Media' ELSE 'General' END AS drive_type, CAST(n AS BIGINT) AS n_files FROM t""",
        "agg_extension_stats": f"""WITH {_LISTING}, p AS (SELECT ext, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_bytes, CAST(round_even(avg(size), 0) AS BIGINT) AS avg_bytes, max(size) AS max_bytes, min(size) AS min_bytes FROM files GROUP BY 1)
            SELECT *, round(total_bytes * 100.0 / (SELECT sum(total_bytes) FROM p), 1) AS pct, max_bytes > 524288000 AS flagged FROM p""",
        "topk_files": f"WITH {_LISTING} SELECT file_id, name, size FROM files ORDER BY size DESC, name, file_id LIMIT 20",
        "agg_large_by_ext": f"WITH {_LISTING} SELECT ext, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_bytes FROM (SELECT *, lower(split_part(name, '.', -1)) AS ext FROM listing WHERE NOT is_dir) WHERE size > 1000000 GROUP BY 1",
        "filter_deleted_files": f"WITH {_LISTING} SELECT file_id, image_id FROM listing WHERE is_deleted AND NOT is_dir",
        "filter_name_ci": f"WITH {_LISTING} SELECT file_id, name FROM listing WHERE contains(lower(name), 'report')",
        "join_name_size": f"""{halves} SELECT carved_id, CASE WHEN n IS NULL THEN 'unrecognised' WHEN n = 0 THEN 'matched' ELSE 'mismatch' END AS verdict, coalesce(n, -1) AS delta
            FROM c LEFT JOIN (SELECT c.carved_id, min(abs(c.size - s.size)) AS n FROM c JOIN s USING (key) GROUP BY 1) USING (carved_id)""",
        "not_recovered": f"{halves} SELECT source_id, size FROM s ANTI JOIN c USING (key)",
        "join_hash": """WITH f AS (SELECT doc_id, coalesce(lower(trim(source)), 'none') || '/' || length(text) AS key, text FROM documents), s AS (SELECT * FROM f WHERE doc_id % 2 = 1)
            SELECT doc_id AS carved_id, CASE WHEN text IS NULL THEN 'carved_unreadable' WHEN EXISTS (SELECT 1 FROM s WHERE s.key = f.key AND s.text = f.text) THEN 'identical' WHEN text IN (SELECT text FROM s WHERE text IS NOT NULL) THEN 'alt_source'
            WHEN key IN (SELECT key FROM s WHERE key IS NOT NULL) THEN 'damaged' ELSE 'source_missing' END AS verdict FROM f WHERE doc_id % 2 = 0""",
        "join_metadata_index": """WITH ix AS (SELECT image_id, byte_offset, arg_min(extension, block_id) AS name FROM text_blocks WHERE extension IS NOT NULL AND image_id IS NOT NULL GROUP BY 1, 2)
            SELECT b.block_id AS hit_id, b.image_id, b.byte_offset, ix.name FROM text_blocks b LEFT JOIN ix ON ix.image_id = b.image_id AND ix.byte_offset = b.byte_offset""",
        "map_update_range": f"WITH {mapped} SELECT * FROM blocks",
        "agg_map_status": f"WITH {mapped} SELECT device, status, CAST(sum(size) AS BIGINT) AS n_bytes FROM blocks GROUP BY 1, 2",
        "agg_unreadable_sectors": f"WITH {mapped} SELECT device, CAST(sum(CASE WHEN status IN ('*', '/', '-') THEN size ELSE 0 END) // 512 AS BIGINT) AS n_sectors FROM blocks GROUP BY 1",
        "progress_fraction": f"WITH {mapped} SELECT device, sum(CASE WHEN status = '+' THEN size ELSE 0 END) / sum(size) AS done, (sum(size) - sum(CASE WHEN status = '?' THEN size ELSE 0 END)) / sum(size) AS passed FROM blocks GROUP BY 1",
        "part_reconstruct": """WITH h AS (SELECT DISTINCT image_id, byte_offset // 512 AS start_lba, kind AS fs_type FROM text_blocks WHERE image_id IS NOT NULL AND byte_offset IS NOT NULL),
            e AS (SELECT *, coalesce(lead(start_lba) OVER w, 4294967296) - 1 AS end_lba FROM h WINDOW w AS (PARTITION BY image_id ORDER BY start_lba, fs_type))
            SELECT image_id, start_lba, end_lba, greatest(end_lba - start_lba + 1, 1) AS size_lba, 'Recovered ' || fs_type || ' partition' AS name FROM e""",
        "rate_rolling": "SELECT event_id, round(CASE WHEN s > 0 THEN dv / s END, 6) + 0.0 AS rate FROM (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS s, value - lag(value) OVER w AS dv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))",
        "watchdog_stall": "SELECT event_id, round(g, 3) AS gap_s FROM (SELECT event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS g FROM events) WHERE g >= 3600",
        "agg_median_baseline": "SELECT user_id, list_sort(list(value))[len(list(value)) // 2 + 1] AS median, count(*) AS n FROM events WHERE value <> 0 GROUP BY 1",
        "filter_drive_ci": "SELECT image_id, size_bytes FROM (SELECT DISTINCT * FROM devices) WHERE contains(lower(path), 'vault') OR contains(lower(model), 'vault') OR contains(lower(serial), 'vault')",
        "suppress_gap": """WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY byte_offset, block_id) AS r FROM (SELECT DISTINCT block_id, image_id, byte_offset, CASE WHEN kind = 'Json' THEN 0 ELSE 200000000 END AS gap FROM text_blocks WHERE image_id IS NOT NULL)),
            w AS (SELECT image_id, r, block_id, TRUE AS ok, CASE WHEN gap > 0 THEN byte_offset END AS last FROM h WHERE r = 1 UNION ALL
              SELECT h.image_id, h.r, h.block_id, gap = 0 OR last IS NULL OR h.byte_offset >= last + gap, CASE WHEN gap > 0 AND (last IS NULL OR h.byte_offset >= last + gap) THEN h.byte_offset ELSE last END
              FROM w JOIN h ON h.image_id = w.image_id AND h.r = w.r + 1) SELECT block_id FROM w WHERE ok""",
    }
