"""Artifact scanners over document texts and block previews."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.operators import artifacts as A
from siltbed.sources.tables import table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"), F.col("text").alias("body"))
    blocks = table(spark, sf_dir, "text_blocks", "block_id", "preview").select(F.lit("text_blocks").alias("tbl"), F.col("block_id").alias("row_id"), F.col("preview").alias("body"))
    return docs.unionByName(blocks)


def artifact(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.scan(_texts(spark, sf_dir), "body", [kind], "tbl", "row_id")


def artifact_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of hits per table, kind and confidence."""
    hits = A.scan(_texts(spark, sf_dir), "body", None, "tbl", "row_id")
    return hits.groupBy("tbl", "kind", "confidence").agg(F.count("*").alias("n_hits"), F.sum("byte_offset").alias("sum_offset"))


def artifact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = A.scan(_texts(spark, sf_dir), "body", None, "tbl", "row_id")
    return A.deduplicate(hits, "tbl", "row_id", "byte_offset")


def filter_artifact_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifact_dedup(spark, sf_dir).where(F.col("kind") == "IBAN").select("value", "confidence")


def sink_artifact_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.csv_lines(artifact_dedup(spark, sf_dir))


def queries() -> dict:
    out = {f"artifact_{k}": partial(artifact, v) for k, v in _KINDS.items()}
    return out | {f.__name__: f for f in (artifact_union, artifact_dedup, filter_artifact_kind, sink_artifact_csv)}


_KINDS = {"email": "Email", "url": "URL", "credit_card": "Credit Card", "iban": "IBAN", "windows_path": "Windows Path", "ssn": "SSN"}
_TEXTS = """texts AS (SELECT 'documents' AS tbl, doc_id AS row_id, text AS body FROM documents
  UNION ALL SELECT 'text_blocks', block_id, preview FROM text_blocks)"""


def _hits(kind: str) -> str:
    """All raw matches of a kind with byte offsets."""
    pattern = A.PATTERNS[kind].replace("(?<![0-9A-Za-z_])", r"\b").replace("(?![0-9A-Za-z_])", r"\b").replace("'", "''")
    return f"""SELECT tbl, row_id, body, m[i] AS v,
      CAST(list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: strlen(x))), 0) AS BIGINT) AS pos
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT tbl, row_id, body, regexp_extract_all(body, '{pattern}') AS m, regexp_split_to_array(body, '{pattern}') AS g
        FROM texts WHERE regexp_matches(body, '{pattern}')))"""


def _checked(kind: str) -> str:
    raw = f"({_hits(kind)})"
    if kind == "Email":
        names = ", ".join(f"'{d}'" for d in A.PLACEHOLDER_DOMAINS)
        return f"SELECT tbl, row_id, '{kind}' AS kind, pos AS byte_offset, v AS value, CASE WHEN split_part(v, '@', -1) IN ({names}) THEN 'Low' ELSE 'High' END AS confidence FROM {raw}"
    if kind == "URL":
        return f"SELECT * FROM (SELECT tbl, row_id, '{kind}' AS kind, pos AS byte_offset, regexp_replace(v, '[.,);]+$', '') AS value, 'High' AS confidence FROM {raw}) WHERE strlen(value) >= 11"
    if kind == "Credit Card":
        luhn = "list_sum(list_transform(range(1, len(v) + 1), lambda k: CASE WHEN k % 2 = 0 THEN (CASE WHEN CAST(substr(reverse(v), k, 1) AS INT) * 2 > 9 THEN CAST(substr(reverse(v), k, 1) AS INT) * 2 - 9 ELSE CAST(substr(reverse(v), k, 1) AS INT) * 2 END) ELSE CAST(substr(reverse(v), k, 1) AS INT) END)) % 10 = 0"
        window = "regexp_extract_all(substr(hex(encode(body)), 2 * greatest(pos - 32, 0) + 1, 2 * (least(pos + strlen(v) + 32, strlen(body)) - greatest(pos - 32, 0))), '..')"
        return f"""SELECT tbl, row_id, '{kind}' AS kind, pos AS byte_offset, '****-****-****-' || right(v, 4) AS value,
          CASE WHEN len(list_filter({window}, lambda x: x >= '20' AND x <= '7E')) * 2 >= len({window}) THEN 'High' ELSE 'Low' END AS confidence FROM {raw} WHERE {luhn}"""
    if kind == "IBAN":
        digits = "list_transform(string_split(substr(v, 5) || substr(v, 1, 4), ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE CAST(c AS INT) END)"
        return f"""SELECT tbl, row_id, '{kind}' AS kind, pos AS byte_offset, v AS value, 'High' AS confidence FROM {raw}
          WHERE len(v) BETWEEN 15 AND 34 AND CAST(array_to_string({digits}, '') AS HUGEINT) % 97 = 1"""
    if kind == "Windows Path":
        return f"SELECT * FROM (SELECT tbl, row_id, '{kind}' AS kind, pos AS byte_offset, regexp_replace(v, '\\s+$', '') AS value, 'High' AS confidence FROM {raw}) WHERE strlen(value) >= 6"
    return f"""SELECT tbl, row_id, '{kind}' AS kind, pos AS byte_offset, v AS value, 'High' AS confidence FROM {raw}
      WHERE substr(v, 1, 3) NOT IN ('000', '666') AND substr(v, 5, 2) <> '00' AND substr(v, 8, 4) <> '0000'"""


def oracle_sql() -> dict:
    every = " UNION ALL ".join(f"({_checked(k)})" for k in _KINDS.values())
    first = f"SELECT * FROM ({every}) QUALIFY row_number() OVER (PARTITION BY kind, value ORDER BY tbl, row_id, byte_offset) = 1"
    out = {f"artifact_{k}": f"WITH {_TEXTS} {_checked(v)}" for k, v in _KINDS.items()}
    return out | {
        "artifact_union": f"WITH {_TEXTS} SELECT tbl, kind, confidence, count(*) AS n_hits, CAST(sum(byte_offset) AS BIGINT) AS sum_offset FROM ({every}) GROUP BY ALL",
        "artifact_dedup": f"WITH {_TEXTS} {first}",
        "filter_artifact_kind": f"WITH {_TEXTS} SELECT value, confidence FROM ({first}) WHERE kind = 'IBAN'",
        "sink_artifact_csv": f"""WITH {_TEXTS} SELECT byte_offset || ',' || kind || ',' || confidence || ',"' || replace(value, '"', '""') || '"' AS line FROM ({first})""",
    }
