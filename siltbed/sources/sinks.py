"""Writing results: recovered files, stubs of text blocks, checkpoints, digests, comparison reports.

Files are written by the tasks that hold their rows, into a folder that all executors share; a file is written
under a temporary name and then renamed, so a repeated task leaves one whole file.
"""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltbed.functions.formats import safe_name
from siltbed.operators.carving.signatures import Signature, user_signature

WRITTEN = "file_name string, n_bytes bigint, sha256 string"


def write_files(files: DataFrame, folder: str, stamp: bool = True) -> DataFrame:
    """Writes ``file_name, content`` (and ``modified`` as file time) below ``folder``: one row per file written.

    Names are made safe; rows without content or a usable name are left out.
    """
    columns = [safe_name(F.col("file_name")).alias("file_name"), "content", (F.col("modified") if "modified" in files.columns else F.lit(None).cast("bigint")).cast("bigint").alias("modified")]
    rows = files.select(*columns).where("length(file_name) > 0 AND content IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            out = []
            for name, data, modified in zip(*(b[c].to_pylist() for c in ("file_name", "content", "modified"))):
                path = os.path.join(folder, *name.split("/"))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(data)
                if stamp and modified:
                    os.utime(part, (modified, modified))
                os.replace(part, path)
                out.append((name, len(data), hashlib.sha256(data).hexdigest()))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["file_name", "n_bytes", "sha256"])

    return rows.mapInArrow(run, WRITTEN)


#: Files of one name are numbered in blocks of so many ids.
IDS_PER_BLOCK = 100_000


def unique_names(files: DataFrame) -> DataFrame:
    """``name[2].ext`` and so on for repeated names, in order of ``file_id``.

    A name is numbered in blocks of ids with one row per block handed over, so a frequent name is many tasks.
    """
    blocked = files.select("file_id", "file_name", F.floor(F.col("file_id") / IDS_PER_BLOCK).alias("block"))
    counts = blocked.groupBy("file_name", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file_name", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file_name", "block").orderBy("file_id")
    numbered = blocked.join(counts, ["file_name", "block"]).withColumn("k", F.col("before") + F.row_number().over(inside) - 1)
    dot = F.length("file_name") - F.locate(".", F.reverse("file_name")) + 1
    has = F.instr("file_name", ".") > 0
    stem, tail = F.when(has, F.substring("file_name", F.lit(1), dot - 1)).otherwise(F.col("file_name")), F.when(has, F.substring("file_name", dot, F.length("file_name"))).otherwise("")
    return numbered.select("file_id", F.when(F.col("k") == 0, F.col("file_name")).otherwise(F.concat(stem, F.lit("["), (F.col("k") + 1).cast("string"), F.lit("]"), tail)).alias("file_name"))


def text_stubs(blocks: DataFrame) -> DataFrame:
    """Stub files ``text_<offset>.<ext>`` with the facts of text blocks, ready for :func:`write_files`."""
    body = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("byte_offset", "length", "kind", "confidence", "quality", "lang", "preview")])
    name = F.concat(F.lit("text_"), F.lpad(F.hex("byte_offset"), 8, "0"), F.lit("."), F.coalesce("extension", F.lit("txt")))
    return blocks.where("byte_offset IS NOT NULL").select(name.alias("file_name"), F.encode(body, "UTF-8").alias("content"))


def append_checkpoint(hits: DataFrame, folder: str) -> None:
    """Appends ``byte_offset, signature, state`` as JSON lines of the second shape."""
    hits.select(F.to_json(F.struct(F.lit(2).alias("v"), F.col("byte_offset").alias("offset"), F.col("signature").alias("sig"), F.col("state").alias("status"))).alias("value")).write.mode("append").text(folder)


def compact_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    """``byte_offset, signature, state``: the last state of every hit, by the time of its file, then the greatest line."""
    rows = spark.read.text(folder).select("value", F.col("_metadata.file_modification_time").alias("at"))
    j = rows.select("at", "value", F.from_json("value", "offset bigint, sig string, status string").alias("j")).where("j.offset IS NOT NULL AND j.sig IS NOT NULL")
    return j.groupBy(F.col("j.offset").alias("byte_offset"), F.col("j.sig").alias("signature")).agg(F.max_by("j.status", F.struct("at", "value")).alias("state"))


def write_comparison(matched: DataFrame, folder: str) -> None:
    """One CSV folder per verdict of a comparison."""
    matched.write.mode("overwrite").option("header", True).partitionBy("verdict").csv(folder)


def sha256_lines(files: DataFrame) -> DataFrame:
    """Sidecar lines ``<digest>  <name>`` of ``file_name, content``."""
    return files.where("content IS NOT NULL").select(F.concat(F.sha2("content", 256), F.lit("  "), F.col("file_name")).alias("line"))


def load_user_signatures(path: str) -> list[Signature]:
    """Signatures of one's own from a TOML file with ``[[signature]]`` tables; a faulty one is refused with its name."""
    with open(path, "rb") as f:
        tables = tomllib.load(f).get("signature", [])
    return [user_signature(t.get("name", ""), t.get("extension", "bin"), t.get("header", ""), t.get("footer", ""), int(t.get("max_size", 0))) for t in tables]


def save_user_signatures(signatures: list[Signature], path: str) -> None:
    hexed = lambda bs: " ".join("??" if b is None else f"{b:02X}" for b in bs)
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    with open(path + ".part", "w", encoding="utf-8") as f:
        for s in signatures:
            f.write(f"[[signature]]\nname = {quote(s.name)}\nextension = {quote(s.extension)}\nheader = {quote(hexed(s.header))}\nfooter = {quote(hexed(s.footer))}\nmax_size = {s.max_size}\n\n")
    os.replace(path + ".part", path)


def read_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Stored sessions (one JSON file each), the newest first."""
    return spark.read.option("multiLine", True).json(folder).orderBy(F.col("updated").desc_nulls_last())
