"""Bytes of carved files from chunks of an image, with zeros where nothing could be read.

A file is read in pieces of :data:`PIECE` bytes aligned to the image, so a long file is many rows and many
tasks, and a hit joins only the chunks it overlaps.

Defined results: hits with a null offset or a size that is null or below one have no bytes; bytes that no chunk
holds are zeros and counted in ``n_zero``; where chunks overlap, the one that begins last wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 256 * 1024
#: Sizes up to which a file may be one value.
WHOLE = 64 * 1024 * 1024

_BYTES = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("n_zero", T.LongType())])


@F.pandas_udf(_BYTES)
def _assemble(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for begins, ends, parts in batches:
        out = []
        for begin, end, found in zip(begins.astype(int), ends.astype(int), parts):
            data, seen = bytearray(end - begin), np.zeros(end - begin, bool)
            held = [(int(p["base_offset"]), p["content"]) for p in (found if found is not None else []) if p["content"] is not None]
            for base, content in sorted(held, key=lambda p: p[0]):
                a, stop = max(begin, base), min(end, base + len(content))
                if a < stop:
                    data[a - begin : stop - begin] = content[a - base : stop - base]
                    seen[a - begin : stop - begin] = True
            out.append((bytes(data), int((~seen).sum())))
        yield pd.DataFrame(out, columns=["content", "n_zero"])


def _blocks(first: object, last: object, piece: int) -> object:
    return F.explode(F.sequence(F.floor(first / piece), F.floor(last / piece)))


def read_pieces(hits: DataFrame, chunks: DataFrame, piece: int = PIECE) -> DataFrame:
    """``image_id, byte_offset, size, piece_no, content, n_zero`` of hits ``image_id, byte_offset, size``.

    ``chunks`` has ``image_id, base_offset, content``; unreadable ones are missing or null.
    """
    wanted = hits.where("image_id IS NOT NULL AND byte_offset IS NOT NULL AND size >= 1").select("image_id", "byte_offset", "size").distinct()
    end = F.col("byte_offset") + F.col("size")
    wanted = wanted.select("*", _blocks(F.col("byte_offset"), end - 1, piece).alias("block"))
    held = chunks.where("image_id IS NOT NULL AND base_offset IS NOT NULL AND octet_length(content) > 0").select("image_id", "base_offset", "content")
    held = held.select("*", _blocks(F.col("base_offset"), F.col("base_offset") + F.octet_length("content") - 1, piece).alias("block"))
    # only the part of a chunk inside the block moves
    low = F.greatest(F.col("block") * piece, "base_offset")
    held = held.select("image_id", "block", low.alias("base_offset"), F.substring("content", (low - F.col("base_offset") + 1).cast("int"), F.lit(piece) - (low % piece).cast("int")).alias("content"))
    parts = wanted.join(held, ["image_id", "block"], "left").groupBy("image_id", "byte_offset", "size", "block").agg(F.collect_list(F.struct("base_offset", "content")).alias("parts"))
    begin, stop = F.greatest(F.col("block") * piece, "byte_offset"), F.least((F.col("block") + 1) * piece, end)
    read = parts.withColumn("r", _assemble.asNondeterministic()(begin, stop, "parts"))
    return read.select("image_id", "byte_offset", "size", (F.col("block") - F.floor(F.col("byte_offset") / piece)).cast("int").alias("piece_no"), "r.content", "r.n_zero")


def extract_to_vec(hits: DataFrame, chunks: DataFrame, piece: int = PIECE, whole: int = WHOLE) -> DataFrame:
    """``image_id, byte_offset, size, content, n_zero``: one row per hit; beyond ``whole`` bytes ``content`` is null.

    Larger files stay in the rows of :func:`read_pieces`.
    """
    pieces = read_pieces(hits, chunks, piece)
    kept = F.when(F.col("size") <= whole, F.struct("piece_no", "content"))
    joined = pieces.groupBy("image_id", "byte_offset", "size").agg(F.sort_array(F.collect_list(kept)).alias("p"), F.sum("n_zero").alias("n_zero"))
    content = F.when(F.size("p") > 0, F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["content"])))
    return joined.select("image_id", "byte_offset", "size", content.alias("content"), "n_zero")
