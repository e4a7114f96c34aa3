"""Text blocks: segmentation of bytes, gates, classification of content, previews, duplicates.

Defined results: null content has no kind; empty content is generic; classification looks at the first
1024 bytes; equal contents keep the block with the lowest offset; blocks go on over the borders of chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits and key words.
GAP, MIN_BLOCK, MIN_QUALITY, MAX_BLOCK = 8, 256, 80, 1 << 20
SQL_WORDS = ["SELECT", "INSERT", "CREATE", "UPDATE", "DELETE", "FROM", "WHERE"]
C_WORDS = ["#include", "#define", "typedef", "struct", "void", "int"]
MARKDOWN_SIGNS = ["# ", "**", "](", "- ["]
EXTENSIONS = {"Php": "php", "Script": "sh", "Markup": "html", "Json": "json", "Yaml": "yaml", "Sql": "sql", "CSource": "c", "Markdown": "md", "Generic": "txt"}
_TEXT = rb"[\t\n\r\x20-\x7e\x80-\xbf\xc2-\xf4]"
_OTHER = rb"[^\t\n\r\x20-\x7e\x80-\xbf\xc2-\xf4]"
_BLOCK = re.compile(_TEXT + rb"{3,}(?:" + _OTHER + rb"{1,8}" + _TEXT + rb"+)*(?:" + _OTHER + rb"{1,8}\Z)?")
_STRETCH = re.compile(_TEXT + rb"+(?:" + _OTHER + rb"{1,8}" + _TEXT + rb"+)*")
_ONE = re.compile(_TEXT)
_THREE = re.compile(_TEXT + rb"{3}")
_SOME = re.compile(_TEXT + rb"*")
_END = re.compile(_TEXT + rb"*\Z")
_PRINTABLE = bytes(range(0x20, 0x7F)) + b"\t\n\r"


def _count(parts: list[Column]) -> Column:
    total = F.lit(0)
    for p in parts:
        total = total + p.cast("int")
    return total


def head(content: Column) -> Column:
    """The first 1024 bytes of a text as characters of one byte each."""
    return F.decode(F.substring(F.encode(content, "UTF-8"), 1, 1024), "ISO-8859-1")


def classify(content: Column) -> Column:
    """``struct<kind, extension, confidence>``; the first rule that fits wins."""
    h = head(content)
    first = F.split(h, "\n").getItem(0)
    script = F.when(first.contains("python"), "py").when(first.contains("ruby"), "rb").when(first.contains("perl"), "pl").when(first.contains("node"), "js").otherwise("sh")
    keys = F.regexp_count(h, F.lit('":'))
    sql = _count([h.contains(w) | h.contains(w.lower()) for w in SQL_WORDS])
    c = _count([h.contains(w) for w in C_WORDS])
    marks = _count([h.contains(s) for s in MARKDOWN_SIGNS])

    def is_(kind: str, extension: Column | str, confidence: int) -> Column:
        ext = F.lit(extension) if isinstance(extension, str) else extension
        return F.struct(F.lit(kind).alias("kind"), ext.alias("extension"), F.lit(confidence).alias("confidence"))

    return F.when(content.isNull(), F.lit(None)).otherwise(
        F.when(h.rlike(r"^<\?php[ \t\r\n]"), is_("Php", "php", 99))
        .when(h.startswith("#!/"), is_("Script", script, 97))
        .when(h.startswith("<?xml"), is_("Markup", "xml", 99))
        .when(F.upper(h).startswith("<!DOCTYPE") | F.upper(h).startswith("<HTML"), is_("Markup", "html", 95))
        .when((h.startswith("{") | h.startswith("[")) & (keys >= 2), is_("Json", "json", 85))
        .when(h.startswith("---\n") | h.startswith("---\r\n"), is_("Yaml", "yaml", 90))
        .when(sql >= 3, is_("Sql", "sql", 70))
        .when(c >= 3, is_("CSource", "c", 65))
        .when(marks >= 2, is_("Markdown", "md", 65))
        .otherwise(is_("Generic", "txt", 50))
    )


def quality(content: Column) -> Column:
    """Share of printable bytes in percent, rounded down."""
    raw = F.decode(F.encode(content, "UTF-8"), "ISO-8859-1")
    return F.floor(F.regexp_count(raw, F.lit(r"[\t\n\r\x20-\x7e]")) * 100 / F.greatest(F.octet_length(content), F.lit(1)))


def gates(content: Column, min_bytes: int = MIN_BLOCK, min_quality: int = MIN_QUALITY) -> Column:
    return (F.octet_length(content) >= min_bytes) & (quality(content) >= min_quality)


def preview(content: Column) -> Column:
    """The first 80 characters with line breaks shown."""
    return F.translate(F.substring(content, 1, 80), "\r\n", "↵↵")


def deduplicate(blocks: DataFrame, content: str, *order: str) -> DataFrame:
    """``order`` columns of the first block of each content (by SHA-256, so without collisions); copies are reduced before the shuffle."""
    return blocks.groupBy(F.sha2(content, 256).alias("_h")).agg(F.min(F.struct(*order)).alias("_f")).select("_f.*")


def segment_bytes(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Text blocks of a device range: opened by three text bytes, closed by more than eight others."""
    for m in _BLOCK.finditer(data):
        for start in range(m.start(), m.end(), MAX_BLOCK):
            yield start, data[start : min(start + MAX_BLOCK, m.end())]


def _outline(data: bytes) -> tuple:
    """What the state behind a chunk depends on: ``n, lead, tail, single, first, opens, last``.

    Other bytes at both ends, whether one stretch of text with short gaps is all, length of a text run at the
    begin, the place where a block opens in the last stretch, and the text bytes (two at most) at the end.
    """
    n, spans = len(data), [m.span() for m in _STRETCH.finditer(data)]
    if not spans:
        return n, n, n, False, 0, None, b""
    a, b = spans[-1]
    opens = _THREE.search(data, a, b)
    return n, spans[0][0], n - b, len(spans) == 1, _SOME.match(data).end(), opens.start() if opens else None, _END.search(data[-2:]).group()


def _follow(rows: list[dict]) -> Iterator[tuple]:
    """``base_offset, run, gap, prefix, keep, more`` of the chunks of an image, from their outlines in order.

    ``run`` is the start of the block that is open before the chunk, with ``gap`` other bytes at its end; ``prefix`` the
    text bytes before the chunk while none is open. ``keep``: other bytes at the end belong to the block; ``more``: another chunk follows.
    """
    joined = [k + 1 < len(rows) and rows[k + 1]["base_offset"] == r["base_offset"] + r["n"] for k, r in enumerate(rows)]
    others = [0] * len(rows)  # between the end of a chunk and the next text, or the end of the image
    for k in range(len(rows) - 2, -1, -1):
        x = rows[k + 1]
        others[k] = 0 if not joined[k] else x["lead"] if x["lead"] < x["n"] else x["n"] + others[k + 1]
    run, gap, prefix = None, 0, b""
    for k, r in enumerate(rows):
        if k and not joined[k - 1]:
            run, gap, prefix = None, 0, b""
        base, before, silent = r["base_offset"], (run, gap, prefix), r["lead"] == r["n"]
        on = run is not None and gap + r["lead"] <= GAP
        ahead = len(prefix) if not r["lead"] else 0
        if silent:
            run, gap, prefix = (run, gap + r["n"], b"") if on else (None, 0, b"")
        elif r["tail"] > GAP:
            run, gap, prefix = None, 0, b""
        elif r["single"] and on:
            gap, prefix = r["tail"], b""
        elif r["single"] and ahead and ahead + r["first"] >= 3:
            run, gap, prefix = base - ahead, r["tail"], b""
        elif r["opens"] is not None:
            run, gap, prefix = base + r["opens"], r["tail"], b""
        else:
            run, gap, prefix = None, 0, (prefix if r["first"] == r["n"] else b"") + r["last"]
        rest = gap if run is not None else r["tail"]
        yield base, *before, rest + others[k] <= GAP, joined[k]


def _pieces(data: bytes, base: int, run: int | None, gap: int, prefix: bytes, keep: bool, more: bool) -> Iterator[tuple[int, int, bytes, bool]]:
    """``block start, offset, bytes, whole`` of the parts of blocks in a chunk."""
    virtual = prefix if run is None else b"aaa" + b"\0" * gap
    text, shift = virtual + data, base - len(virtual)
    for m in _BLOCK.finditer(text):
        a, b = m.span()
        at_end = b == len(text)
        if at_end and not keep:
            while b > a and not _ONE.match(text, b - 1):
                b -= 1
        begin = shift + a
        if run is not None and a == 0:
            begin, a = run, len(virtual)
        at = shift + a
        while a < b:
            block = begin + (at - begin) // MAX_BLOCK * MAX_BLOCK
            size = min(b - a, block + MAX_BLOCK - at)
            full = at + size == block + MAX_BLOCK
            yield block, at, text[a : a + size], at == block and (full or not (at_end and keep and more))
            a, at = a + size, at + size


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values())], names=list(kinds))


_OUTLINE = {"image_id": pa.int64(), "base_offset": pa.int64(), "n": pa.int64(), "lead": pa.int64(), "tail": pa.int64(), "single": pa.bool_(), "first": pa.int64(), "opens": pa.int64(), "last": pa.binary()}
_STATE = {"image_id": pa.int64(), "base_offset": pa.int64(), "run": pa.int64(), "gap": pa.int64(), "prefix": pa.binary(), "keep": pa.bool_(), "more": pa.bool_()}
_PIECE = {"image_id": pa.int64(), "block": pa.int64(), "at": pa.int64(), "bytes": pa.binary(), "whole": pa.bool_()}
_RESULT = {"image_id": pa.int64(), "byte_offset": pa.int64(), "length": pa.int64(), "quality": pa.int32(), "content": pa.string()}


def _ddl(kinds: dict) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{k} {names[t]}" for k, t in kinds.items())


def _gated(block: bytes) -> tuple[int, int, str] | None:
    """``length, quality, content`` of a block that passes the gates."""
    good = len(block) - len(block.translate(None, _PRINTABLE))
    if len(block) < MIN_BLOCK or good * 100 // len(block) < MIN_QUALITY:
        return None
    return len(block), good * 100 // len(block), block.decode("utf-8", "replace")


def carve(chunks: DataFrame) -> DataFrame:
    """Blocks of ``image_id, base_offset, content`` chunks that pass the gates, as if each image were read in one piece.

    ``image_id, byte_offset, length, quality, content``. Only the first ``report`` bytes of a chunk count where it has that
    column. Chunks are read twice: for an outline of each, then for the blocks. One small row per chunk is
    broadcast; of the bytes, blocks that pass the gates and parts of blocks that cross a border are shuffled.
    """
    size = F.col("report") if "report" in chunks.columns else F.octet_length("content")
    chunks = chunks.select("image_id", "base_offset", F.substring("content", F.lit(1), size).alias("content")).where("octet_length(content) > 0")

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(i, o, *_outline(d)) for i, o, d in zip(*(b[c].to_pylist() for c in ("image_id", "base_offset", "content")))], _OUTLINE)

    def follow(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["base_offset"])
        return pa.Table.from_batches([_batch([(rows[0]["image_id"], *x) for x in _follow(rows)], _STATE)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, base, data, *state in zip(*(b[c].to_pylist() for c in ("image_id", "base_offset", "content", "run", "gap", "prefix", "keep", "more"))):
                parts = _pieces(data, base, *state)
                yield _batch([(image, *x) for x in parts if not x[3] or _gated(x[2])], _PIECE)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for image, at, parts in zip(b["image_id"].to_pylist(), b["block"].to_pylist(), b["parts"].to_pylist()):
                found = _gated(b"".join(parts))
                if found:
                    rows.append((image, at, *found))
            yield _batch(rows, _RESULT)

    states = chunks.mapInArrow(outlines, _ddl(_OUTLINE)).groupBy("image_id").applyInArrow(follow, _ddl(_STATE))
    pieces = chunks.join(F.broadcast(states), ["image_id", "base_offset"]).mapInArrow(cut, _ddl(_PIECE))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("at", "bytes"))), lambda x: x["bytes"])
    blocks = pieces.groupBy("image_id", "block").agg(parts.alias("parts"))
    return blocks.mapInArrow(judge, _ddl(_RESULT))
