"""Schemas that drift between files: path-value rows, per-file statistics, changes, one typed table.

A line of JSON becomes one row per path with the type it was written in and a canonical value; all
the rest is joins and aggregates over those rows, so neither a large file nor a long session is
gathered anywhere. An object with a single capitalised key is a tagged variant (such as a status);
it counts as one value without a type.

Defined results for odd input
-----------------------------
* Lines that are no JSON objects (cut, empty, ``null``, comments) don't count; repeated rows count once.
* A null value is no value. Keys nested in lists are no paths. Clashing or extra columns are ignored.
* A file without a usable line has no fields, so all fields of the next one are added.
* Types that are equally frequent: the first of string, integer, number, boolean, array.
* A lost field and a new one make a rename when they are each other's best match over the common hits.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltbed.plans.lineage import cut

SCHEMA = "file_id bigint, line_no int, path string, type string, value string, raw string"
#: The path under which every usable line is counted.
LINE = ""
STATUS = "status"
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_HEX = re.compile(r"0[xX][0-9a-fA-F]+")
_INSTANT = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\dZ?")


class _Literal(str):
    """A JSON number as it was written."""


def _plain_number(text: str) -> str:
    try:
        d = Decimal(text)
        return str(int(d)) if d == d.to_integral_value() and abs(d.adjusted()) < 40 else format(d.normalize(), "f")
    except (InvalidOperation, ValueError, OverflowError):
        return text


def _canonical(value: object) -> tuple[str, str, str]:
    """Type, canonical value (a number is the same in any notation, as text too) and the value as written."""
    if isinstance(value, bool):
        text = "true" if value else "false"
        return "boolean", text, text
    if isinstance(value, _Literal):
        return ("number" if any(c in value for c in ".eE") else "integer"), _plain_number(value), str(value)
    if isinstance(value, str):
        return "string", _plain_text(value), value
    text = json.dumps(value, separators=(",", ":"), sort_keys=True)
    return "array", text, text


def _plain_text(value: str) -> str:
    text = value.strip()
    if _HEX.fullmatch(text):
        return str(int(text, 16))
    if len(text) < 60 and _NUMBER.fullmatch(text):
        return _plain_number(text)
    if _INSTANT.fullmatch(text):
        try:
            return str(int(datetime.fromisoformat(text.rstrip("Z")).replace(tzinfo=timezone.utc).timestamp()))
        except ValueError:
            return value
    return text.lower() if text.lower() in ("true", "false") else value


def _variant(value: dict) -> bool:
    return len(value) == 1 and next(iter(value))[:1].isupper()


def _walk(node: dict, prefix: str) -> Iterator[tuple[str, str, str, str]]:
    for key, value in node.items():
        path = f"{prefix}.{key}" if prefix else key
        if value is None:
            continue
        if isinstance(value, dict):
            if _variant(value) or path == STATUS:
                text = json.dumps(value, separators=(",", ":"), sort_keys=True)
                yield path, "variant", text, text
            else:
                yield from _walk(value, path)
        else:
            yield path, *_canonical(value)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decoder = json.JSONDecoder(parse_int=_Literal, parse_float=_Literal)
    for batch in batches:
        files, numbers, paths, types, values, raws = [], [], [], [], [], []
        for f, n, line in zip(batch["file_id"].to_pylist(), batch["line_no"].to_pylist(), batch["line"].to_pylist()):
            try:
                node = decoder.decode(line.strip())
            except (ValueError, RecursionError):
                continue
            if not isinstance(node, dict):
                continue
            rows = [(LINE, "line", None, None), *_walk(node, "")]
            files += [f] * len(rows)
            numbers += [n] * len(rows)
            for path, kind, value, raw in rows:
                paths.append(path)
                types.append(kind)
                values.append(value)
                raws.append(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(files, pa.int64()), pa.array(numbers, pa.int32()), pa.array(paths, pa.string()), pa.array(types, pa.string()), pa.array(values, pa.string()), pa.array(raws, pa.string())],
            names=["file_id", "line_no", "path", "type", "value", "raw"],
        )


def path_values(lines: DataFrame) -> DataFrame:
    """``file_id, line_no, path, type, value, raw`` of ``file_id, line_no, line``; a line itself has the path ``''``.

    ``raw`` is the value as written, ``value`` its canonical form, by which values are compared.
    """
    usable = lines.select("file_id", "line_no", "line").where("file_id IS NOT NULL AND line_no IS NOT NULL AND line IS NOT NULL")
    return usable.distinct().mapInArrow(_parse, SCHEMA)


def file_fields(values: DataFrame) -> DataFrame:
    """``file_id, path, type``: the fields that more than half of a file's lines hold, with the usual type."""
    counts = values.groupBy("file_id", "path", "type").agg(F.count("*").alias("n"))
    order = F.array(*[F.lit(t) for t in ("string", "integer", "number", "boolean", "array", "variant")])
    per_path = counts.groupBy("file_id", "path").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", (-F.array_position(order, F.col("type"))).alias("o"), "type")).alias("best"),
        F.max(F.col("type") == "variant").alias("variant"),
    )
    lines = per_path.where(F.col("path") == LINE).select("file_id", F.col("n").alias("n_lines"))
    return (
        per_path.where(F.col("path") != LINE)
        .join(lines, "file_id")
        .where(F.col("n") * 2 > F.col("n_lines"))
        .select("file_id", "path", F.when(F.col("variant") | (F.col("path") == STATUS), F.lit("variant")).otherwise(F.col("best.type")).alias("type"), "n_lines")
    )


def file_pairs(files: DataFrame) -> DataFrame:
    """``file_id, prev_id``: each file with the one before it in its session."""
    once = files.select("file_id", "session_id", "file_no").where("file_id IS NOT NULL AND session_id IS NOT NULL AND file_no IS NOT NULL").distinct()
    before = Window.partitionBy("session_id").orderBy("file_no", "file_id")
    return once.withColumn("prev_id", F.lag("file_id").over(before)).where("prev_id IS NOT NULL").select("file_id", "prev_id")


def _renames(values: DataFrame, fields: DataFrame, pairs: DataFrame, lost: DataFrame, came: DataFrame) -> DataFrame:
    """``file_id, old_field, new_field`` for fields that hold the same value for most common hits."""
    todo = cut(lost.select("file_id", "prev_id").intersect(came.select("file_id", "prev_id")))
    # only files on either side of such a pair matter from here on
    sides = todo.select("file_id").union(todo.select("prev_id")).distinct()
    values = cut(values.join(sides, "file_id", "left_semi"))
    # the key of a pair of files: the two fields that have most values in common
    held = fields.select("file_id", "path", "n_lines")
    distinct = values.where(F.col("type").isin("string", "integer", "number")).select("file_id", "path", "value").distinct()
    keys = distinct.join(held, ["file_id", "path"])
    wide = keys.groupBy("file_id", "path").agg(F.count("*").alias("d"), F.first("n_lines").alias("n")).where("d * 2 >= n").select("file_id", "path")
    keys = keys.join(wide, ["file_id", "path"]).select("file_id", "path", "value")
    new = todo.join(keys, "file_id").select("file_id", F.col("path").alias("kb"), "value")
    old = todo.join(keys.withColumnRenamed("file_id", "prev_id"), "prev_id").select("file_id", F.col("path").alias("ka"), "value")
    best = (
        old.join(new, ["file_id", "value"]).groupBy("file_id", "ka", "kb").agg(F.count("*").alias("n_common"))
        .groupBy("file_id").agg(F.max(F.struct("n_common", "ka", "kb")).alias("k")).select("file_id", "k.*")
    )
    key = cut(todo.join(best, "file_id"))

    def held_by(side: str, which: str, changed: DataFrame, name: str) -> DataFrame:
        """``file_id, hit, name, value`` of the changed fields on one side of each pair."""
        at = values.withColumnRenamed("file_id", side)
        hits = key.select("file_id", "prev_id", F.col(which).alias("path")) if side == "prev_id" else key.select("file_id", F.col(which).alias("path"))
        hits = hits.join(at, [side, "path"]).select("file_id", side, "line_no", F.col("value").alias("hit")) if side == "prev_id" else hits.join(at, ["file_id", "path"]).select("file_id", "line_no", F.col("value").alias("hit"))
        wanted = changed.select("file_id", "prev_id", "path").join(key.select("file_id"), "file_id") if side == "prev_id" else changed.select("file_id", "path").join(key.select("file_id"), "file_id")
        vals = wanted.join(at, [side, "path"]).select("file_id", "line_no", F.col("path").alias(name), "value")
        return hits.select("file_id", "line_no", "hit").join(vals, ["file_id", "line_no"]).select("file_id", "hit", name, "value").distinct()

    a = held_by("prev_id", "ka", lost, "old_field")
    b = held_by("file_id", "kb", came, "new_field")
    same = (
        a.join(b, ["file_id", "hit", "value"]).groupBy("file_id", "old_field", "new_field").agg(F.count_distinct("hit").alias("n"))
        .join(key.select("file_id", "n_common"), "file_id").where("n * 2 > n_common")
    )
    by_old = Window.partitionBy("file_id", "old_field").orderBy(F.desc("n"), "new_field")
    by_new = Window.partitionBy("file_id", "new_field").orderBy(F.desc("n"), "old_field")
    return same.withColumn("i", F.row_number().over(by_old)).withColumn("j", F.row_number().over(by_new)).where("i = 1 AND j = 1").select("file_id", "old_field", "new_field")


def changes(values: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, change_kind, old_field, new_field`` of each file against the one before it."""
    fields = cut(file_fields(values))
    pairs = cut(file_pairs(files))
    new = pairs.join(fields.select("file_id", "path", "type"), "file_id")
    old = pairs.join(fields.select(F.col("file_id").alias("prev_id"), "path", "type"), "prev_id")
    both = cut(
        old.select("file_id", "prev_id", "path", F.col("type").alias("old_type")).join(
            new.select("file_id", "prev_id", "path", F.col("type").alias("new_type")), ["file_id", "prev_id", "path"], "full"
        )
    )
    lost = both.where("new_type IS NULL").select("file_id", "prev_id", "path", "old_type")
    came = both.where("old_type IS NULL").select("file_id", "prev_id", "path", "new_type")
    renamed = cut(_renames(values, fields, pairs, lost, came))
    typed = (
        renamed.join(lost.select("file_id", F.col("path").alias("old_field"), "old_type"), ["file_id", "old_field"])
        .join(came.select("file_id", F.col("path").alias("new_field"), "new_type"), ["file_id", "new_field"])
    )
    kept = both.where("old_type IS NOT NULL AND new_type IS NOT NULL").select("file_id", F.col("path").alias("old_field"), F.col("path").alias("new_field"), "old_type", "new_type")
    differs = (F.col("old_type") != F.col("new_type")) & (F.col("old_type") != "variant") & (F.col("new_type") != "variant")
    retyped = typed.select(*kept.columns).unionByName(kept).where(differs)
    gone = lost.withColumnRenamed("path", "old_field").join(renamed, ["file_id", "old_field"], "left_anti")
    added = came.withColumnRenamed("path", "new_field").join(renamed, ["file_id", "new_field"], "left_anti")

    def rows(df: DataFrame, kind: str, old_field: object, new_field: object) -> DataFrame:
        return df.select("file_id", F.lit(kind).alias("change_kind"), F.lit(old_field).alias("old_field") if old_field == "" else F.col(old_field), F.lit(new_field).alias("new_field") if new_field == "" else F.col(new_field))

    return (
        rows(added, "added", "", "new_field").unionByName(rows(gone, "removed", "old_field", ""))
        .unionByName(rows(renamed, "renamed", "old_field", "new_field")).unionByName(rows(retyped, "retyped", "old_field", "new_field"))
        .distinct()
    )


#: Columns of the consistent table at most; the other paths stay in its last column.
MAX_COLUMNS = 200
#: SQL types of the consistent table by the usual type of a field.
SQL_TYPES = {"integer": "bigint", "number": "double", "boolean": "boolean", "string": "string", "array": "string", "variant": "string"}


def field_groups(changed: DataFrame) -> dict[str, str]:
    """Name of each renamed field in the consistent table, from the distinct renames (as many as there are names)."""
    pairs = [(r[0], r[1]) for r in changed.where("change_kind = 'renamed'").select("old_field", "new_field").distinct().collect()]
    parent: dict[str, str] = {}

    def top(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in sorted(pairs):
        parent[top(b)] = top(a)
    names: dict[str, list[str]] = {}
    for x in list(parent):
        names.setdefault(top(x), []).append(x)
    # the shortest name stands for a group, the first of equally short ones
    return {x: min(group, key=lambda g: (g.count("."), len(g), g)) for group in names.values() for x in group}


def usual_fields(values: DataFrame, groups: dict[str, str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Rows with ``field``, the common name of their path, and the fields that get a column, with SQL types.

    A field gets a column where it is a usual field of some file, the :data:`MAX_COLUMNS` of most values
    first; names that come up now and then, such as data used as keys, don't widen the table.
    """
    mapping = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv]) if groups else None
    name = F.coalesce(mapping[F.col("path")], F.col("path")) if mapping is not None else F.col("path")
    rows = values.where(F.col("path") != LINE).withColumn("field", name)
    usual = file_fields(values).select(name.alias("field")).distinct()
    counted = rows.groupBy("field", "type").agg(F.count("*").alias("n")).groupBy("field").agg(F.sum("n").alias("n"), F.max(F.struct("n", "type")).alias("b"), F.max(F.col("type") == "variant").alias("v"))
    kept = counted.join(usual, "field", "left_semi").select("field", F.when(F.col("v"), F.lit("variant")).otherwise(F.col("b.type")).alias("type"), "n")
    top = kept.orderBy(F.desc("n"), "field").limit(MAX_COLUMNS).collect()
    return rows, sorted((r["field"], SQL_TYPES[r["type"]]) for r in top)


def consistent_table(values: DataFrame, groups: dict[str, str]) -> DataFrame:
    """One typed row per line: ``file_id, line_no``, a column per usual field (dots as ``__``) and reports.

    A column is cast from the value as written or, where that fails, from its canonical form.
    ``failed_casts`` names the fields where neither fits, ``normalised`` those where only the second does,
    ``clashes`` those that a line holds under several names with different values (the common name wins, then
    the last one in order). ``rest`` has the paths without a column, with values as written; so no value is lost.
    """
    rows, fields = usual_fields(values, groups)
    column = lambda f: f.replace(".", "__")
    best, least, most = [], [], []
    for k, (f, _) in enumerate(fields):
        mine = F.col("field") == f
        best.append(F.max(F.when(mine, F.struct(F.col("path") == f, "path", "value", "raw"))).alias(f"b{k}"))
        least.append(F.min(F.when(mine, F.col("value"))).alias(f"l{k}"))
        most.append(F.max(F.when(mine, F.col("value"))).alias(f"m{k}"))
    other = F.col("field").isin([f for f, _ in fields]) if fields else F.lit(False)
    rest = F.sort_array(F.collect_list(F.when(~other, F.struct("path", "raw")))).alias("rest")
    wide = rows.groupBy("file_id", "line_no").agg(*best, *least, *most, rest)
    raw = lambda k, t: F.col(f"b{k}.raw").try_cast(t)
    plain = lambda k, t: F.col(f"b{k}.value").try_cast(t)
    typed = [F.coalesce(raw(k, t), plain(k, t)).alias(column(f)) for k, (f, t) in enumerate(fields)]
    none = F.array().cast("array<string>")

    def report(test: object) -> Column:
        return F.array_compact(F.array(*[F.when(test(k, t), F.lit(column(f))) for k, (f, t) in enumerate(fields)])) if fields else none

    held = lambda k: F.col(f"b{k}").isNotNull()
    return wide.select(
        "file_id", "line_no", *typed,
        report(lambda k, t: held(k) & raw(k, t).isNull() & plain(k, t).isNull()).alias("failed_casts"),
        report(lambda k, t: held(k) & raw(k, t).isNull() & plain(k, t).isNotNull()).alias("normalised"),
        report(lambda k, t: F.col(f"l{k}") != F.col(f"m{k}")).alias("clashes"), "rest",
    )
