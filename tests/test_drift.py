"""Schema changes on small sessions with known outcomes."""

import json

from siltbed.operators import drift


def run(spark, files, session=1):
    lines = [(f, n, x if isinstance(x, str) or x is None else json.dumps(x), "clash") for f, rows in files.items() for n, x in enumerate(rows)]
    lines += lines[:1]
    values = drift.path_values(spark.createDataFrame(lines, "file_id long, line_no int, line string, value string")).cache()
    table = spark.createDataFrame([(f, session, k) for k, f in enumerate(files)], "file_id long, session_id long, file_no int")
    return values, drift.changes(values, table)


def rows(df):
    return {tuple(r) for r in df.select("file_id", "change_kind", "old_field", "new_field").collect()}


def test_all_kinds_of_change(spark):
    old = [{"offset": 1000 * k, "sig": f"S{k % 3}", "note": "x", "size": k, "status": "Unextracted"} for k in range(1, 9)]
    new = [{"pos": str(1000 * k) if k % 2 else hex(1000 * k), "name": f"S{k % 3}", "size": str(k), "live": True, "state": "Unextracted" if k > 2 else {"Ok": {"bytes": 5}}} for k in range(2, 9)]
    _, found = run(spark, {1: old, 2: [*new, "{cut", "", None, "null", "[1]"]})
    assert rows(found) == {
        (2, "renamed", "offset", "pos"), (2, "retyped", "offset", "pos"), (2, "renamed", "sig", "name"), (2, "removed", "note", ""),
        (2, "retyped", "size", "size"), (2, "added", "", "live"), (2, "renamed", "status", "state"),
    }


def test_nested_fields_nulls_and_number_notations(spark):
    old = [{"hit": {"at": 10.0 * k, "sig": {"n": "A"}}, "w": None} for k in range(1, 6)]
    new = [{"at": 10 * k, "sig": "A", "w": None if k > 1 else "z"} for k in range(1, 6)]
    _, found = run(spark, {5: old, 6: new})
    assert rows(found) == {(6, "renamed", "hit.at", "at"), (6, "retyped", "hit.at", "at"), (6, "renamed", "hit.sig.n", "sig")}


def test_file_without_lines_and_empty_table(spark):
    _, found = run(spark, {1: ["", "x"], 2: [{"a": 1}]})
    assert rows(found) == {(2, "added", "", "a")}
    _, found = run(spark, {1: [None]})
    assert rows(found) == set()


def test_consistent_table_reports_failed_casts(spark):
    old = [{"offset": k, "n": k} for k in range(1, 6)]
    new = [{"off": k, "n": "bad" if k == 3 else k} for k in range(1, 6)]
    values, found = run(spark, {1: old, 2: new})
    groups = drift.field_groups(found)
    assert groups == {"off": "off", "offset": "off"}
    got = {(r.file_id, r.off, r.n): list(r.failed_casts) for r in drift.consistent_table(values, groups).collect()}
    assert got[(2, 3, None)] == ["n"] and got[(1, 3, 3)] == [] and len(got) == 10


def test_values_stay_as_written_and_nothing_is_lost(spark):
    old = [{"code": "007", "at": k, "when": "2024-01-01T00:00:00Z", "flag": "TRUE"} for k in range(1, 6)]
    new = [{"code": "1e5", "pos": hex(k), "when": "x", "flag": "no", **({"at": 99, f"k{k}": k} if k == 2 else {})} for k in range(1, 6)]
    values, found = run(spark, {1: old, 2: new})
    groups = drift.field_groups(found)
    assert groups == {"at": "at", "pos": "at"}
    table = drift.consistent_table(values, groups)
    assert table.columns == ["file_id", "line_no", "at", "code", "flag", "when", "failed_casts", "normalised", "clashes", "rest"]
    got = {(r.file_id, r.line_no): r for r in table.collect()}
    assert got[(1, 0)].code == "007" and got[(2, 0)].code == "1e5" and got[(1, 0)].when == "2024-01-01T00:00:00Z" and got[(1, 0)].flag == "TRUE"
    assert got[(2, 0)].at == "0x1" or got[(2, 0)].at == 1
    assert got[(2, 1)].clashes == ["at"] and got[(2, 1)].at in (99, "99") and [tuple(x) for x in got[(2, 1)].rest] == [("k2", "2")]
    assert got[(1, 0)].clashes == [] and got[(1, 0)].rest == []
