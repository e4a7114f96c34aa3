"""Personal-data artifacts in text by fixed patterns and checksums, as column expressions.

Every scanner turns a text column into ``kind, byte_offset, value, confidence`` rows. A row's offset is
``base`` plus the bytes before the match in UTF-8.

Defined results: null and empty texts have no hits; figures and word edges are ASCII only; a run of
20 or more figures is cut after 19 and goes on behind it; hits come per row of the input, repeated rows
included, until :func:`deduplicate`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the six kinds, and mail domains that only stand for one.
PATTERNS = {
    "Email": r"[a-zA-Z0-9._%+\-]{1,64}@[a-zA-Z0-9.\-]{1,253}\.[a-zA-Z]{2,10}",
    "URL": r"""https?://[^\x00-\x20"'<>\[\]\\{}|^`]{4,200}""",
    "Credit Card": r"[0-9]{13,19}",
    "IBAN": r"(?<![0-9A-Za-z_])[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30}(?![0-9A-Za-z_])",
    "Windows Path": r"""[A-Za-z]:\\[^\x00-\x1f"*?<>|]{3,260}""",
    "SSN": r"(?<![0-9A-Za-z_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z_])",
}
PLACEHOLDER_DOMAINS = [
    "example.com", "example.org", "example.net", "test.com", "test.org", "localhost", "domain.com", "email.com", "yourdomain.com", "placeholder.com", "sample.com",
]
CONTEXT_BYTES = 32


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern with their byte offsets: ``array<struct<value, at>>``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def size(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))

    return F.transform(found, lambda v, i: F.struct(v.alias("value"), (size(F.slice(gaps, F.lit(1), i + 1)) + size(F.slice(found, F.lit(1), i))).alias("at")))


def luhn_ok(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def mod97_ok(iban: Column) -> Column:
    """ISO 7064 remainder of an IBAN with the first four signs moved to the end."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.conv(c, 36, 10).cast("long"))
    kept = F.filter(values, lambda d: d.isNotNull())
    return F.aggregate(kept, F.lit(0).cast("long"), lambda a, d: (a * F.when(d > 9, 100).otherwise(10) + d) % 97) == 1


def mask_last4(value: Column) -> Column:
    return F.concat(F.lit("****-****-****-"), F.substring(value, -4, 4))


def _printable_share(text: Column, at: Column, length: Column) -> Column:
    raw = F.encode(text, "UTF-8")
    start = F.greatest(at - CONTEXT_BYTES, F.lit(0))
    end = F.least(at + length + CONTEXT_BYTES, F.octet_length(text).cast("long"))
    window = F.decode(F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")), "ISO-8859-1")
    return F.regexp_count(window, F.lit(r"[\x20-\x7E]")) / F.greatest(end - start, F.lit(1))


def scan(df: DataFrame, text: str, kinds: list[str] | None = None, *keep: str) -> DataFrame:
    """``keep`` columns with ``kind, byte_offset, value, confidence`` of the enabled kinds (none given: all)."""
    out = []
    for kind in kinds or list(PATTERNS):
        pattern = PATTERNS[kind]
        rows = df.where(F.col(text).rlike(pattern)).select(*keep, F.col(text).alias("_t"), F.explode(matches(F.col(text), pattern)).alias("_m"))
        value, at, ok, confidence = F.col("_m.value"), F.col("_m.at"), F.lit(True), F.lit("High")
        if kind == "Email":
            confidence = F.when(F.substring_index(value, "@", -1).isin(PLACEHOLDER_DOMAINS), F.lit("Low")).otherwise("High")
        elif kind == "URL":
            value = F.regexp_replace(value, r"[.,);]+$", "")
            ok = F.octet_length(value) >= 11
        elif kind == "Credit Card":
            ok = luhn_ok(value)
            confidence = F.when(_printable_share(F.col("_t"), at, F.octet_length(value)) >= 0.5, F.lit("High")).otherwise("Low")
            value = mask_last4(value)
        elif kind == "IBAN":
            ok = F.length(value).between(15, 34) & mod97_ok(value)
        elif kind == "Windows Path":
            value = F.regexp_replace(value, r"[\s\x00]+$", "")
            ok = F.octet_length(value) >= 6
        elif kind == "SSN":
            ok = ~F.substring(value, 1, 3).isin("000", "666") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000")
        out.append(rows.where(ok).select(*keep, F.lit(kind).alias("kind"), at.alias("byte_offset"), value.alias("value"), confidence.alias("confidence")))
    return reduce(DataFrame.unionByName, out)


def deduplicate(hits: DataFrame, *order: str) -> DataFrame:
    """The first hit of every kind and value in the given order; masked values that agree are one.

    An aggregate, so a value that a third of all hits share is reduced before the shuffle.
    """
    keys = list(order or ("byte_offset",))
    rest = [c for c in hits.columns if c not in ("kind", "value", *keys)]
    first = hits.groupBy("kind", "value").agg(F.min(F.struct(*keys, *rest)).alias("_f"))
    return first.select("kind", "value", "_f.*").select(*hits.columns)


def csv_lines(hits: DataFrame) -> DataFrame:
    """Export lines ``byte_offset,kind,confidence,"value"`` with doubled quotes."""
    quoted = F.concat(F.lit('"'), F.replace("value", F.lit('"'), F.lit('""')), F.lit('"'))
    return hits.select(F.concat_ws(",", F.col("byte_offset").cast("string"), "kind", "confidence", quoted).alias("line"))
