"""Small scalar functions on columns: sizes, dates, names, numbers in other notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_bytes(n: Column) -> Column:
    """``1.50 KiB`` and so on, halves to even; plain bytes below 1024; null stays null."""
    out = F.when(n >= 1 << 30, F.format_string("%.2f GiB", F.bround(n / F.lit(float(1 << 30)), 2))).when(n >= 1 << 20, F.format_string("%.2f MiB", F.bround(n / F.lit(float(1 << 20)), 2)))
    return out.when(n >= 1 << 10, F.format_string("%.2f KiB", F.bround(n / F.lit(1024.0), 2))).when(n.isNotNull(), F.format_string("%d B", n))


def unix_date(seconds: Column) -> Column:
    """Day of a Unix time in UTC as ``yyyy-MM-dd``; null for 0 and null."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.nullif(seconds, F.lit(0)) / 86400).cast("int")), "yyyy-MM-dd")


def octal(text: Column) -> Column:
    return F.conv(F.regexp_extract(text, r"^\s*([0-7]+)", 1), 8, 10).cast("long")


def syncsafe(value: Column) -> Column:
    """28-bit number from 4 bytes of 7 bits each, given as one integer."""
    part = lambda k: F.shiftright(value, 8 * k).bitwiseAND(F.lit(0x7F))
    return F.shiftleft(part(3), 21) + F.shiftleft(part(2), 14) + F.shiftleft(part(1), 7) + part(0)


def safe_name(path: Column) -> Column:
    """A relative path without leading separators, ``..`` and reserved signs."""
    parts = F.filter(F.split(F.regexp_replace(path, r"^[/\\]+", ""), r"[/\\]"), lambda x: (x != "..") & (x != ""))
    return F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, r'[:*?<>|"]', "_")), "/")


def carved_name(name: Column, extension: Column, offset: Column, prefix: str = "file") -> Column:
    """The known name made safe, else ``<prefix>_<ext>_<offset>.<ext>``."""
    own = safe_name(name)
    return F.when(F.length(own) > 0, own).otherwise(F.concat(F.lit(f"{prefix}_"), extension, F.lit("_"), offset.cast("string"), F.lit("."), extension))


def image_name(serial: Column, day: Column) -> Column:
    """``<serial>_<yyyyMMdd>.img`` of letters and figures; ``disk`` without a serial."""
    clean = F.regexp_replace(F.coalesce(serial, F.lit("")), r"[^0-9A-Za-z]", "")
    return F.concat(F.when(F.length(clean) > 0, clean).otherwise("disk"), F.lit("_"), F.date_format(day, "yyyyMMdd"), F.lit(".img"))


# Groups of carved formats by extension.
GROUPS = {
    "Images": "jpg png gif bmp tif webp heic psd ico jp2 bpg xcf exr dpx pcx djvu", "RAW Photos": "arw cr2 cr3 nef orf rw2 raf pef sr2 dcr crw mrw x3f", "Video": "mp4 mov m4v 3gp avi mkv webm wmv flv mpg ts m2ts rm swf wtv",
    "Audio": "mp3 wav flac ogg m4a aac mid aif wv ape au", "Archives": "zip rar 7z gz xz bz2 tar cab lzh jar", "Documents": "pdf ole rtf xml html vcf ics epub odt msg eml chm indd cdr",
    "Databases": "db pst kdbx kdb h5 parquet fits", "Disk images": "vmdk vhd vhdx qcow2 vdi iso e01 aff luks", "Programs": "exe elf macho class dex pyc php sh",
}


def format_group(extension: Column) -> Column:
    table = {e: g for g, words in GROUPS.items() for e in words.split()}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.lower(extension)], F.lit("System"))
