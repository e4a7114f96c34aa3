"""Profiles of file listings and comparison of recovered with source files.

A listing has ``name, size, is_dir, is_deleted``. Defined results: rows without a name are left out of
profiles by extension; a name without a dot counts as its own extension; null sizes count as 0; ties
are ordered by name and then by the remaining keys given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Categories of file extensions.
CATEGORIES = {
    "Images": "jpg jpeg png gif bmp tif tiff webp heic heif svg ico psd",
    "RAW Photos": "arw cr2 cr3 nef orf rw2 raf dng pef srw",
    "Videos": "mp4 mov avi mkv wmv flv m4v webm mpg mpeg 3gp ts",
    "Audio": "mp3 wav flac aac ogg m4a wma aiff opus mid",
    "Documents": "pdf doc docx xls xlsx ppt pptx txt rtf odt ods odp csv md html htm xml",
    "Archives": "zip rar 7z tar gz bz2 xz iso dmg cab",
    "Databases": "db sqlite mdb accdb pst ost sql",
    "System": "exe dll sys drv elf so evtx dat log cfg ini bak tmp",
}


def extension(name: Column) -> Column:
    return F.lower(F.substring_index(name, ".", -1))


def category(name: Column) -> Column:
    table = {e: c for c, words in CATEGORIES.items() for e in words.split()}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[extension(name)], F.lit("Other"))


def profile(listing: DataFrame) -> DataFrame:
    """Per category: live and deleted files and bytes."""
    files = listing.where("NOT is_dir AND name IS NOT NULL").withColumn("size", F.coalesce("size", F.lit(0)))
    live, gone = (~F.col("is_deleted")).cast("int"), F.col("is_deleted").cast("int")
    return files.groupBy(category(F.col("name")).alias("category")).agg(
        F.sum(live).alias("active_count"), F.sum(gone).alias("deleted_count"), F.sum(F.col("size") * live).alias("active_bytes"),
        F.sum(F.col("size") * gone).alias("deleted_bytes"), F.count("*").alias("total_count"),
    )


def drive_type(profiled: DataFrame) -> DataFrame:
    """One row: what a drive was used for, by the shares of file counts."""
    n = lambda *names: F.coalesce(F.sum(F.when(F.col("category").isin(*names), F.col("total_count"))), F.lit(0)) * 100 / F.sum("total_count")
    image, video, audio = n("Images", "RAW Photos"), n("Videos"), n("Audio")
    return profiled.agg(
        F.when(F.coalesce(F.sum("total_count"), F.lit(0)) == 0, "Empty").when(image > 50, "Photo").when(video > 40, "Video").when(audio > 40, "Audio")
        .when(n("System") > 40, "System").when(n("Documents") > 40, "Documents").when(image + video + audio > 50, "Media").otherwise("General").alias("drive_type"),
        F.coalesce(F.sum("total_count"), F.lit(0)).alias("n_files"),
    )


def extension_stats(listing: DataFrame, flag_bytes: int = 500 * 1024 * 1024) -> DataFrame:
    """Per extension: count, total, average (half to even), extremes and share of all bytes in percent."""
    files = listing.where("NOT is_dir AND name IS NOT NULL")
    per = files.groupBy(extension(F.col("name")).alias("ext")).agg(
        F.count("*").alias("n_files"), F.sum("size").alias("total_bytes"), F.bround(F.avg("size")).cast("long").alias("avg_bytes"),
        F.max("size").alias("max_bytes"), F.min("size").alias("min_bytes"),
    )
    total = per.agg(F.sum("total_bytes")).scalar()
    return per.select(
        "ext", "n_files", "total_bytes", "avg_bytes", "max_bytes", "min_bytes",
        F.round(F.col("total_bytes") * 100 / total, 1).alias("pct"), (F.col("max_bytes") > flag_bytes).alias("flagged"),
    )


def top_files(listing: DataFrame, n: int = 20) -> DataFrame:
    return listing.where("NOT is_dir AND name IS NOT NULL").orderBy(F.desc("size"), "name", "file_id").select("file_id", "name", "size").limit(n)


def large_by_extension(listing: DataFrame, threshold: int) -> DataFrame:
    return listing.where((~F.col("is_dir")) & (F.col("size") > threshold)).groupBy(extension(F.col("name")).alias("ext")).agg(F.count("*").alias("n_files"), F.sum("size").alias("total_bytes"))


def join_name_size(carved: DataFrame, source: DataFrame) -> DataFrame:
    """Carved files ``carved_id, name, size`` against source files ``source_id, name, size``.

    ``carved_id, verdict, source_id, delta``: ``matched`` on lower-case name and size, else ``mismatch``
    with the nearest size, else ``unrecognised``. Equal names are reduced per (name, size) before the join,
    so a name that a third of all files share doesn't multiply.
    """
    c = carved.select("carved_id", F.lower("name").alias("key"), F.col("size").alias("csize"))
    sizes = source.where("name IS NOT NULL").groupBy(F.lower("name").alias("key"), F.col("size").alias("ssize")).agg(F.min("source_id").alias("source_id"))
    exact = c.join(sizes, (c["key"] == sizes["key"]) & (c["csize"] == sizes["ssize"]), "left").select("carved_id", c["key"], "csize", "source_id")
    hit = exact.where("source_id IS NOT NULL").select("carved_id", F.lit("matched").alias("verdict"), "source_id", F.lit(0).cast("long").alias("delta"))
    # nearest size: the neighbours of each carved size among the sizes of its name
    rest = exact.where("source_id IS NULL").select("carved_id", "key", "csize")
    wanted = rest.select("key", F.col("csize").alias("size")).where("size IS NOT NULL").distinct().select("key", "size", F.lit(None).cast("long").alias("source_id"))
    both = wanted.unionByName(sizes.where("ssize IS NOT NULL").select("key", F.col("ssize").alias("size"), "source_id"))
    entry = F.when(F.col("source_id").isNotNull(), F.struct("size", "source_id"))
    below = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("key").orderBy("size").rowsBetween(0, Window.unboundedFollowing)
    near = both.withColumn("lo", F.last(entry, True).over(below)).withColumn("hi", F.first(entry, True).over(above)).where("source_id IS NULL")
    gap_lo, gap_hi = F.abs(F.col("size") - F.col("lo.size")), F.abs(F.col("hi.size") - F.col("size"))
    best = F.when(F.col("hi").isNull() | (F.col("lo").isNotNull() & (gap_lo <= gap_hi)), F.col("lo")).otherwise(F.col("hi"))
    near = near.select("key", F.col("size").alias("csize"), best.alias("b"))
    other = rest.join(near, ["key", "csize"], "left").select(
        "carved_id", F.when(F.col("b").isNotNull(), "mismatch").otherwise("unrecognised").alias("verdict"), F.col("b.source_id").alias("source_id"),
        (F.col("csize") - F.col("b.size")).alias("delta"),
    )
    return hit.unionByName(other)


def not_recovered(carved: DataFrame, source: DataFrame) -> DataFrame:
    """Source files whose name no carved file has."""
    names = carved.select(F.lower("name").alias("key")).where("key IS NOT NULL").distinct()
    return source.withColumn("key", F.lower("name")).join(names, "key", "left_anti").drop("key")


def join_hash(carved: DataFrame, source: DataFrame) -> DataFrame:
    """Carved ``carved_id, name, content`` against source ``source_id, name, content`` by SHA-256.

    ``carved_unreadable``; ``identical`` (the named source file); ``alt_source`` (another one);
    ``damaged`` (the named one differs); ``source_missing``.
    """
    c = carved.select("carved_id", F.lower("name").alias("key"), F.sha2("content", 256).alias("h"))
    s = source.select(F.lower("name").alias("key"), F.sha2("content", 256).alias("h"))
    same = s.where("key IS NOT NULL AND h IS NOT NULL").distinct().withColumn("same", F.lit(True))
    any_ = s.where("h IS NOT NULL").select("h").distinct().withColumn("anywhere", F.lit(True))
    named = s.where("key IS NOT NULL").select("key").distinct().withColumn("named", F.lit(True))
    verdict = (
        F.when(F.col("h").isNull(), "carved_unreadable").when(F.col("same"), "identical").when(F.col("anywhere"), "alt_source")
        .when(F.col("named"), "damaged").otherwise("source_missing")
    )
    return c.join(same, ["key", "h"], "left").join(any_, "h", "left").join(named, "key", "left").select("carved_id", verdict.alias("verdict"))


def join_metadata_index(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Hits ``hit_id, image_id, byte_offset`` with the first listed file that starts exactly there.

    ``index``: ``image_id, part_seq, entry_seq, abs_offset, name``.
    """
    first = index.groupBy("image_id", F.col("abs_offset").alias("byte_offset")).agg(F.min(F.struct("part_seq", "entry_seq", "name")).alias("f"))
    first = first.select("image_id", "byte_offset", "f.name")
    return hits.join(first, ["image_id", "byte_offset"], "left").select("hit_id", "image_id", "byte_offset", "name")
