"""File sources: directory scan, pruning, type detection, hashing and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import EXCLUDED_DIRECTORIES, EXTENSIONS, MAX_BYTES, MIME_TYPES


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` (path, modificationTime, length, content); symbolic links and unreadable files as Spark's reader treats them.

    ``content`` is null for files that are not kept or too large: they are listed without being opened, as the reader takes
    limits on ``length`` and reads bytes only where the column is asked for. The reader passes over files without bytes, so
    these come as missing rather than as skipped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = reader.load(root).select("path", "modificationTime", "length")
    small = F.col("length") <= MAX_BYTES
    wanted = is_kept(F.regexp_replace("path", r"^[a-z]+:/*", "/"), F.lit(root)) & (extension(filename(F.col("path"))).isNull() | extension(filename(F.col("path"))).isin(*EXTENSIONS))
    opened = reader.load(root).where(small & wanted)
    return opened.select("path", "modificationTime", "length", "content").unionByName(listed.where(~(small & wanted)).withColumn("content", F.lit(None).cast("binary")))


def parts(path: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(path, r"^[a-z]+:/*", "/"), "[/\\\\]+"), lambda p: p != "")


def is_kept(path: Column, root: Column) -> Column:
    """Neither a hidden nor an excluded directory lies between the root and the file; the root itself always counts."""
    below = F.slice(parts(path), F.size(parts(root)) + 1, F.greatest(F.size(parts(path)) - F.size(parts(root)), F.lit(0)))
    excluded = F.array(*[F.lit(d) for d in EXCLUDED_DIRECTORIES])
    return ~F.exists(below, lambda p: p.startswith(".") | F.array_contains(excluded, F.lower(p)))


def is_inside(path: Column, root: Column) -> Column:
    """By path components, not by characters; a path that climbs out is outside."""
    a, b = parts(path), parts(root)
    return (F.slice(a, 1, F.greatest(F.size(b), F.lit(1))) == b) & ~F.exists(a, lambda p: p == "..")


def filename(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def extension(name: Column) -> Column:
    """Lower case; null without one. A leading dot alone makes no extension."""
    return F.lower(F.nullif(F.regexp_extract(name, r"^.+\.([^.]*)$", 1), F.lit("")))


def sniff_image(content: Column) -> Column:
    """Image type by the first bytes, or null."""
    head = lambda a, n: F.hex(F.substring(content, a, n))
    return (
        F.when(head(1, 8) == "89504E470D0A1A0A", "png")
        .when(head(1, 3) == "FFD8FF", "jpg")
        .when(head(1, 6).isin("474946383761", "474946383961"), "gif")
        .when(head(1, 2) == "424D", "bmp")
        .when(head(1, 4).isin("49492A00", "4D4D002A"), "tif")
        .when((head(1, 4) == "52494646") & (head(9, 4) == "57454250"), "webp")
    )


def supported_type(name: Column, content: Column) -> Column:
    """The extension if it is one of ours; without any, what the content says; else null."""
    ext = extension(name)
    return F.when(ext.isNull(), sniff_image(content)).when(ext.isin(*EXTENSIONS), ext)


def mime_type(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])
    return F.coalesce(F.get(F.array(F.try_element_at(table, F.lower(ext))), F.lit(0)), F.lit("application/octet-stream"))


def size_state(length: Column) -> Column:
    """Why a file is skipped by its size, or null."""
    return F.when(length == 0, "empty").when(length > MAX_BYTES, "too large")


def decode_text(content: Column) -> Column:
    """UTF-8; bytes that are none become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def as_assets(files: DataFrame, root: str) -> DataFrame:
    """Catalogue rows of a scan with deterministic ids."""
    path = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    kind = supported_type(filename(path), F.col("content"))
    return (
        files.where(is_kept(path, F.lit(root)))
        .withColumn("extension", kind)
        .where("extension is not null")
        .select(
            F.sha2(path, 256).alias("id"),
            F.sha2(F.lit(root), 256).alias("folder_id"),
            path.alias("absolute_path"),
            F.array_join(F.slice(parts(path), F.size(parts(F.lit(root))) + 1, F.size(parts(path))), "/").alias("relative_path"),
            filename(path).alias("filename"),
            "extension",
            mime_type(F.col("extension")).alias("mime_type"),
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("modified_at"),
            F.sha2("content", 256).alias("sha256"),
            F.when(size_state(F.col("length")).isNotNull(), "skipped").otherwise("pending").alias("status"),
            size_state(F.col("length")).alias("error_message"),
            F.when(F.col("extension").isin("txt", "md") & size_state(F.col("length")).isNull(), decode_text(F.col("content"))).alias("text"),
        )
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Tag labels (name, category) from CSV with a header: label, namespace."""
    rows = spark.read.csv(path, header=True, schema=None)
    namespace = F.when(F.col("category").cast("int") == 9, "rating").when(F.col("category").cast("int") == 4, "character").otherwise("general")
    return rows.select(F.translate("name", "_", " ").alias("label"), namespace.alias("namespace"))
