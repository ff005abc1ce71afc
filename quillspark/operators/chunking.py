"""Word windows, line groups, pages, image regions and asset texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CHUNK_OVERLAP, CHUNK_WORDS, GRID_ABOVE, GRID_TILE, MAX_REGIONS, REGIONAL_LEAST_CHARACTERS, REGIONAL_LINES, SLICE_FROM

SPACE = r"[ \t\n\x0B\f\r]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def window_count(n: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    return F.when(n > 0, 1 + F.ceil(F.greatest(n - size, F.lit(0)) / (size - overlap))).otherwise(0).cast("int")


def word_windows(df: DataFrame, key: list[str], text: str = "text", size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key.., chunk_index, text): windows of ``size`` words, each repeating the last ``overlap``; the last one reaches the end."""
    counted = df.where(F.col(text).isNotNull()).select(*key, words(F.col(text)).alias("w")).withColumn("n", window_count(F.size("w"), size, overlap)).where("n > 0")
    starts = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.array_join(F.slice("w", k * (size - overlap) + 1, size), " "))
    return counted.select(*key, F.posexplode(starts).alias("chunk_index", "text"))


def pages(df: DataFrame, key: list[str], pages_col: str = "pages") -> DataFrame:
    """One row for each page, numbered from 1."""
    return df.select(*key, F.posexplode(pages_col).alias("p", "text")).select(*key, (F.col("p") + 1).alias("page_number"), "text")


def line_groups(df: DataFrame, key: list[str], text: str = "text", step: int = REGIONAL_LINES, least: int = REGIONAL_LEAST_CHARACTERS) -> DataFrame:
    """Groups of ``step`` non-blank lines; none for texts of at most ``step`` lines; groups of few letters and digits are left out."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r\f\x0B]", " "))), lambda x: x != "")
    counted = df.where(F.col(text).isNotNull()).select(*key, lines.alias("l")).where(F.size("l") > step)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / step).cast("int")), lambda k: F.array_join(F.slice("l", k * step + 1, step), "\n"))
    return counted.select(*key, F.posexplode(groups).alias("group_index", "text")).where(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]+", "")) >= least)


def asset_texts(chunks: DataFrame) -> DataFrame:
    """(asset_id, text): the texts of an asset in reading order, one on each line."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "id", "text")))
    return chunks.where("text is not null").groupBy("asset_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def image_regions(df: DataFrame, key: str, width: str = "width", height: str = "height") -> DataFrame:
    """(key, region_id, kind, x, y, region_width, region_height): the whole image as -1, then tiles or slices as -2, -3, ..."""
    w, h = F.col(width).cast("int"), F.col(height).cast("int")
    long, short = F.greatest(w, h), F.least(w, h)
    cols, rows = F.ceil(w / GRID_TILE).cast("int"), F.ceil(h / GRID_TILE).cast("int")
    aspect = long / short
    n_slices = F.least(F.greatest(F.ceil(aspect / (8.0 / 3.0)).cast("int"), F.lit(2)), F.lit(11))
    box = lambda kind, x, y, a, b: F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"), a.cast("int").alias("region_width"), b.cast("int").alias("region_height"))
    grid = F.flatten(
        F.transform(
            F.sequence(F.lit(0), rows - 1),
            lambda r: F.transform(
                F.sequence(F.lit(0), cols - 1),
                lambda c: box("grid", F.floor(c * w / cols), F.floor(r * h / rows), F.floor((c + 1) * w / cols) - F.floor(c * w / cols), F.floor((r + 1) * h / rows) - F.floor(r * h / rows)),
            ),
        )
    )
    cut = lambda k: F.floor(k * long / n_slices)
    slices = F.transform(
        F.sequence(F.lit(0), n_slices - 1),
        lambda k: F.when(h >= w, box("aspect", F.lit(0), cut(k), w, cut(k + 1) - cut(k))).otherwise(box("aspect", cut(k), F.lit(0), cut(k + 1) - cut(k), h)),
    )
    none = F.slice(slices, 1, 0)
    extra = F.when(long > GRID_ABOVE, grid).when((long >= SLICE_FROM) & (aspect > 32.0 / 9.0), slices).otherwise(none)
    whole = F.array(box("whole", F.lit(0), F.lit(0), w, h))
    return (
        df.where((w > 0) & (h > 0))
        .select(key, F.posexplode(F.slice(F.concat(whole, extra), 1, MAX_REGIONS)).alias("k", "b"))
        .select(key, (-F.col("k") - 1).alias("region_id"), "b.*")
    )
