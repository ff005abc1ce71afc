"""The library's catalogue: latest rows, roll-ups, copies, reconciliation with a new scan, removal, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import IMAGE_EXTENSIONS


def latest(df: DataFrame, key: list[str], by: list[Column]) -> DataFrame:
    """One row per key, the last by ``by``: an upsert as union and this. An aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    order = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(by)])
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, *[f"r.{c}" for c in rest]).select(*df.columns)


def latest_assets(assets: DataFrame) -> DataFrame:
    """The latest snapshot of each asset: by indexing time, never indexed ones first, then by status."""
    return latest(assets, ["id"], [F.coalesce("indexed_at", F.lit("1970-01-01").cast("timestamp")), F.col("status")])


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Only rows of ``new`` whose key is not there yet; of several with one key any one."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def is_image(ext: Column) -> Column:
    return F.lower(F.coalesce(ext, F.lit(""))).isin(*IMAGE_EXTENSIONS)


def matches(df: DataFrame, extensions: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """Available, indexed assets of a folder and of some extensions; a missing extension fails any extension filter."""
    out = df.where(F.col("available") & (F.col("status") == "indexed"))
    if folder is not None:
        out = out.where(F.col("folder_id") == folder)
    return out.where(F.lower("extension").isin(*[e.lower() for e in extensions])) if extensions else out


def briefs(assets: DataFrame, vectors: DataFrame) -> DataFrame:
    """Assets that can be shown: indexed ones, and any with a vector."""
    with_vector = vectors.select("asset_id").distinct().withColumn("has_vector", F.lit(True))
    return (
        assets.where("available")
        .join(with_vector, F.col("id") == F.col("asset_id"), "left")
        .where("status = 'indexed' or has_vector")
        .select("id", "filename", "extension", F.coalesce("content_id", "id").alias("content_id"), F.col("thumbnail_path").isNotNull().alias("thumbnail_available"))
    )


def folder_rollup(folders: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets per folder, available ones only; folders without any stay."""
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    per = assets.where("available").groupBy("folder_id").agg(F.count("*").alias("assets"), count(F.col("status") == "indexed").alias("indexed"), count(F.col("status").isin("pending", "processing")).alias("waiting"), count(F.col("status") == "failed").alias("failed"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("assets", "indexed", "waiting", "failed")]
    return folders.join(per, folders["id"] == per["folder_id"], "left").select(folders["id"], "path", "created_at", *zero)


def first_of_content(df: DataFrame, score: str, key: str = "id", content: str = "content_id") -> DataFrame:
    """The best row of each content, the smaller key among equals, one without a score last; adds how many other places it has. An aggregate, so copies combine before the shuffle."""
    rest = [c for c in df.columns if c != content]
    worst_last = F.when(F.col(score).isNull(), 1).otherwise(0)
    best = F.min_by(F.struct(*rest), F.struct(worst_last.alias("n"), (-F.col(score)).alias("s"), F.col(key).alias("k")))
    return df.groupBy(content).agg(best.alias("r"), (F.count("*") - 1).alias("other_places")).select(content, *[f"r.{c}" for c in rest], "other_places")


def reconcile(old: DataFrame, scan: DataFrame) -> DataFrame:
    """(absolute_path, change, id): what a complete new scan means for each path.

    new, unchanged, changed (other content, or not indexed), moved (a vanished file of the same folder and content takes
    the new path, the one indexed last first), missing."""
    o = old.select(F.col("id").alias("old_id"), "absolute_path", F.col("folder_id").alias("old_folder"), F.lower("sha256").alias("old_sha"), "status", "indexed_at")
    s = scan.select("absolute_path", F.col("folder_id").alias("new_folder"), F.lower("sha256").alias("new_sha"))
    both = o.join(s, "absolute_path", "full_outer")
    gone = both.where("new_sha is null and old_sha is not null").select("old_id", "old_folder", "old_sha", "indexed_at", "absolute_path")
    come = both.where("old_id is null").select("absolute_path", "new_folder", "new_sha")
    # the nth newcomer of a content takes the nth vanished file: each is used once
    g = gone.withColumn("n", F.row_number().over(Window.partitionBy("old_folder", "old_sha").orderBy(F.desc_nulls_last("indexed_at"), "old_id")))
    c = come.withColumn("n", F.row_number().over(Window.partitionBy("new_folder", "new_sha").orderBy("absolute_path")))
    moved = c.join(g.select("old_id", "old_folder", "old_sha", "n", F.col("absolute_path").alias("from_path")), (c["new_folder"] == g["old_folder"]) & (c["new_sha"] == g["old_sha"]) & (c["n"] == g["n"])).select("absolute_path", "from_path", "old_id")
    arrived = moved.select("absolute_path", F.col("old_id").alias("moved_id"))
    left = moved.select(F.col("from_path").alias("absolute_path"), F.lit(True).alias("left"))
    change = (
        F.when(F.col("moved_id").isNotNull(), "moved")
        .when(F.col("old_id").isNull(), "new")
        .when(F.col("new_folder").isNull(), "missing")
        .when((F.col("status") != "indexed") | ~F.col("old_sha").eqNullSafe(F.col("new_sha")), "changed")
        .otherwise("unchanged")
    )
    return (
        both.join(arrived, "absolute_path", "left")
        .join(left, "absolute_path", "left")
        .where("left is null")
        .select("absolute_path", change.alias("change"), F.coalesce("moved_id", "old_id", F.sha2("absolute_path", 256)).alias("id"))
    )


def remove_folder(assets: DataFrame, derived: dict[str, DataFrame], folder: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Tables without a folder's assets and everything made from them."""
    gone = assets.where(F.col("folder_id") == folder).select(F.col("id").alias("asset_id")).distinct()
    return assets.where(~F.col("folder_id").eqNullSafe(folder)), {k: t.join(gone, "asset_id", "left_anti") for k, t in derived.items()}


def stale_text(chunks: DataFrame, profile: str) -> DataFrame:
    """Chunks without a vector of the profile."""
    return chunks.where(F.col("embedding").isNull() | ~F.col("embedding_profile_id").eqNullSafe(profile))


def missing_outputs(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Outputs that should exist for a (asset, stage, model, version) and do not."""
    return expected.join(actual.select(*key).distinct(), key, "left_anti")


def recent(assets: DataFrame, n: int = 20) -> DataFrame:
    """By indexing time, else by modification; from 1 to 100 rows."""
    return assets.orderBy(F.coalesce("indexed_at", "modified_at").desc_nulls_last(), "id").limit(max(1, min(100, n)))


def status(assets: DataFrame, jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counters from one pass over each table."""
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    s, j = F.col("status"), F.col("state")
    a = assets.agg(F.count("*").alias("assets"), n(F.col("available"), "available"), n(s == "indexed", "indexed"), n(s == "failed", "failed_assets"), n(is_image(F.col("extension")), "images"))
    b = jobs.agg(F.count("*").alias("jobs"), *[n(j == x, f"jobs_{x}") for x in ("pending", "failed", "waiting_model", "cancelled")], F.max("reindex_generation").alias("generation"), F.count_distinct("asset_id").alias("assets_with_jobs"))
    c = chunks.agg(F.count("*").alias("chunks"), n(F.col("embedding").isNotNull(), "chunks_with_vector"), F.count_distinct("asset_id").alias("assets_with_chunks"))
    return a.crossJoin(b).crossJoin(c)  # one row each
