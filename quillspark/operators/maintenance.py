"""Changes to derived tables and jobs: generated and replaced chunks, claims and transitions, sweeps, reset, stored outputs.

Every operator takes tables and gives the new table; nothing is updated in place. Writing by ``save`` replaces whole
partitions, so a repeated run leaves the same files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .library import is_image, upsert

SOURCE_JOBS = "id string, asset_id string, stage string, state string, attempts int, error_message string, created_at timestamp, updated_at timestamp"
#: which state a job may go to by which event; other pairs leave it as it is
TRANSITIONS = (
    ("pending", "start", "processing"), ("processing", "complete", "indexed"), ("processing", "fail", "failed"), ("processing", "wait", "waiting_model"),
    ("pending", "cancel", "cancelled"), ("processing", "cancel", "cancelled"), ("waiting_model", "cancel", "cancelled"), ("failed", "cancel", "cancelled"),
    ("failed", "retry", "pending"), ("waiting_model", "wake", "pending"), ("processing", "recover", "pending"),
)


# -- chunks
def next_index(chunks: DataFrame) -> DataFrame:
    """(asset_id, next_index): one more than the greatest index of each asset; assets without chunks are absent and begin at 0."""
    return chunks.groupBy("asset_id").agg((F.coalesce(F.max("chunk_index"), F.lit(-1)) + 1).alias("next_index"))


def append_chunks(chunks: DataFrame, new: DataFrame, order: str = "id") -> DataFrame:
    """``new`` (columns of chunks) behind the chunks of its assets, numbered on in the order of ``order``; blank texts are left out."""
    real = new.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    at = F.row_number().over(Window.partitionBy("asset_id").orderBy(order)) - 1
    numbered = real.withColumn("_n", at).join(next_index(chunks), "asset_id", "left").withColumn("chunk_index", (F.coalesce("next_index", F.lit(0)) + F.col("_n")).cast("int"))
    return chunks.unionByName(numbered.select(*chunks.columns))


def upsert_generated(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """One generated chunk for each (asset, source) of ``new``: it replaces the one that is there, keeping its index; a blank
    text deletes it; where there is none it comes behind the asset's last chunk."""
    key = ["asset_id", "source"]
    places = chunks.where(F.col("source").isNotNull()).groupBy(*key).agg(F.min("chunk_index").alias("_old"))
    kept = chunks.join(new.select(*key).distinct(), key, "left_anti").select(*chunks.columns)
    real = new.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(places, key, "left")
    fresh = real.where("_old is null").drop("_old")
    replaced = real.where("_old is not null").withColumn("chunk_index", F.col("_old")).select(*chunks.columns)
    # indexes go on behind all the asset had, also behind what is deleted here
    at = F.row_number().over(Window.partitionBy("asset_id").orderBy("source")) - 1
    numbered = fresh.withColumn("_n", at).join(next_index(chunks), "asset_id", "left").withColumn("chunk_index", (F.coalesce("next_index", F.lit(0)) + F.col("_n")).cast("int"))
    return kept.unionByName(replaced).unionByName(numbered.select(*chunks.columns))


def replace_chunks(chunks: DataFrame, new: DataFrame, assets: DataFrame) -> DataFrame:
    """All chunks of ``assets`` (asset_id) are replaced by those of ``new``; an asset without new ones has none."""
    return chunks.join(assets.select("asset_id").distinct(), "asset_id", "left_anti").select(*chunks.columns).unionByName(new.select(*chunks.columns))


# -- jobs
def all_jobs(source_jobs: DataFrame, stage_jobs: DataFrame) -> DataFrame:
    """(kind, id, asset_id, stage, state, attempts, error_message, created_at, updated_at) of both job tables."""
    cols = ["id", "asset_id", "stage", "state", "attempts", "error_message", "created_at", "updated_at"]
    return source_jobs.select(F.lit("source").alias("kind"), *cols).unionByName(stage_jobs.select(F.lit("stage").alias("kind"), *cols))


def active_counts(jobs: DataFrame) -> DataFrame:
    """(kind, active_assets, active_jobs, retrying): what is pending or being processed, by kind of job."""
    live = jobs.where(F.col("state").isin("pending", "processing"))
    return live.groupBy("kind").agg(F.count_distinct("asset_id").alias("active_assets"), F.count("*").alias("active_jobs"), F.count(F.when(F.col("attempts") > 0, 1)).alias("retrying"))


def current_file(jobs: DataFrame, assets: DataFrame) -> DataFrame:
    """(kind, filename): the file of the job that was touched last among those being processed, one row at most for each kind."""
    now = jobs.where("state = 'processing'").groupBy("kind").agg(F.max_by("asset_id", F.struct("updated_at", "id")).alias("asset_id"))
    return now.join(assets.select(F.col("id").alias("asset_id"), "filename"), "asset_id").select("kind", "filename")


def claim(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The first ``n`` pending jobs in the order they came, as they are once claimed: in process, one more attempt."""
    first = jobs.where("state = 'pending'").orderBy("created_at", "id").limit(n)
    return first.withColumn("state", F.lit("processing")).withColumn("attempts", F.col("attempts") + 1)


def transition(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs after one event each (id, event, message, at). Events that a job's state does not allow change nothing; a
    failure keeps its message, a retry forgets attempts and message."""
    spark = jobs.sparkSession
    rules = spark.createDataFrame(list(TRANSITIONS), "state string, event string, next_state string")
    one = events.groupBy("id").agg(F.max_by(F.struct("event", "message", "at"), "at").alias("e")).select("id", F.col("e.event").alias("_event"), F.col("e.message").alias("_message"), F.col("e.at").alias("_at"))
    met = jobs.join(one, "id", "left").join(F.broadcast(rules.withColumnRenamed("event", "_event")), ["state", "_event"], "left")  # a fixed table
    moved = F.col("next_state").isNotNull()
    changed = {
        "state": F.coalesce("next_state", "state"),
        "attempts": F.when(moved & (F.col("_event") == "retry"), 0).when(moved & (F.col("_event") == "start"), F.col("attempts") + 1).otherwise(F.col("attempts")),
        "error_message": F.when(~moved, F.col("error_message")).when(F.col("_event") == "fail", F.col("_message")).when(F.col("_event").isin("retry", "complete"), F.lit(None)).otherwise(F.col("error_message")),
        "updated_at": F.when(moved, F.greatest("_at", "updated_at")).otherwise(F.col("updated_at")),
    }
    return met.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in jobs.columns])


def cancel_for_missing(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Open jobs of files that a reconciliation (id, change) found missing are cancelled."""
    gone = changes.where("change = 'missing'").select(F.col("id").alias("asset_id")).distinct().withColumn("_gone", F.lit(True))
    state = F.when(F.col("_gone") & F.col("state").isin("pending", "processing", "waiting_model"), "cancelled").otherwise(F.col("state"))
    return jobs.join(gone, "asset_id", "left").withColumn("state", state).select(*jobs.columns)


def invalidate(derived: DataFrame, changes: DataFrame) -> DataFrame:
    """Derived rows (asset_id) without those of files whose content changed."""
    return derived.join(changes.where("change = 'changed'").select(F.col("id").alias("asset_id")).distinct(), "asset_id", "left_anti").select(*derived.columns)


def clear_vectors(chunks: DataFrame, profile: str) -> DataFrame:
    """A text reindex: vectors of other profiles become null, so that no search mixes spaces."""
    other = ~F.col("embedding_profile_id").eqNullSafe(profile)
    return chunks.select(*[F.when(~other, F.col(c)).alias(c) if c.startswith("embedding") else F.col(c) for c in chunks.columns])


# -- sweeps
def images_without_tags(assets: DataFrame, tags: DataFrame, model: str, version: str) -> DataFrame:
    """(asset_id) of available, indexed images without a tag of the model and version."""
    live = assets.where(F.col("available") & (F.col("status") == "indexed") & is_image(F.col("extension"))).select(F.col("id").alias("asset_id"))
    return live.join(tags.where((F.col("model_id") == model) & (F.col("model_version") == version)).select("asset_id").distinct(), "asset_id", "left_anti")


def vectors_without_categories(vectors: DataFrame, assets: DataFrame, categories: DataFrame) -> DataFrame:
    """(asset_id) of available assets with a vector and no category, each once."""
    have = vectors.select("asset_id").distinct().join(assets.where("available").select(F.col("id").alias("asset_id")), "asset_id")
    return have.join(categories.select("asset_id").distinct(), "asset_id", "left_anti")


def compatible(vectors: DataFrame, assets: DataFrame, profile: str, dims: int) -> DataFrame:
    """Vectors of a profile and length that belong to available assets."""
    fit = vectors.where((F.col("embedding_profile_id") == profile) & (F.col("embedding_dimensions") == dims) & (F.size("embedding") == dims))
    return fit.join(assets.where("available").select(F.col("id").alias("asset_id")), "asset_id", "left_semi")


# -- stored outputs
def buckets(key: Column, n: int = 64) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def save(df: DataFrame, path: str, key: str = "asset_id", n: int = 64) -> None:
    """Writes a derived table by buckets of its key; the buckets that ``df`` touches are replaced, others stay."""
    spread = df.withColumn("bucket", buckets(F.col(key), n)).repartition("bucket")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def merge_save(spark: SparkSession, new: DataFrame, path: str, unique: list[str], key: str = "asset_id", n: int = 64) -> None:
    """Rows of ``new`` replace those of the stored table with the same ``unique`` key; only buckets with new rows are rewritten."""
    touched = [r["b"] for r in new.select(buckets(F.col(key), n).alias("b")).distinct().collect()]  # at most n numbers
    try:
        old = spark.read.parquet(path).where(F.col("bucket").isin(*touched)).drop("bucket")
    except Exception as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return save(new, path, key, n)
    merged = upsert(old.select(*new.columns), new, unique)
    aside = f"{path.rstrip('/')}.new"
    save(merged, aside, key, n)  # a table cannot be read and replaced in one step
    save(spark.read.schema(merged.schema).parquet(aside), path, key, n)


def reset(spark: SparkSession, root: str, tables: tuple[str, ...], confirm: str) -> list[str]:
    """Deletes the named tables of a library. ``confirm`` must repeat the root, and the root must hold a manifest."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    fs = paths(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if confirm != root or not fs.exists(paths(f"{root}/manifest.json")):
        raise ValueError("not a library, or not confirmed")
    return [t for t in tables if "/" not in t and fs.exists(paths(f"{root}/{t}")) and fs.delete(paths(f"{root}/{t}"), True)]
