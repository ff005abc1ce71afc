"""The work queue as tables: order of claims, retries, state changes, staleness plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ALWAYS_STAGES, MAX_ATTEMPTS, OTHER_ATTEMPTS, OTHER_PRIORITY, STAGE_PRIORITY


def priority(stage: Column) -> Column:
    out = F.lit(OTHER_PRIORITY)
    for name, value in STAGE_PRIORITY.items():
        out = F.when(stage == name, value).otherwise(out)
    return out


def max_attempts(stage: Column) -> Column:
    out = F.lit(OTHER_ATTEMPTS)
    for name, value in MAX_ATTEMPTS.items():
        out = F.when(stage == name, value).otherwise(out)
    return out


def claimable(jobs: DataFrame, assets: DataFrame) -> DataFrame:
    """Pending stage jobs of available assets; text stages need an indexed asset."""
    a = assets.select(F.col("id").alias("asset_id"), "available", "status").where("available")
    return jobs.where("state = 'pending'").join(a, "asset_id").where((F.col("status") == "indexed") | F.col("stage").isin(*ALWAYS_STAGES)).drop("available", "status")


def next_jobs(jobs: DataFrame, assets: DataFrame, n: int = 1) -> DataFrame:
    """The first ``n`` in the order of stages, then of creation."""
    return claimable(jobs, assets).withColumn("priority", priority(F.col("stage"))).orderBy("priority", "created_at", "id").limit(n)


def after_failure(jobs: DataFrame) -> DataFrame:
    """Adds ``next_state`` of failed attempts: pending while the stage's attempts last, then failed."""
    return jobs.withColumn("next_state", F.when(F.col("attempts") < max_attempts(F.col("stage")), "pending").otherwise("failed"))


def current(jobs: DataFrame) -> DataFrame:
    """The latest row of each (asset, stage, model, version)."""
    from .library import latest

    return latest(jobs, ["asset_id", "stage", "model_id", "pipeline_version"], [F.col("updated_at"), F.col("id")])


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Idempotent: a job that is there already starts again with no attempts and its new generation."""
    from .library import upsert

    key = ["asset_id", "stage", "model_id", "pipeline_version"]
    fresh = new.withColumn("state", F.lit("pending")).withColumn("attempts", F.lit(0)).withColumn("error_message", F.lit(None).cast("string"))
    return upsert(jobs, fresh.select(*jobs.columns), key)


def wake(jobs: DataFrame) -> DataFrame:
    """A model has come: waiting jobs become pending."""
    return jobs.withColumn("state", F.when(F.col("state") == "waiting_model", "pending").otherwise(F.col("state")))


def recover(jobs: DataFrame) -> DataFrame:
    """After a crash: what was being processed is pending again."""
    return jobs.withColumn("state", F.when(F.col("state") == "processing", "pending").otherwise(F.col("state")))


def progress(jobs: DataFrame) -> DataFrame:
    """Jobs per stage and state with the last change."""
    return jobs.groupBy("stage", "state").agg(F.count("*").alias("jobs"), F.sum("attempts").cast("long").alias("attempts"), F.max("updated_at").alias("last_update"))


def pipeline_status(jobs: DataFrame, asset: str) -> DataFrame:
    return jobs.where(F.col("asset_id") == asset).orderBy("updated_at", "stage")


def fold_events(events: DataFrame, key: str, kind: str, order: list[str], failure: str, success: str, most: int) -> DataFrame:
    """Final state of each key by its events in order: failures since the last success count against ``most``."""
    w = Window.partitionBy(key).orderBy(*order)
    runs = events.withColumn("run", F.sum(F.when(F.col(kind) == success, 1).otherwise(0)).over(w))
    last = F.max("run").over(Window.partitionBy(key))
    return (
        runs.withColumn("last", last)
        .groupBy(key)
        .agg(F.count(F.when((F.col("run") == F.col("last")) & (F.col(kind) == failure), 1)).alias("failures"), F.max("last").alias("successes"))
        .withColumn("state", F.when(F.col("failures") >= most, "failed").when(F.col("failures") > 0, "pending").when(F.col("successes") > 0, "indexed").otherwise("pending"))
    )


def reindex_plan(assets: DataFrame, old: dict[str, str], new: dict[str, str]) -> DataFrame:
    """(asset_id, stage, model_id) to run again after a change of models by role (ocr, text, visual)."""
    from .library import is_image

    live = assets.where("available").select(F.col("id").alias("asset_id"), "extension")
    out = live.select("asset_id", F.lit("").alias("stage"), F.lit("").alias("model_id")).where("false")
    for role, stage, only in (("ocr", "index", is_image(F.col("extension"))), ("text", "text_embedding", F.lit(True)), ("visual", "visual", is_image(F.col("extension")))):
        if old.get(role) != new.get(role):
            out = out.unionByName(live.where(only).select("asset_id", F.lit(stage).alias("stage"), F.lit(new.get(role)).alias("model_id")))
    return out
