"""Control plane: schema versions, settings, vector spaces, model catalogue, prompt banks, provenance, vector codec."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from .library import insert_ignore, latest, upsert

SCHEMA_VERSION = 7
TABLES = {
    "folders": S.FOLDERS, "assets": S.ASSETS, "chunks": S.CHUNKS, "stage_jobs": S.STAGE_JOBS, "profiles": S.PROFILES, "image_embeddings": S.IMAGE_EMBEDDINGS,
    "regions": S.REGIONS, "visual_tags": S.VISUAL_TAGS, "entities": S.ENTITIES, "document_types": S.DOCUMENT_TYPES, "provenance": S.PROVENANCE,
}
#: (role, id, label, size in MB, dimensions)
MODELS = (
    ("ocr", "fast", "Fast", 12, None), ("ocr", "balanced", "Balanced", 7, None), ("ocr", "accurate", "Accurate", 27, None),
    ("text", "txt-small/v1", "Small text model", 91, 384), ("text", "txt-base/v3", "Base text model", 120, 64), ("text", "txt-wide/v1", "Wide text model", 190, 96),
    ("visual", "none", "No visual search", 0, None), ("visual", "vis-small", "Visual model", 290, 512),
)


def migrate(df: DataFrame, table: str) -> DataFrame:
    """A table of any earlier version in the current schema: missing columns are null, others keep name and order of the schema."""
    wanted = T._parse_datatype_string(TABLES[table])
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields])


def backfill_content(assets: DataFrame) -> DataFrame:
    """Assets without a content id get the hash's, or their own."""
    return assets.withColumn("content_id", F.coalesce("content_id", F.lower("sha256"), "id"))


def purge_orphans(derived: DataFrame, assets: DataFrame) -> DataFrame:
    """Rows whose asset is gone are dropped."""
    return derived.join(assets.select(F.col("id").alias("asset_id")).distinct(), "asset_id", "left_semi")


def setting(settings: DataFrame, key: str, default: str | None = None) -> str | None:
    row = settings.where(F.col("key") == key).select("value").first()
    return default if row is None else row["value"]


def set_settings(settings: DataFrame, values: dict[str, str]) -> DataFrame:
    new = settings.sparkSession.createDataFrame(list(values.items()), "key string, value string")
    return upsert(settings.select("key", "value"), new, ["key"])


def profile_id(model: str, chunking: str = "v3") -> str:
    return f"{model}/{chunking}"


def register(profiles: DataFrame, new: DataFrame) -> DataFrame:
    """Known profiles stay as they are."""
    return insert_ignore(profiles, new.select(*profiles.columns), ["id"])


def catalogue(spark: SparkSession, installed: tuple[str, ...] = ()) -> DataFrame:
    df = spark.createDataFrame(list(MODELS), "role string, id string, label string, size_mb int, dimensions int")
    return df.withColumn("installed", F.col("id").isin(*installed) if installed else F.lit(False))


def prompt_bank(spark: SparkSession, path: str, version: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Prompt vectors by version: read where they are, else built and written. A broken file is built anew."""
    at = f"{path}/version={version}"
    try:
        bank = spark.read.parquet(at)
        bank.limit(1).collect()
        return bank
    except Exception:  # missing, unreadable or of another shape
        build().write.mode("overwrite").parquet(at)
        return spark.read.parquet(at)


def provenance(outputs: DataFrame, stage: str, extractor: str, version: str) -> DataFrame:
    """One row to append for each produced output (asset_id, source_kind, source_index, confidence, stage_job_id)."""
    return migrate(outputs.withColumn("stage", F.lit(stage)).withColumn("extractor_id", F.lit(extractor)).withColumn("extractor_version", F.lit(version)).withColumn("created_at", F.current_timestamp()), "provenance")


def with_evidence_json(types: DataFrame) -> DataFrame:
    return types.withColumn("evidence_json", F.to_json("evidence")).drop("evidence")


def from_evidence_json(types: DataFrame) -> DataFrame:
    return types.withColumn("evidence", F.coalesce(F.from_json("evidence_json", "array<string>"), F.array().cast("array<string>"))).drop("evidence_json")


@F.pandas_udf(T.BinaryType())
def encode_vector(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))


def decode_valid(df: DataFrame, blob: str, dims: int, out: str = "embedding") -> DataFrame:
    """Adds the decoded vector, checked and of unit length, or null."""
    from ..functions.vectors import normalise

    return df.withColumn(out, decode_vector(F.col(blob))).withColumn(out, normalise(F.col(out), dims))


def newest_settings(log: DataFrame) -> DataFrame:
    """Settings from an append-only log (key, value, at)."""
    return latest(log, ["key"], [F.col("at")]).select("key", "value")


def manifest(root: str) -> str:
    """What a library's folder holds, as JSON."""
    return json.dumps({"root": root, "schema_version": SCHEMA_VERSION, "tables": sorted(TABLES)})
