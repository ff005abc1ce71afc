from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from ..operators import library


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def assets(spark: SparkSession, d: str) -> DataFrame:
    return library.latest_assets(table(spark, d, "assets"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["id"])


def jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stage_jobs").distinct()


#: the same in SQL
ASSETS = "a AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(indexed_at, TIMESTAMP '1970-01-01') DESC, status DESC) AS rn FROM assets) WHERE rn = 1)"
CHUNKS = "c AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM chunks) WHERE rn = 1)"
JOBS = "j AS (SELECT DISTINCT * FROM stage_jobs)"
