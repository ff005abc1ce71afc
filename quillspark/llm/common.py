"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import intermediate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that outlive any executor."""
    at = intermediate(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def computed_once(df: DataFrame) -> DataFrame:
    """``df`` behind an observed row count, which no filter passes.

    A filter on a computed column is otherwise pushed below the projections that make it: its expressions are then put
    into each other and evaluated several times for each row."""
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def partitions_of(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())
