"""Relevance figures of ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(ranked: DataFrame, labels: DataFrame, relevant_from: int = 2) -> DataFrame:
    """Per query with labels: precision at 1, 5 and 10, recall at 10, reciprocal rank. ``ranked``: (query_id, asset_id, position)."""
    good = labels.where(F.col("relevance") >= relevant_from).select("query_id", "asset_id").distinct()
    total = good.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = ranked.join(good, ["query_id", "asset_id"]).groupBy("query_id").agg(*[F.count(F.when(F.col("position") <= k, 1)).alias(f"h{k}") for k in (1, 5, 10)], F.min("position").alias("first"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return total.join(hits, "query_id", "left").select(
        "query_id",
        "relevant",
        *[F.round(zero(f"h{k}") / k, 6).alias(f"precision_{k}") for k in (1, 5, 10)],
        F.round(zero("h10") / F.col("relevant"), 6).alias("recall_10"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Jaccard similarity of the first k of two rankings per query."""
    x, y = (d.where(F.col("position") <= k).groupBy("query_id").agg(F.collect_set("asset_id").alias(n)) for d, n in ((a, "x"), (b, "y")))
    return x.join(y, "query_id").select("query_id", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))
