"""One ranking from several scores on unlike scales: reciprocal rank fusion.

Every score is turned into ranks inside its query, so neither its range nor its distribution matters; an item's
total is the sum of 1 / (k + rank) over the scores it has.

Defined results
  * null, NaN and 0 are missing scores: the item is absent from that ranking and gets nothing from it
  * infinite scores are the first (or last) of their ranking, equal among themselves
  * equal values share the mean of their ranks, so a score that is equal throughout a query changes nothing
  * repeated (query, item) rows count once, with the largest value of each score
  * rows without query or item are left out; an empty table gives an empty ranking
  * equal totals (to 12 decimals) are ordered by item id
  * other columns are ignored, whatever their names

Scale: no window ever spans a whole query. Values are counted per (query, score, value) with map-side combine, then
ordered inside blocks of nearly equal magnitude (scores that span a few hundredths still fall into a thousand blocks), and
the blocks' counts (a bounded number per query) are summed up separately. A value that a hot query's rows share throughout
meets its rank in a join whose skewed side is split at run time (adaptive skew join). A query that holds a third of all rows is thereby ranked by many tasks, and the final cut to the first n
runs as a window group limit before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: scores that count alike; visual_z_score only restates visual_score
SCORES = ("semantic_score", "keyword_score", "combined_score", "visual_score", "category_score")
#: blocks a factor of two of a score's magnitude is divided into
BLOCKS_PER_OCTAVE = 1 << 14


LARGEST = 1.7976931348623157e308  # finite double


def _block(v):
    """Blocks keep the order of their values: all values of a lower block are smaller."""
    size = lambda x: F.floor(F.log2(F.least(x, F.lit(LARGEST))) * BLOCKS_PER_OCTAVE).cast("long") + F.when(x > LARGEST, 1).otherwise(0) + F.lit(1 << 28)
    return F.when(v > 0, size(v)).otherwise(-size(-v))


def rank_scores(df: DataFrame, query: str, item: str, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """(q, i, s, rank): mean rank of every present score within its query, 1 for the highest."""
    once = (
        df.select(F.col(query).alias("q"), F.col(item).alias("i"), *[F.col(c).cast("double").alias(f"s{k}") for k, c in enumerate(scores)])
        .where("q is not null and i is not null")
        .select("q", "i", *[F.when(~F.isnan(f"s{k}") & (F.col(f"s{k}") != 0), F.col(f"s{k}")).alias(f"s{k}") for k in range(len(scores))])
        .groupBy("q", "i")
        .agg(*[F.max(f"s{k}").alias(f"s{k}") for k in range(len(scores))])
    )
    long = once.select("q", "i", F.posexplode(F.array(*[f"s{k}" for k in range(len(scores))])).alias("s", "v")).where("v is not null")
    values = long.groupBy("q", "s", "v").agg(F.count("*").alias("c")).withColumn("b", _block(F.col("v")))
    above = Window.partitionBy("q", "s").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = values.groupBy("q", "s", "b").agg(F.sum("c").alias("n")).select("q", "s", "b", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    inside = Window.partitionBy("q", "s", "b").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        values.withColumn("inside", F.coalesce(F.sum("c").over(inside), F.lit(0)))
        .join(blocks, ["q", "s", "b"])
        .select("q", "s", "v", (F.col("above") + F.col("inside") + (F.col("c") + 1) / 2).alias("rank"))
    )
    return long.join(ranks, ["q", "s", "v"]).select("q", "i", "s", "rank")


def fuse_rankings(df: DataFrame, query: str, item: str, scores: tuple[str, ...] = SCORES, k: int = 60) -> DataFrame:
    """(query, item, fused): reciprocal rank fusion of ``scores``; items without any score get 0."""
    parts = rank_scores(df, query, item, scores).select("q", "i", (1 / (F.lit(float(k)) + F.col("rank"))).alias("part"))
    rest = df.select(F.col(query).alias("q"), F.col(item).alias("i"), F.lit(0.0).alias("part")).where("q is not null and i is not null")
    return (
        parts.unionByName(rest)
        .groupBy("q", "i")
        .agg(F.round(F.sum("part"), 12).alias("fused"))
        .select(F.col("q").alias(query), F.col("i").alias(item), "fused")
    )


def first_of_each(fused: DataFrame, query: str, item: str, n: int) -> DataFrame:
    """The first ``n`` items of each query with their position."""
    w = Window.partitionBy(query).orderBy(F.desc("fused"), F.col(item))
    return fused.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
