"""Vector search, region roll-up, robust scores, prototypes, tags."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAD_FLOOR, MAD_SCALE, MCUT_FLOOR
from ..functions.vectors import blend_best_two, dot, dot_unrolled, norm

DIGITS = 6


QUERY_BLOCK = 4096  # queries that are held by a task at once


def cosine_scores(vectors: DataFrame, key: str, vector: str, queries: DataFrame) -> DataFrame:
    """(query_id, key, score) of every vector for each query (query_id, q) of a batch; 0 for empty vectors and zero norms.

    One matrix product for each batch of vectors and each block of queries (``_cosine_blocks``)."""
    return _cosine_blocks(vectors, key, vector, queries, None)


def top_by_cosine(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score, rank) of the k most similar vectors for each query (query_id, q), the smaller key among equals.

    Exact scan; every task keeps its own k best for each query before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return _cosine_blocks(vectors, key, vector, queries, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _cosine_blocks(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int | None) -> DataFrame:
    """Queries are collected in blocks of QUERY_BLOCK rows, whatever their number; each block is one pass over the vectors."""
    spark = vectors.sparkSession
    kinds = dict(queries.dtypes)["query_id"], vectors.select(key).schema[0].dataType.simpleString()
    schema = f"query_id {kinds[0]}, key {kinds[1]}, score double"
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))

    def scan(shared):
        def run(batches):
            ids, q = shared.value
            nq = np.linalg.norm(q, axis=1)
            for batch in batches:
                v = batch.column(1)
                sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
                scores = np.zeros((len(ids), len(sizes)))
                fit = np.flatnonzero(sizes == q.shape[1])
                if len(fit) and q.shape[1]:
                    x = np.nan_to_num(v.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False), nan=0.0, posinf=0.0, neginf=0.0).reshape(len(fit), -1)
                    n = nq[:, None] * np.linalg.norm(x, axis=1)[None, :]
                    scores[:, fit] = np.round(np.divide(q @ x.T, n, out=np.zeros(n.shape), where=n > 0), DIGITS)
                if k is not None and len(sizes) > k:
                    edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                    r, c = np.nonzero(scores >= edge[:, None])  # ties at the edge stay
                else:
                    r, c = np.indices(scores.shape).reshape(2, -1)
                at = pa.array(c)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), batch.column(0).take(at), pa.array(scores[r, c])], ["query_id", "key", "score"])

        return run

    numbered = queries.select("query_id", F.col("q").cast("array<double>").alias("q"))
    held = numbered.toArrow()  # a batch of queries; a larger one is several passes, each of a block of bounded size
    out = None
    sizes = pc.fill_null(pc.list_value_length(held.column("q")), 0).to_numpy()
    for dims in np.unique(sizes):
        own = np.flatnonzero(sizes == dims)
        for a in range(0, len(own), QUERY_BLOCK):
            part = held.take(pa.array(own[a : a + QUERY_BLOCK]))
            q = part.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, int(dims))
            block = rows.mapInArrow(scan(spark.sparkContext.broadcast((part.column("query_id").combine_chunks(), q))), schema)
            out = block if out is None else out.unionByName(block)
    if out is None:
        out = rows.select(F.lit(None).cast(kinds[0]).alias("query_id"), "key", F.lit(0.0).alias("score")).where("false")
    return out.withColumnRenamed("key", key)


def unit(vectors: DataFrame, key: str, vector: str, dims: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Unit vectors as double arrays; unusable ones are left out."""
    from ..functions.vectors import normalise

    return vectors.select(key, *keep, normalise(F.col(vector), dims).alias("u")).where("u is not null")


def roll_up(scores: DataFrame, parent: str, region: str, score: str) -> DataFrame:
    """(parent, score, region): blend of a parent's two best regions, and the region of the best (the greater id among equals)."""
    best = F.max(F.struct(F.col(score), F.col(region)))
    return (
        scores.where(~F.isnan(score) & F.col(score).isNotNull())
        .groupBy(parent)
        .agg(blend_best_two(F.slice(F.sort_array(F.collect_list(score), asc=False), 1, 2)).alias("blend"), best.alias("b"))
        .select(parent, F.round("blend", DIGITS).alias("score"), F.col(f"b.{region}").alias("best_region"))
    )


def exact_median(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """(by.., out): the exact median of each group.

    Values are counted first (which combines before the shuffle) and then in blocks of nearly equal magnitude; only the
    one or two blocks that hold the middle are put in order, so no task holds a whole group."""
    own, v = F.col(value), F.col("v")
    rank = F.when(v == 0, 0).when(v > 0, F.floor(F.log2(v) * 256) + (1 << 22)).otherwise(-(F.floor(F.log2(-v) * 256) + (1 << 22)))
    counts = df.where(own.isNotNull() & ~F.isnan(own)).groupBy(*by, own.alias("v")).agg(F.count("*").alias("c")).withColumn("b", rank.cast("long"))
    blocks = counts.groupBy(*by, "b").agg(F.sum("c").alias("n"))
    upto = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocks.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    middle = placed.where((F.col("upto") >= low) & (F.col("upto") - F.col("n") < high)).select(*by, "b", "total", (F.col("upto") - F.col("n")).alias("before"))
    inside = Window.partitionBy(*by, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.join(middle, [*by, "b"]).withColumn("at", F.col("before") + F.sum("c").over(inside))
    hit = lambda k: F.min(F.when(F.col("at") >= k, F.col("v")))
    return rows.groupBy(*by).agg(((hit(low) + hit(high)) / 2).alias(out))


def robust_z(df: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``z``: distance from the group's median (of all without ``by``) in scaled median deviations, floored so that near-constant scores stay quiet."""
    own = list(by or [])
    keyed = df if own else df.withColumn("_all", F.lit(0))
    keys = own or ["_all"]
    with_med = keyed.join(exact_median(keyed, keys, score, "med"), keys, "left")
    mad = exact_median(with_med.withColumn("_away", F.abs(F.col(score) - F.col("med"))), keys, "_away", "mad")
    return with_med.join(mad, keys, "left").withColumn("z", F.round((F.col(score) - F.col("med")) / F.greatest(F.col("mad") * MAD_SCALE, F.lit(MAD_FLOOR)), 4)).drop("med", "mad", "_all")


def prototypes(vectors: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """(label, p): mean vector of each label; averages combine before the shuffle."""
    from ..functions.vectors import mean_vector

    return vectors.groupBy(label).agg(mean_vector(vector, dims).alias("p"))


def label_scores(vectors: DataFrame, key: str, vector: str, bank: DataFrame, dims: int) -> DataFrame:
    """(key, label, score): best similarity to any prompt of each label. ``bank``: (label, p), a fixed small set of prompts."""
    pairs = vectors.select(key, F.col(vector).alias("v")).crossJoin(F.broadcast(bank.select(F.col("label").alias("bank_label"), "p")))
    return pairs.groupBy(key, F.col("bank_label").alias("label")).agg(F.round(F.max(dot_unrolled("v", "p", dims)), DIGITS).alias("score"))


def top_labels(scores: DataFrame, key: str, k: int = 5) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("score"), "label")
    return scores.withColumn("rank", (F.row_number().over(w) - 1).cast("int")).where(F.col("rank") < k)


def category_margin(scores: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Best score inside the set less the best outside, both at least 0."""
    inside = F.col("label").isin(*wanted)
    zero = lambda c: F.greatest(F.coalesce(F.max(c), F.lit(0.0)), F.lit(0.0))
    return scores.groupBy(key).agg(F.round(zero(F.when(inside, F.col("score"))) - zero(F.when(~inside, F.col("score"))), DIGITS).alias("margin"))


def mcut(scores: DataFrame, key: str, score: str) -> DataFrame:
    """(key, threshold): middle of the widest gap between neighbouring scores, the first of equal gaps from the top; at least 0.2."""
    values = F.sort_array(F.collect_list(score), asc=False)
    gaps = F.transform(F.sequence(F.lit(1), F.size("v") - 1), lambda i: F.struct((F.element_at("v", i) - F.element_at("v", i + 1)).alias("gap"), (-i).alias("i"), ((F.element_at("v", i) + F.element_at("v", i + 1)) / 2).alias("mid")))
    return (
        scores.groupBy(key)
        .agg(values.alias("v"))
        .select(key, F.round(F.when(F.size("v") < 2, MCUT_FLOOR).otherwise(F.greatest(F.array_max(gaps)["mid"], F.lit(MCUT_FLOOR))), DIGITS).alias("threshold"))
    )


def tag_probability(raw: Column) -> Column:
    """Values in [0, 1] are probabilities; others are logits."""
    return F.when((raw >= 0) & (raw <= 1), raw).otherwise(1 / (1 + F.exp(-raw)))


def best_tags(tags: DataFrame, asset: str, k: int = 20) -> DataFrame:
    """Best tag of each normalised label of an asset, ranked by confidence."""
    best = F.max(F.struct("confidence", F.struct("label")))
    once = tags.groupBy(asset, "normalized_label").agg(best.alias("b")).select(asset, "normalized_label", F.col("b.confidence").alias("confidence"), F.col("b.col2.label").alias("label"))
    w = Window.partitionBy(asset).orderBy(F.desc("confidence"), "normalized_label")
    return once.withColumn("rank", (F.row_number().over(w) - 1).cast("int")).where(F.col("rank") < k)


def visual_scores(regions: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, asset_id, score, best_region, z): region vectors (asset_id, region_id, embedding) against each query (query_id, q).

    A query may have several vectors, one for each prompt; a region's score is its best one, at least 0. An asset's score is
    the blend of its two best regions; z is the score's place among all assets of the query."""
    keyed = regions.select(F.struct("asset_id", "region_id").alias("at"), "embedding")
    each = cosine_scores(keyed, "at", "embedding", queries).select("query_id", "at.asset_id", "at.region_id", "score")
    scores = each.groupBy("query_id", "asset_id", "region_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    # the two best without collecting a list: the best, and the best of the rest
    w = Window.partitionBy("query_id", "asset_id").orderBy(F.desc("score"), F.desc("region_id"))
    two = scores.withColumn("n", F.row_number().over(w)).where("n <= 2")
    blend = two.groupBy("query_id", "asset_id").agg(F.max(F.struct("score", "region_id")).alias("b"), F.min("score").alias("second"))
    rolled = blend.select("query_id", "asset_id", F.round(0.8 * F.col("b.score") + 0.2 * F.col("second"), DIGITS).alias("score"), F.col("b.region_id").alias("best_region"))
    return robust_z(rolled, "score", ["query_id"]).select("query_id", "asset_id", "score", "best_region", "z")


def best_region_labels(scores: DataFrame, asset: str) -> DataFrame:
    """(asset, label, score): the best of an asset's regions for each label."""
    return scores.groupBy(asset, "label").agg(F.max("score").alias("score"))


def label_scores_best_two(vectors: DataFrame, key: str, vector: str, bank: DataFrame, dims: int) -> DataFrame:
    """(key, label, score): mean of a label's two best prompts (of one, where it has only one)."""
    dots = _dots(vectors, key, vector, bank.select("label", F.col("p").alias("q")), dims)
    w = Window.partitionBy(key, "label").orderBy(F.desc("score"))
    return dots.withColumn("n", F.row_number().over(w)).where("n <= 2").groupBy(key, "label").agg(F.round(F.avg("score"), DIGITS).alias("score"))


def _dots(vectors: DataFrame, key: str, vector: str, bank: DataFrame, dims: int) -> DataFrame:
    """(key, label, score) of every prompt of a bank (label, q)."""
    pairs = vectors.select(key, F.col(vector).alias("v")).crossJoin(F.broadcast(bank.select(F.col("label").alias("label"), F.col("q").alias("p"))))  # a fixed bank
    return pairs.select(key, "label", dot_unrolled("v", "p", dims).alias("score"))


def tagger_rules(raw: DataFrame, key: str, k: int = 20) -> DataFrame:
    """(key, namespace, label, confidence, rank) from raw outputs (key, namespace, label, raw): probabilities at or above the
    cut of their namespace, without ratings, the first ``k`` of each key."""
    tags = raw.where("namespace <> 'rating'").select(key, "namespace", "label", F.round(tag_probability(F.col("raw")), DIGITS).alias("confidence"))
    cut = mcut(tags.withColumn("_key", F.struct(key, "namespace")), "_key", "confidence").select(f"_key.{key}", "_key.namespace", "threshold")
    kept = tags.join(cut, [key, "namespace"]).where(F.col("confidence") >= F.col("threshold"))
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), "label")
    return kept.withColumn("rank", (F.row_number().over(w) - 1).cast("int")).where(F.col("rank") < k).drop("threshold")
