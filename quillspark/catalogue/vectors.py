"""Vector search, regions, robust scores, prototypes, tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine, normalise
from ..operators import similarity as V
from .common import table

Q: dict = {}
O: dict = {}  # noqa: E741
DIMS = 64


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def _e(spark, d):
    return table(spark, d, "embeddings")


_COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


@query(
    f"""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id, round({_COS.format(a='embedding', b='q')}, 6) AS score FROM embeddings, q)
    SELECT query_id, vec_id, score, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 10"""
)
def cosine_topk(spark, d):
    """The ten nearest of every twentieth vector, among all."""
    e = _e(spark, d)
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return V.top_by_cosine(e, "vec_id", "embedding", queries, 10).select("query_id", "vec_id", "score", "rank")


@query(
    """WITH n AS (SELECT id, embedding::DOUBLE[] AS e, embedding_dimensions AS d FROM (SELECT DISTINCT id, embedding, embedding_dimensions FROM chunks) WHERE embedding IS NOT NULL),
    v AS (SELECT id, e, len(e) = d AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS ok FROM n)
    SELECT id, ok AND list_sum(list_transform(e, lambda x: x * x)) > 1.1920929e-07 AS valid,
    CASE WHEN ok AND list_sum(list_transform(e, lambda x: x * x)) > 1.1920929e-07 THEN round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) END AS first FROM v"""
)
def vector_validate_normalize(spark, d):
    from ..functions.vectors import is_valid

    c = table(spark, d, "chunks").where("embedding is not null").dropDuplicates(["id"])
    return c.select("id", is_valid(F.col("embedding"), F.col("embedding_dimensions")).alias("valid"), F.round(F.get(normalise(F.col("embedding"), F.col("embedding_dimensions")), F.lit(0)), 6).alias("first"))


#: a region is a vector; four of them make an asset; the prompt is the first vector
_SCORES = f"s AS (SELECT vec_id // 4 AS asset, (-(1 + vec_id % 4))::INT AS region, round({_COS.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 6) AS score FROM embeddings)"


def _scores(spark, d):
    e = _e(spark, d)
    prompt = e.where("vec_id = 0").select(F.col("embedding").alias("p"))  # one row
    return e.crossJoin(F.broadcast(prompt)).select(F.floor(F.col("vec_id") / 4).alias("asset"), (-(1 + F.col("vec_id") % 4)).cast("int").alias("region"), F.round(cosine(F.col("embedding"), F.col("p")), 6).alias("score"))


@query(
    f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY score DESC, region DESC) AS n FROM s)
    SELECT asset, round(0.8::DOUBLE * max(score) FILTER (n = 1) + 0.2::DOUBLE * coalesce(max(score) FILTER (n = 2), max(score) FILTER (n = 1)), 6) AS score, max(region) FILTER (n = 1) AS best_region FROM r GROUP BY 1"""
)
def region_top2_blend(spark, d):
    return V.roll_up(_scores(spark, d), "asset", "region", "score")


@query(f"WITH {_SCORES}, m AS (SELECT median(score) AS med FROM s), k AS (SELECT median(abs(score - med)) AS mad FROM s, m) SELECT asset, region, round((score - med) / greatest(mad * 1.4826::DOUBLE, 0.01::DOUBLE), 4) AS z FROM s, m, k")
def robust_z_scores(spark, d):
    return V.robust_z(_scores(spark, d), "score").select("asset", "region", "z")


@query(
    f"""WITH a AS (SELECT embedding AS p FROM embeddings WHERE vec_id IN (0, 1)), s AS (SELECT vec_id, greatest(max({_COS.format(a='embedding', b='p')}), 0) AS s FROM embeddings, a GROUP BY 1)
    SELECT vec_id, round(s, 6) AS score FROM s"""
)
def prompt_max_score(spark, d):
    """Best of two prompts, at least 0."""
    e = _e(spark, d)
    prompts = e.where("vec_id in (0, 1)").select(F.col("embedding").alias("p"))  # two rows
    return e.crossJoin(F.broadcast(prompts)).groupBy("vec_id").agg(F.round(F.greatest(F.max(cosine(F.col("embedding"), F.col("p"))), F.lit(0.0)), 6).alias("score"))


_PROTO = "p AS (SELECT label, list(m ORDER BY i) AS p FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"
_LABELS = f"{_PROTO}, s AS (SELECT vec_id, p.label, round(list_dot_product(embedding::DOUBLE[], p.p), 6) AS score FROM embeddings, p)"


def _label_scores(spark, d):
    e = _e(spark, d)
    bank = V.prototypes(e, "label", "embedding", DIMS)
    return V.label_scores(e, "vec_id", "embedding", bank, DIMS)


@query(f"WITH {_LABELS} SELECT vec_id, label, score, (n - 1)::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS n FROM s) WHERE n <= 5")
def prototype_classify_top5(spark, d):
    return V.top_labels(_label_scores(spark, d), "vec_id").select("vec_id", "label", "score", "rank")


@query(
    f"""WITH {_LABELS}, w AS (SELECT label FROM embeddings GROUP BY 1 ORDER BY 1 LIMIT 3)
    SELECT vec_id, round(greatest(coalesce(max(score) FILTER (label IN (SELECT label FROM w)), 0), 0) - greatest(coalesce(max(score) FILTER (label NOT IN (SELECT label FROM w)), 0), 0), 6) AS margin FROM s GROUP BY 1"""
)
def category_margin(spark, d):
    wanted = [r["label"] for r in _e(spark, d).select("label").distinct().orderBy("label").limit(3).collect()]  # three names
    return V.category_margin(_label_scores(spark, d), "vec_id", wanted)


@query(
    f"""WITH {_LABELS}, g AS (SELECT vec_id, score, lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC) AS nx, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC) AS i FROM s),
    b AS (SELECT vec_id, (score + nx) / 2 AS mid, row_number() OVER (PARTITION BY vec_id ORDER BY score - nx DESC, i) AS n FROM g WHERE nx IS NOT NULL)
    SELECT s.vec_id, round(greatest(coalesce(max(b.mid), 0.2), 0.2), 6) AS threshold FROM (SELECT DISTINCT vec_id FROM s) s LEFT JOIN b ON b.vec_id = s.vec_id AND b.n = 1 GROUP BY 1"""
)
def mcut_threshold(spark, d):
    return V.mcut(_label_scores(spark, d), "vec_id", "score")


@query(
    f"""WITH {_LABELS}, t AS (SELECT vec_id // 4 AS asset, lower(label::VARCHAR) AS normalized_label, label::VARCHAR AS label, CASE WHEN score BETWEEN 0 AND 1 THEN score ELSE 1 / (1 + exp(-score)) END AS confidence FROM s),
    o AS (SELECT asset, normalized_label, round(max(confidence), 6) AS confidence FROM t GROUP BY 1, 2)
    SELECT asset, normalized_label, confidence, (n - 1)::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY confidence DESC, normalized_label) AS n FROM o) WHERE n <= 20"""
)
def best_tag_per_label(spark, d):
    s = _label_scores(spark, d).select(F.floor(F.col("vec_id") / 4).alias("asset"), F.col("label").cast("string").alias("label"), F.round(V.tag_probability(F.col("score")), 6).alias("confidence"))
    return V.best_tags(s.withColumn("normalized_label", F.lower("label")), "asset").select("asset", "normalized_label", "confidence", "rank")


QUERIES, ORACLE = Q, O
