"""Chunks and jobs that change, sweeps, tag rules, zero-shot labels, control plane."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import library as L
from ..operators import maintenance as M
from ..operators import registry as R
from ..operators import similarity as V
from .common import ASSETS, CHUNKS, JOBS, assets, chunks, jobs, table

Q: dict = {}
O: dict = {}  # noqa: E741
IMAGES = "('png', 'jpg', 'jpeg', 'webp', 'bmp', 'gif', 'tif', 'tiff')"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


def _new_tags(spark, d):
    """Generated tag chunks for assets that have and that have not any; every third one is blank."""
    a = assets(spark, d).where(L.is_image(F.col("extension")))
    text = F.when(F.col("size_bytes") % 3 == 0, " ").otherwise(F.concat(F.lit("tags of "), "filename"))
    c = table(spark, d, "chunks")
    cols = {"id": F.concat(F.lit("gen-"), "id"), "asset_id": F.col("id"), "text": text, "source": F.lit("visual_tags")}
    return a.select(*[cols[f.name].alias(f.name) if f.name in cols else F.lit(None).cast(f.dataType).alias(f.name) for f in c.schema.fields])


_NEW = f"n AS (SELECT 'gen-' || id AS id, id AS asset_id, CASE WHEN size_bytes % 3 = 0 THEN ' ' ELSE 'tags of ' || filename END AS text FROM a WHERE lower(coalesce(extension, '')) IN {IMAGES})"


@query(
    f"""WITH {ASSETS}, {CHUNKS}, {_NEW}, old AS (SELECT asset_id, min(chunk_index) AS i FROM c WHERE source = 'visual_tags' GROUP BY 1), nx AS (SELECT asset_id, max(chunk_index) + 1 AS i FROM c GROUP BY 1)
    SELECT id, asset_id, chunk_index FROM c WHERE source IS DISTINCT FROM 'visual_tags' OR asset_id NOT IN (SELECT asset_id FROM n)
    UNION ALL SELECT n.id, n.asset_id, coalesce(old.i, nx.i, 0)::INT FROM n LEFT JOIN old USING (asset_id) LEFT JOIN nx USING (asset_id) WHERE trim(n.text) <> ''"""
)
def upsert_generated_chunks(spark, d):
    return M.upsert_generated(chunks(spark, d), _new_tags(spark, d)).select("id", "asset_id", "chunk_index")


@query(
    f"""WITH {ASSETS}, {CHUNKS}, {_NEW}, nx AS (SELECT asset_id, max(chunk_index) + 1 AS i FROM c GROUP BY 1)
    SELECT n.id, n.asset_id, (coalesce(nx.i, 0) + row_number() OVER (PARTITION BY n.asset_id ORDER BY n.id) - 1)::INT AS chunk_index FROM n LEFT JOIN nx USING (asset_id) WHERE trim(n.text) <> ''"""
)
def append_chunk_index(spark, d):
    """The appended rows alone."""
    return M.append_chunks(chunks(spark, d), _new_tags(spark, d)).where("id like 'gen-%'").select("id", "asset_id", "chunk_index")


@query(f"WITH {ASSETS}, {CHUNKS}, {_NEW} SELECT id, asset_id FROM c WHERE asset_id NOT IN (SELECT asset_id FROM n) OR asset_id IS NULL UNION ALL SELECT id, asset_id FROM n")
def replace_asset_chunks(spark, d):
    new = _new_tags(spark, d)
    return M.replace_chunks(chunks(spark, d), new, new).select("id", "asset_id")


#: one job for reading each file, made from the catalogue
_SOURCE = """sj AS (SELECT 'src-' || id AS id, id AS asset_id, 'index' AS stage, CASE WHEN size_bytes % 7 = 0 THEN 'processing' WHEN status = 'indexed' THEN 'indexed' WHEN status = 'failed' THEN 'failed' ELSE 'pending' END AS state,
    (size_bytes % 3)::INT AS attempts, error_message, modified_at AS created_at, coalesce(indexed_at, modified_at) AS updated_at FROM a)"""


def _source_jobs(spark, d):
    state = F.when(F.col("size_bytes") % 7 == 0, "processing").when(F.col("status").isin("indexed", "failed"), F.col("status")).otherwise("pending")
    return assets(spark, d).select(
        F.concat(F.lit("src-"), "id").alias("id"), F.col("id").alias("asset_id"), F.lit("index").alias("stage"), state.alias("state"), (F.col("size_bytes") % 3).cast("int").alias("attempts"), "error_message",
        F.col("modified_at").alias("created_at"), F.coalesce("indexed_at", "modified_at").alias("updated_at"),
    )


_ALL = "u AS (SELECT 'source' AS kind, id, asset_id, stage, state, attempts, created_at, updated_at FROM sj UNION ALL SELECT 'stage', id, asset_id, stage, state, attempts, created_at, updated_at FROM j)"


@query(
    f"""WITH {ASSETS}, {JOBS}, {_SOURCE}, {_ALL} SELECT kind, count(DISTINCT asset_id) AS active_assets, count(*) AS active_jobs, count(*) FILTER (attempts > 0) AS retrying FROM u WHERE state IN ('pending', 'processing') GROUP BY 1"""
)
def active_job_counts(spark, d):
    return M.active_counts(M.all_jobs(_source_jobs(spark, d), jobs(spark, d)))


@query(
    f"""WITH {ASSETS}, {JOBS}, {_SOURCE}, {_ALL}, p AS (SELECT kind, asset_id, row_number() OVER (PARTITION BY kind ORDER BY updated_at DESC, id DESC) AS n FROM u WHERE state = 'processing')
    SELECT kind, filename FROM p JOIN a ON a.id = p.asset_id WHERE n = 1"""
)
def current_files(spark, d):
    return M.current_file(M.all_jobs(_source_jobs(spark, d), jobs(spark, d)), assets(spark, d))


@query(f"WITH {ASSETS}, {_SOURCE} SELECT id, 'processing' AS state, attempts + 1 AS attempts FROM sj WHERE state = 'pending' ORDER BY created_at, id LIMIT 25")
def claim_source_jobs(spark, d):
    return M.claim(_source_jobs(spark, d), 25).select("id", "state", "attempts")


_EVENT = "CASE hash_ % 5 WHEN 0 THEN 'cancel' WHEN 1 THEN 'retry' WHEN 2 THEN 'start' WHEN 3 THEN 'wake' ELSE 'complete' END"


@query(
    f"""WITH {JOBS}, e AS (SELECT *, {_EVENT.replace('hash_', 'length(asset_id || stage || coalesce(error_message, model_id))')} AS event FROM j)
    SELECT id, CASE WHEN event = 'cancel' AND state IN ('pending', 'processing', 'waiting_model', 'failed') THEN 'cancelled' WHEN event = 'retry' AND state = 'failed' THEN 'pending' WHEN event = 'start' AND state = 'pending' THEN 'processing'
      WHEN event = 'wake' AND state = 'waiting_model' THEN 'pending' WHEN event = 'complete' AND state = 'processing' THEN 'indexed' ELSE state END AS state,
    CASE WHEN event = 'retry' AND state = 'failed' THEN 0 WHEN event = 'start' AND state = 'pending' THEN attempts + 1 ELSE attempts END AS attempts FROM e"""
)
def job_transitions(spark, d):
    j = jobs(spark, d)
    n = F.length(F.concat("asset_id", "stage", F.coalesce("error_message", "model_id"))) % 5
    event = F.when(n == 0, "cancel").when(n == 1, "retry").when(n == 2, "start").when(n == 3, "wake").otherwise("complete")
    events = j.select("id", event.alias("event"), F.lit(None).cast("string").alias("message"), F.col("updated_at").alias("at"))
    return M.transition(j, events).select("id", "state", "attempts")


@query(
    f"""WITH {ASSETS}, {JOBS} SELECT j.id, CASE WHEN a.size_bytes % 10 = 0 AND state IN ('pending', 'processing', 'waiting_model') THEN 'cancelled' ELSE state END AS state FROM j LEFT JOIN a ON a.id = j.asset_id"""
)
def cancel_missing_jobs(spark, d):
    changes = assets(spark, d).select("id", F.when(F.col("size_bytes") % 10 == 0, "missing").otherwise("unchanged").alias("change"))
    return M.cancel_for_missing(jobs(spark, d), changes).select("id", "state")


@query(f"WITH {ASSETS}, {CHUNKS} SELECT c.id FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = c.asset_id AND size_bytes % 10 = 2)")
def invalidate_changed(spark, d):
    changes = assets(spark, d).select("id", F.when(F.col("size_bytes") % 10 == 2, "changed").otherwise("unchanged").alias("change"))
    return M.invalidate(chunks(spark, d), changes).select("id")


@query(f"WITH {CHUNKS} SELECT id, embedding_profile_id IS NOT DISTINCT FROM 'txt-base/v3' AND embedding IS NOT NULL AS kept, CASE WHEN embedding_profile_id = 'txt-base/v3' THEN embedding_profile_id END AS embedding_profile_id FROM c")
def clear_other_vectors(spark, d):
    return M.clear_vectors(chunks(spark, d), "txt-base/v3").select("id", F.col("embedding").isNotNull().alias("kept"), "embedding_profile_id")


def _tags(spark, d):
    """Tags of a model and version, from the tag lists of the library; every fifth asset has those of an older version."""
    version = F.when(F.ascii(F.substring("asset_id", 1, 1)) % 5 == 0, "1").otherwise("2")
    return chunks(spark, d).where("source = 'visual_tags'").select("asset_id", F.lit("tagger").alias("model_id"), version.alias("model_version"))


@query(
    f"""WITH {ASSETS}, {CHUNKS}, t AS (SELECT asset_id, CASE WHEN ascii(asset_id[1]) % 5 = 0 THEN '1' ELSE '2' END AS v FROM c WHERE source = 'visual_tags')
    SELECT id AS asset_id FROM a WHERE available AND status = 'indexed' AND lower(coalesce(extension, '')) IN {IMAGES} AND id NOT IN (SELECT asset_id FROM t WHERE v = '2' AND asset_id IS NOT NULL)"""
)
def images_without_tags(spark, d):
    return M.images_without_tags(assets(spark, d), _tags(spark, d), "tagger", "2")


@query(
    f"""WITH {ASSETS}, {CHUNKS}, {JOBS} SELECT DISTINCT c.asset_id FROM c JOIN a ON a.id = c.asset_id WHERE available AND embedding IS NOT NULL
    AND c.asset_id NOT IN (SELECT asset_id FROM j WHERE stage = 'visual_tagging' AND state = 'indexed' AND asset_id IS NOT NULL)"""
)
def vectors_without_categories(spark, d):
    """Assets whose tagging is done count as categorised."""
    done = jobs(spark, d).where("stage = 'visual_tagging' and state = 'indexed'")
    return M.vectors_without_categories(chunks(spark, d).where("embedding is not null"), assets(spark, d), done)


@query(f"WITH {ASSETS}, {CHUNKS} SELECT c.id FROM c JOIN a ON a.id = c.asset_id WHERE available AND embedding_profile_id = 'txt-base/v2' AND embedding_dimensions = 64 AND len(embedding) = 64")
def compatible_vectors(spark, d):
    return M.compatible(chunks(spark, d), assets(spark, d), "txt-base/v2", 64).select("id")


# -- regions, tags and labels over the embeddings: four vectors make an asset, every twentieth vector is a query
_COS = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


@query(
    f"""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id // 4 AS asset_id, (-(1 + vec_id % 4))::INT AS region_id, greatest({_COS.format(a='embedding', b='q')}, 0) AS score FROM embeddings, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, asset_id ORDER BY score DESC, region_id DESC) AS n FROM s),
    b AS (SELECT query_id, asset_id, round(0.8::DOUBLE * max(score) FILTER (n = 1) + 0.2::DOUBLE * coalesce(max(score) FILTER (n = 2), max(score) FILTER (n = 1)), 6) AS score, max(region_id) FILTER (n = 1) AS best_region FROM r GROUP BY 1, 2),
    m AS (SELECT query_id, median(score) AS med FROM b GROUP BY 1), k AS (SELECT query_id, median(abs(score - med)) AS mad FROM b JOIN m USING (query_id) GROUP BY 1)
    SELECT query_id, asset_id, score, best_region, round((score - med) / greatest(mad * 1.4826::DOUBLE, 0.01::DOUBLE), 4) AS z FROM b JOIN m USING (query_id) JOIN k USING (query_id)"""
)
def visual_scores(spark, d):
    """Region vectors of every asset against every query: blend of the best two regions, the best region, z within the query."""
    e = table(spark, d, "embeddings")
    regions = e.select(F.floor(F.col("vec_id") / 4).alias("asset_id"), (-(1 + F.col("vec_id") % 4)).cast("int").alias("region_id"), "embedding")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return V.visual_scores(regions, asked)


_PROTO = "p AS (SELECT label, list(m ORDER BY i) AS p FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"
_RAW = f"{_PROTO}, s AS (SELECT vec_id, p.label, round(list_dot_product(embedding::DOUBLE[], p.p), 6) AS score FROM embeddings, p)"


def _raw(spark, d):
    e = table(spark, d, "embeddings")
    return V.label_scores(e, "vec_id", "embedding", V.prototypes(e, "label", "embedding", 64), 64)


@query(
    f"""WITH {_RAW}, r AS (SELECT vec_id // 4 AS asset_id, label, max(score) AS score FROM s GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY score DESC, label) AS n FROM r) SELECT asset_id, label, score, (n - 1)::INT AS rank FROM k WHERE n <= 5"""
)
def region_categories(spark, d):
    """The best of an asset's regions for each label, the first five labels."""
    per = _raw(spark, d).select(F.floor(F.col("vec_id") / 4).alias("asset_id"), "label", "score")
    return V.top_labels(V.best_region_labels(per, "asset_id"), "asset_id")


@query(
    """WITH q AS (SELECT vec_id AS p_id, label, embedding AS p FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3), s AS (SELECT e.vec_id, q.label, q.p_id, list_dot_product(e.embedding::DOUBLE[], q.p::DOUBLE[]) AS score FROM embeddings e, q),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY score DESC) AS n FROM s) SELECT vec_id, label, round(avg(score), 6) AS score FROM k WHERE n <= 2 GROUP BY 1, 2"""
)
def label_mean_of_two(spark, d):
    """Labels by the mean of their two best prompts; the first three vectors of a label are its prompts."""
    e = table(spark, d, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    bank = e.withColumn("n", F.row_number().over(w)).where("n <= 3").select("label", F.col("embedding").alias("p"))  # three for each label
    return V.label_scores_best_two(e, "vec_id", "embedding", bank, 64)


_NAMESPACE = "CASE label % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'character' ELSE 'rating' END"


@query(
    f"""WITH {_RAW}, t AS (SELECT vec_id, label::VARCHAR AS label, {_NAMESPACE} AS namespace, round(CASE WHEN score BETWEEN 0 AND 1 THEN score ELSE 1 / (1 + exp(-score)) END, 6) AS confidence FROM s),
    g AS (SELECT vec_id, namespace, confidence, lead(confidence) OVER w AS nx, row_number() OVER w AS i FROM t WHERE namespace <> 'rating' WINDOW w AS (PARTITION BY vec_id, namespace ORDER BY confidence DESC)),
    m AS (SELECT vec_id, namespace, (confidence + nx) / 2 AS mid, row_number() OVER (PARTITION BY vec_id, namespace ORDER BY confidence - nx DESC, i) AS n FROM g WHERE nx IS NOT NULL),
    c AS (SELECT t.vec_id, t.namespace, t.label, t.confidence FROM t LEFT JOIN m ON m.vec_id = t.vec_id AND m.namespace = t.namespace AND m.n = 1 WHERE t.namespace <> 'rating' AND confidence >= round(greatest(coalesce(m.mid, 0.2), 0.2), 6)),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY confidence DESC, label) AS r FROM c) SELECT vec_id, namespace, label, confidence, (r - 1)::INT AS rank FROM k WHERE r <= 20"""
)
def tagger_rules(spark, d):
    """Tags of a namespace above its own cut, ratings dropped, the first twenty of a vector."""
    n = F.col("label") % 3
    raw = _raw(spark, d).select("vec_id", F.col("label").cast("string").alias("label"), F.when(n == 0, "general").when(n == 1, "character").otherwise("rating").alias("namespace"), F.col("score").alias("raw"))
    return V.tagger_rules(raw, "vec_id").select("vec_id", "namespace", "label", "confidence", "rank")


# -- control plane
@query(f"WITH {ASSETS} SELECT id, coalesce(content_id, lower(sha256), id) AS content_id FROM a")
def backfill_content(spark, d):
    return R.backfill_content(assets(spark, d)).select("id", "content_id")


@query(f"WITH {ASSETS}, {CHUNKS} SELECT c.id FROM c WHERE asset_id IN (SELECT id FROM a WHERE available)")
def purge_orphans(spark, d):
    return R.purge_orphans(chunks(spark, d), assets(spark, d).where("available")).select("id")


@query("SELECT user_id::VARCHAR AS key, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY 1")
def newest_settings(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.struct("ts", "event_id").alias("at"))
    return R.newest_settings(log)


@query(
    """WITH n AS (SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM chunks WHERE embedding IS NOT NULL),
    v AS (SELECT id, e, len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 1.1920929e-07 AS ok FROM n)
    SELECT id, coalesce(ok, false) AS valid, CASE WHEN ok THEN round(e[2] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 5) END AS second FROM v WHERE len(list_filter(e, lambda x: x IS NULL)) = 0"""
)
def vector_codec(spark, d):
    """Vectors written as bytes and read back, checked and of unit length."""
    c = table(spark, d, "chunks").where("embedding is not null and not exists(embedding, x -> x is null)").dropDuplicates(["id"]).select("id", "embedding")
    back = R.decode_valid(c.withColumn("blob", R.encode_vector("embedding")), "blob", 64, "u")
    return back.select("id", F.col("u").isNotNull().alias("valid"), F.round(F.get("u", F.lit(1)), 5).alias("second"))


QUERIES, ORACLE = Q, O
