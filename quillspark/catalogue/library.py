"""Catalogue, copies, reconciliation, queue, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import library as L
from ..operators import queue as K
from ..operators.evaluate import evaluate, overlap
from ..plans import search as S
from ..sources import files
from .common import ASSETS, CHUNKS, JOBS, assets, chunks, jobs, table

Q: dict = {}
O: dict = {}  # noqa: E741


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


@query(f"WITH {ASSETS} SELECT id, status, available, lower(sha256) AS sha256 FROM a")
def latest_assets(spark, d):
    return assets(spark, d).select("id", "status", "available", F.lower("sha256").alias("sha256"))


@query(
    f"""WITH {ASSETS} SELECT f.id, f.path, count(a.id) AS assets, count(*) FILTER (a.status = 'indexed') AS indexed,
    count(*) FILTER (a.status IN ('pending', 'processing')) AS waiting, count(*) FILTER (a.status = 'failed') AS failed
    FROM folders f LEFT JOIN a ON a.folder_id = f.id AND a.available GROUP BY 1, 2"""
)
def folder_rollup(spark, d):
    return L.folder_rollup(table(spark, d, "folders"), assets(spark, d)).drop("created_at")


@query(
    f"""WITH {ASSETS} SELECT id, folder_id, extension FROM a WHERE available AND status = 'indexed' AND lower(extension) IN ('pdf', 'md')
    AND folder_id = (SELECT min(id) FROM folders)"""
)
def exact_filters(spark, d):
    first = table(spark, d, "folders").agg(F.min("id").alias("folder"))
    live = L.matches(assets(spark, d), ["pdf", "MD"])
    return live.join(F.broadcast(first), F.col("folder_id") == F.col("folder")).select("id", "folder_id", "extension")  # one row


@query(
    f"""WITH {ASSETS}, k AS (SELECT *, coalesce(content_id, id) AS content FROM a WHERE available),
    r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY size_bytes DESC, id) AS n, count(*) OVER (PARTITION BY content) - 1 AS other_places FROM k)
    SELECT content AS content_id, id, filename, other_places FROM r WHERE n = 1"""
)
def content_dedup(spark, d):
    live = assets(spark, d).where("available").select("id", "filename", "size_bytes", F.coalesce("content_id", "id").alias("content_id"))
    return L.first_of_content(live, "size_bytes").select("content_id", "id", "filename", "other_places")


@query(f"WITH {ASSETS} SELECT lower(sha256) AS sha256, count(*) AS places, min(id) AS first_id, min(indexed_at) AS first_seen, max(indexed_at) AS last_seen FROM a WHERE sha256 IS NOT NULL GROUP BY 1")
def content_items(spark, d):
    return assets(spark, d).where("sha256 is not null").groupBy(F.lower("sha256").alias("sha256")).agg(F.count("*").alias("places"), F.min("id").alias("first_id"), F.min("indexed_at").alias("first_seen"), F.max("indexed_at").alias("last_seen"))


@query(
    f"""WITH {ASSETS}, {CHUNKS}, v AS (SELECT DISTINCT asset_id FROM c WHERE embedding IS NOT NULL)
    SELECT id, coalesce(content_id, id) AS content_id, thumbnail_path IS NOT NULL AS thumbnail_available FROM a
    WHERE available AND (status = 'indexed' OR id IN (SELECT asset_id FROM v))"""
)
def asset_briefs(spark, d):
    return L.briefs(assets(spark, d), chunks(spark, d).where("embedding is not null")).select("id", "content_id", "thumbnail_available")


@query(
    f"""WITH {ASSETS}, {CHUNKS} SELECT a.id FROM a WHERE available AND lower(coalesce(extension, '')) IN ('png', 'jpg', 'jpeg', 'webp', 'bmp', 'gif', 'tif', 'tiff')
    AND NOT EXISTS (SELECT 1 FROM c WHERE c.asset_id = a.id AND c.embedding IS NOT NULL AND c.embedding_profile_id = 'txt-base/v3' AND c.embedding_dimensions = 64)"""
)
def images_without_vector(spark, d):
    live = assets(spark, d).where(F.col("available") & L.is_image(F.col("extension"))).select(F.col("id").alias("asset_id"))
    have = table(spark, d, "chunks").where("embedding is not null and embedding_profile_id = 'txt-base/v3' and embedding_dimensions = 64")
    return L.missing_outputs(live, have, ["asset_id"]).select(F.col("asset_id").alias("id"))


@query(f"WITH {CHUNKS} SELECT id FROM c WHERE embedding IS NULL OR embedding_profile_id IS DISTINCT FROM 'txt-base/v3'")
def stale_text_chunks(spark, d):
    return L.stale_text(chunks(spark, d), "txt-base/v3").select("id")


@query(
    f"""WITH {ASSETS}, {JOBS}, want AS (SELECT id AS asset_id, 'analysis' AS stage FROM a WHERE available AND status = 'indexed')
    SELECT w.asset_id, w.stage FROM want w WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.asset_id = w.asset_id AND j.stage = w.stage AND j.state = 'indexed')"""
)
def missing_analysis(spark, d):
    want = L.matches(assets(spark, d)).select(F.col("id").alias("asset_id"), F.lit("analysis").alias("stage"))
    return L.missing_outputs(want, table(spark, d, "stage_jobs").where("state = 'indexed'"), ["asset_id", "stage"])


#: a new scan made from the old catalogue: some files vanish, move, change, come
def _scan(a):
    h = F.col("size_bytes") % 10
    kept = a.where("available").select(
        F.when(h == 1, F.concat("absolute_path", F.lit(".moved"))).otherwise(F.col("absolute_path")).alias("absolute_path"),
        "folder_id",
        F.when(h == 2, F.sha2(F.concat("id", F.lit("new")), 256)).otherwise(F.lower("sha256")).alias("sha256"),
        h.alias("h"),
    )
    return kept.where("h <> 0 and sha256 is not null").drop("h")


@query(
    f"""WITH {ASSETS}, s AS (
      SELECT CASE WHEN size_bytes % 10 = 1 THEN absolute_path || '.moved' ELSE absolute_path END AS path, folder_id,
             CASE WHEN size_bytes % 10 = 2 THEN sha256(id || 'new') ELSE lower(sha256) END AS sha
      FROM a WHERE available AND size_bytes % 10 <> 0 AND (sha256 IS NOT NULL OR size_bytes % 10 = 2)),
    b AS (SELECT coalesce(a.absolute_path, s.path) AS path, a.id AS old_id, a.folder_id AS old_folder, lower(a.sha256) AS old_sha, a.status, a.indexed_at, s.folder_id AS new_folder, s.sha AS new_sha
          FROM a FULL JOIN s ON a.absolute_path = s.path),
    g AS (SELECT *, row_number() OVER (PARTITION BY old_folder, old_sha ORDER BY indexed_at DESC NULLS LAST, old_id) AS n FROM b WHERE new_sha IS NULL AND old_sha IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY new_folder, new_sha ORDER BY path) AS n FROM b WHERE old_id IS NULL),
    m AS (SELECT k.path, g.path AS from_path, g.old_id FROM k JOIN g ON k.new_folder = g.old_folder AND k.new_sha = g.old_sha AND k.n = g.n)
    SELECT b.path AS absolute_path, CASE WHEN m.old_id IS NOT NULL THEN 'moved' WHEN b.old_id IS NULL THEN 'new' WHEN b.new_folder IS NULL THEN 'missing'
      WHEN b.status <> 'indexed' OR b.old_sha IS DISTINCT FROM b.new_sha THEN 'changed' ELSE 'unchanged' END AS change,
      coalesce(m.old_id, b.old_id, sha256(b.path)) AS id
    FROM b LEFT JOIN m ON m.path = b.path WHERE b.path NOT IN (SELECT from_path FROM m)"""
)
def reconcile_scan(spark, d):
    a = assets(spark, d)
    return L.reconcile(a, _scan(a))


@query(f"WITH {ASSETS}, {CHUNKS} SELECT c.id, c.asset_id FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = c.asset_id AND a.folder_id = (SELECT min(id) FROM folders))")
def cascade_delete(spark, d):
    first = table(spark, d, "folders").agg(F.min("id").alias("f"))
    gone = assets(spark, d).join(F.broadcast(first), F.col("folder_id") == F.col("f")).select(F.col("id").alias("asset_id"))  # one row
    return chunks(spark, d).select("id", "asset_id").join(gone, "asset_id", "left_anti").select("id", "asset_id")


@query(
    f"""WITH {JOBS} SELECT asset_id, stage, model_id, pipeline_version, state, attempts FROM (
    SELECT *, row_number() OVER (PARTITION BY asset_id, stage, model_id, pipeline_version ORDER BY updated_at DESC, id DESC) AS n FROM j) WHERE n = 1"""
)
def latest_jobs(spark, d):
    return K.current(table(spark, d, "stage_jobs")).select("asset_id", "stage", "model_id", "pipeline_version", "state", "attempts")


@query(
    f"""WITH {ASSETS}, {JOBS}, p AS (SELECT j.id, j.stage, j.created_at, CASE stage WHEN 'visual' THEN 10 WHEN 'text_embedding' THEN 20 WHEN 'analysis' THEN 30 WHEN 'visual_tagging' THEN 40
    WHEN 'recategorize' THEN 45 WHEN 'visual_regions' THEN 50 WHEN 'visual_region_tagging' THEN 60 ELSE 90 END AS priority
    FROM j JOIN a ON a.id = j.asset_id WHERE j.state = 'pending' AND a.available
    AND (a.status = 'indexed' OR j.stage IN ('visual', 'visual_regions', 'recategorize', 'visual_tagging', 'visual_region_tagging')))
    SELECT id, stage, priority FROM p ORDER BY priority, created_at, id LIMIT 50"""
)
def job_queue_head(spark, d):
    return K.next_jobs(jobs(spark, d), assets(spark, d), 50).select("id", "stage", "priority")


@query(
    f"""WITH {JOBS} SELECT id, stage, attempts, CASE WHEN attempts < CASE WHEN stage IN ('visual', 'analysis') THEN 2 ELSE 3 END THEN 'pending' ELSE 'failed' END AS next_state
    FROM j WHERE state = 'failed'"""
)
def retry_or_fail(spark, d):
    return K.after_failure(jobs(spark, d).where("state = 'failed'")).select("id", "stage", "attempts", "next_state")


@query(f"WITH {JOBS} SELECT stage, state, count(*) AS jobs, sum(attempts)::BIGINT AS attempts, max(updated_at) AS last_update FROM j GROUP BY 1, 2")
def queue_progress(spark, d):
    return K.progress(jobs(spark, d))


@query(
    """WITH r AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
    l AS (SELECT *, max(run) OVER (PARTITION BY user_id) AS last FROM r),
    g AS (SELECT user_id, count(*) FILTER (run = last AND event_type = 'error') AS failures, max(last) AS successes FROM l GROUP BY 1)
    SELECT user_id, failures, CASE WHEN failures >= 3 THEN 'failed' WHEN failures > 0 THEN 'pending' WHEN successes > 0 THEN 'indexed' ELSE 'pending' END AS state FROM g"""
)
def retry_budget_fold(spark, d):
    e = table(spark, d, "events")
    return K.fold_events(e, "user_id", "event_type", ["ts", "event_id"], "error", "purchase", 3).select("user_id", "failures", "state")


@query(
    f"""WITH {ASSETS}, {CHUNKS}, {JOBS} SELECT (SELECT count(*) FROM a) AS assets, (SELECT count(*) FROM a WHERE available) AS available, (SELECT count(*) FROM a WHERE status = 'indexed') AS indexed,
    (SELECT count(*) FROM a WHERE status = 'failed') AS failed_assets,
    (SELECT count(*) FROM a WHERE lower(coalesce(extension, '')) IN ('png', 'jpg', 'jpeg', 'webp', 'bmp', 'gif', 'tif', 'tiff')) AS images,
    (SELECT count(*) FROM j) AS jobs, (SELECT count(*) FROM j WHERE state = 'pending') AS jobs_pending, (SELECT count(*) FROM j WHERE state = 'failed') AS jobs_failed,
    (SELECT count(*) FROM j WHERE state = 'waiting_model') AS jobs_waiting_model, (SELECT count(*) FROM j WHERE state = 'cancelled') AS jobs_cancelled,
    (SELECT max(reindex_generation) FROM j) AS generation, (SELECT count(DISTINCT asset_id) FROM j) AS assets_with_jobs,
    (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM c WHERE embedding IS NOT NULL) AS chunks_with_vector, (SELECT count(DISTINCT asset_id) FROM c) AS assets_with_chunks"""
)
def status_rollup(spark, d):
    return L.status(assets(spark, d), jobs(spark, d), chunks(spark, d).select("id", "asset_id", "embedding"))


@query(f"WITH {ASSETS} SELECT id, filename FROM a ORDER BY coalesce(indexed_at, modified_at) DESC NULLS LAST, id LIMIT 100")
def recent_assets(spark, d):
    return L.recent(assets(spark, d), 100).select("id", "filename")


@query(
    f"""WITH {ASSETS}, n AS (SELECT id, 'seen' AS status FROM a WHERE status = 'pending' UNION ALL SELECT 'extra-' || id, 'seen' FROM a WHERE status = 'failed')
    SELECT id, status FROM a WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, status FROM n"""
)
def upsert_assets(spark, d):
    a = assets(spark, d).select("id", "status")
    new = a.where("status = 'pending'").select("id", F.lit("seen").alias("status")).unionByName(a.where("status = 'failed'").select(F.concat(F.lit("extra-"), "id").alias("id"), F.lit("seen").alias("status")))
    return L.upsert(a, new, ["id"])


@query("SELECT id, role FROM profiles UNION ALL SELECT * FROM (VALUES ('txt-new/v1', 'text')) WHERE col0 NOT IN (SELECT id FROM profiles)")
def register_profile(spark, d):
    p = table(spark, d, "profiles").select("id", "role")
    first = p.orderBy("id").limit(1)
    new = spark.createDataFrame([("txt-new/v1", "text")], "id string, role string").unionByName(first)
    return L.insert_ignore(p, new, ["id"])


@query(
    f"""WITH {ASSETS} SELECT id, 'index' AS stage, 'ocr-b' AS model_id FROM a WHERE available AND lower(coalesce(extension, '')) IN ('png', 'jpg', 'jpeg', 'webp', 'bmp', 'gif', 'tif', 'tiff')
    UNION ALL SELECT id, 'text_embedding', 'txt-b' FROM a WHERE available"""
)
def reindex_plan(spark, d):
    return K.reindex_plan(assets(spark, d), {"ocr": "ocr-a", "text": "txt-a", "visual": "vis"}, {"ocr": "ocr-b", "text": "txt-b", "visual": "vis"}).withColumnRenamed("asset_id", "id")


@query(
    f"""WITH {ASSETS}, p AS (SELECT a.id, list_filter(string_split(a.absolute_path, '/'), lambda x: x <> '') AS path, list_filter(string_split(f.path, '/'), lambda x: x <> '') AS root
    FROM a JOIN folders f ON f.id = a.folder_id)
    SELECT id, path[1:len(root)] = root AS inside FROM p"""
)
def path_containment(spark, d):
    f = table(spark, d, "folders").select(F.col("id").alias("folder_id"), "path")
    return assets(spark, d).join(f, "folder_id").select("id", files.is_inside(F.col("absolute_path"), F.col("path")).alias("inside"))


@query(
    f"""WITH {ASSETS} SELECT id, lower(nullif(regexp_extract(filename, '^.+\\.([^.]*)$', 1), '')) AS type,
    CASE lower(nullif(regexp_extract(filename, '^.+\\.([^.]*)$', 1), '')) WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png'
    WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'webp' THEN 'image/webp' WHEN 'bmp' THEN 'image/bmp' WHEN 'gif' THEN 'image/gif' WHEN 'tif' THEN 'image/tiff' WHEN 'tiff' THEN 'image/tiff'
    ELSE 'application/octet-stream' END AS mime FROM a"""
)
def file_types(spark, d):
    ext = files.extension(F.col("filename"))
    return assets(spark, d).select("id", ext.alias("type"), files.mime_type(ext).alias("mime"))


_HEADS = [("png", "89504E470D0A1A0A00"), ("jpg", "FFD8FFE0"), ("gif", "474946383961"), ("gif", "474946383761"), ("bmp", "424D0000"), ("tif", "49492A00"), ("tif", "4D4D002A"), ("webp", "52494646000000005745425000"), (None, "52494646000000005741564500"), (None, "25504446")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {repr(t) if t else 'NULL'})" for k, (t, _) in enumerate(_HEADS)) + ") AS t(k, kind)")
def magic_sniff(spark, d):
    rows = spark.createDataFrame([(k, h) for k, (_, h) in enumerate(_HEADS)], "k int, h string")
    return rows.select("k", files.sniff_image(F.unhex("h")).alias("kind"))


@query(
    """WITH s AS (SELECT DISTINCT * FROM search_results), r AS (SELECT query_id, asset_id, row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC NULLS LAST, asset_id) AS position FROM
      (SELECT query_id, asset_id, nullif(CASE WHEN isnan(semantic_score) THEN NULL ELSE semantic_score END, 0) AS semantic_score FROM s)),
    g AS (SELECT DISTINCT query_id, asset_id FROM relevance_labels WHERE relevance >= 2), t AS (SELECT query_id, count(*) AS relevant FROM g GROUP BY 1),
    h AS (SELECT query_id, count(*) FILTER (position <= 1) AS h1, count(*) FILTER (position <= 5) AS h5, count(*) FILTER (position <= 10) AS h10, min(position) AS f FROM r JOIN g USING (query_id, asset_id) GROUP BY 1)
    SELECT query_id, relevant, round(coalesce(h1, 0) / 1.0::DOUBLE, 6) AS precision_1, round(coalesce(h5, 0) / 5.0::DOUBLE, 6) AS precision_5, round(coalesce(h10, 0) / 10.0::DOUBLE, 6) AS precision_10,
    round(coalesce(h10, 0)::DOUBLE / relevant, 6) AS recall_10, round(coalesce(1.0::DOUBLE / f, 0), 6) AS reciprocal_rank FROM t LEFT JOIN h USING (query_id)"""
)
def eval_relevance(spark, d):
    return evaluate(_by_score(spark, d, "semantic_score"), table(spark, d, "relevance_labels"))


def _by_score(spark, d, score):
    from pyspark.sql import Window

    s = table(spark, d, "search_results").distinct().select("query_id", "asset_id", F.when(~F.isnan(score) & (F.col(score) != 0), F.col(score)).alias("score"))
    return s.select("query_id", "asset_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "asset_id")).alias("position"))


@query(
    """WITH s AS (SELECT DISTINCT * FROM search_results),
    x AS (SELECT query_id, asset_id, row_number() OVER (PARTITION BY query_id ORDER BY nullif(CASE WHEN isnan(semantic_score) THEN NULL ELSE semantic_score END, 0) DESC NULLS LAST, asset_id) AS n FROM s),
    y AS (SELECT query_id, asset_id, row_number() OVER (PARTITION BY query_id ORDER BY nullif(CASE WHEN isnan(combined_score) THEN NULL ELSE combined_score END, 0) DESC NULLS LAST, asset_id) AS n FROM s),
    u AS (SELECT query_id, asset_id, count(*) AS n_of FROM (SELECT query_id, asset_id FROM x WHERE n <= 10 UNION ALL SELECT query_id, asset_id FROM y WHERE n <= 10) GROUP BY 1, 2)
    SELECT query_id, round(count(*) FILTER (n_of = 2)::DOUBLE / count(*), 6) AS jaccard FROM u GROUP BY 1"""
)
def ranking_overlap(spark, d):
    return overlap(_by_score(spark, d, "semantic_score"), _by_score(spark, d, "combined_score"))


@query(f"WITH {ASSETS} SELECT coalesce(content_id, id) AS content_id, count(*) - 1 AS other_places FROM a WHERE available GROUP BY 1")
def alternate_locations(spark, d):
    live = assets(spark, d).where("available").select(F.coalesce("content_id", "id").alias("content_id"))
    return S.other_places(live)


@query("SELECT ts_hour AS start, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS ts_hour, event_type FROM events) GROUP BY 1, 2")
def events_per_hour(spark, d):
    """An extension: monitoring counts, as a table."""
    from ..streaming.ingest import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type")


@query("SELECT user_id AS key, count(*) FILTER (event_type = 'error')::BIGINT AS errors FROM events GROUP BY 1")
def stream_error_counts(spark, d):
    """Keyed state of a stream over the events that are there, run to its end; equals the batch count."""
    from ..session import intermediate
    from ..streaming.retry import OUT, fold_stream, retry_states

    schema = table(spark, d, "events").schema
    at = intermediate(spark, "errors")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d if not _is_dir(spark, d) else f"{d}/events.parquet")
    # each failure counts; no success ever resets it here
    fold_stream(retry_states(stream, "user_id", "event_type", "ts", "error", "", 1 << 30), f"{at}/states", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(OUT).parquet(f"{at}/states").groupBy("key").agg(F.max("failures").alias("errors"))


def _is_dir(spark, d):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


QUERIES, ORACLE = Q, O
