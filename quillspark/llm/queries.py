"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, mixing, near_dup, neighbours, personal, quality, ranking, scans, splitting, tokens
from .common import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    results, labels = table(spark, d, "search_results"), table(spark, d, "relevance_labels")
    rest = results.join(labels.select("query_id").distinct(), "query_id", "left_anti")
    return ranking.first_of_each(ranking.fuse_rankings(rest, "query_id", "asset_id"), "query_id", "asset_id", 5).select("query_id", "asset_id")


def p1_fused(spark: SparkSession, d: str) -> DataFrame:
    return ranking.fuse_rankings(table(spark, d, "search_results"), "query_id", "asset_id")


EDITED = {"threshold": 0.5, "shingle": 3, "min_words": 20}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicate_pairs(table(spark, d, "chunks"), digests=near_dup.known_digests(table(spark, d, "assets")), **EDITED).select("id_a", "id_b")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicate_groups(table(spark, d, "chunks"), digests=near_dup.known_digests(table(spark, d, "assets")), **EDITED)


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    members = near_dup.membership(table(spark, d, "chunks"), digests=near_dup.known_digests(table(spark, d, "assets")))
    first = members.groupBy("cls").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    return members.join(first, "cls").select("id", "digest", "first_id", "copies")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return neighbours.as_pairs(neighbours.nearest(chunks, "id", "embedding", "embedding_profile_id", "embedding_dimensions", k=5, least=0.8))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.cuts(table(spark, d, "chunks"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(table(spark, d, "chunks"))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    chunks, assets = table(spark, d, "chunks"), table(spark, d, "assets")
    # texts are read from text, Markdown and PDF files; scanned pages and tag lists carry a source
    found = encoding.find_garbled(chunks.where("source is null"), encoding.train(table(spark, d, "documents")), owner="asset_id")
    images = assets.where(F.lower("extension").isin("png", "jpg", "jpeg", "tif", "tiff", "webp", "gif", "bmp")).select(F.col("id").alias("owner")).distinct()
    return found.join(images, "owner", "left_anti").drop("owner")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("id")


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return personal.mentions(*personal.train(chunks))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return personal.redacted(chunks, personal.train(chunks)[0])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.faults(table(spark, d, "chunks"))


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "chunks"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    judged = quality.judge(table(spark, d, "documents")).select("doc_id", "kind").where("kind <> 'prose'").distinct()
    return judged.join(table(spark, d, "doc_labels").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "kind")


def p10_figures(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_fused, p2_found, p2_groups, p2_members, p3_found, p4_found, p4_pieces, p5_found, p5_restored, p6_found, p6_redacted, p7_found, p7_repaired, p8_ids, p9_mixture, p9_shares, p10_found, p10_figures)}

_RANKS = """
WITH once AS (
  SELECT query_id, asset_id, max(nullif(CASE WHEN isnan(semantic_score) THEN 0 ELSE semantic_score END, 0)) AS s0,
         max(nullif(CASE WHEN isnan(keyword_score) THEN 0 ELSE keyword_score END, 0)) AS s1,
         max(nullif(CASE WHEN isnan(combined_score) THEN 0 ELSE combined_score END, 0)) AS s2,
         max(nullif(CASE WHEN isnan(visual_score) THEN 0 ELSE visual_score END, 0)) AS s3,
         max(nullif(CASE WHEN isnan(category_score) THEN 0 ELSE category_score END, 0)) AS s4
  FROM search_results {where} GROUP BY 1, 2),
long AS (
  SELECT query_id, asset_id, 0 AS s, s0 AS v FROM once WHERE s0 IS NOT NULL UNION ALL SELECT query_id, asset_id, 1, s1 FROM once WHERE s1 IS NOT NULL
  UNION ALL SELECT query_id, asset_id, 2, s2 FROM once WHERE s2 IS NOT NULL UNION ALL SELECT query_id, asset_id, 3, s3 FROM once WHERE s3 IS NOT NULL
  UNION ALL SELECT query_id, asset_id, 4, s4 FROM once WHERE s4 IS NOT NULL),
ranked AS (
  SELECT query_id, asset_id, rank() OVER (PARTITION BY query_id, s ORDER BY v DESC) + (count(*) OVER (PARTITION BY query_id, s, v) - 1) / 2.0 AS r FROM long),
fused AS (
  SELECT o.query_id, o.asset_id, round(coalesce(sum(1 / (60.0::DOUBLE + r::DOUBLE)), 0), 12) AS fused
  FROM once o LEFT JOIN ranked USING (query_id, asset_id) GROUP BY 1, 2)
"""

_PAIRS = r"""
WITH RECURSIVE w AS (SELECT id, asset_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT id, asset_id, text FROM chunks) WHERE text IS NOT NULL),
s AS (SELECT id, asset_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 20),
u AS (SELECT id, unnest(g) AS g FROM s),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n FROM u a JOIN u b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
h AS (SELECT id AS asset_id, max(lower(sha256)) AS sha FROM assets WHERE sha256 IS NOT NULL GROUP BY 1),
pairs AS (SELECT id_a, id_b FROM p JOIN s x ON x.id = id_a JOIN s y ON y.id = id_b LEFT JOIN h hx ON hx.asset_id = x.asset_id LEFT JOIN h hy ON hy.asset_id = y.asset_id
WHERE 2 * n >= len(x.g) + len(y.g) - n AND (hx.sha IS NULL OR hy.sha IS NULL OR hx.sha <> hy.sha))
"""

ORACLE = {
    "p1_found": _RANKS.format(where="WHERE query_id NOT IN (SELECT query_id FROM relevance_labels)")
    + "SELECT query_id, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, asset_id) AS n FROM fused) WHERE n <= 5",
    "p1_fused": _RANKS.format(where="") + "SELECT query_id, asset_id, fused FROM fused",
    "p2_found": _PAIRS + "SELECT id_a, id_b FROM pairs",
    "p2_groups": _PAIRS
    + """, both_ways AS (SELECT id_a AS id, id_b AS other FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
reach(id, other) AS (SELECT DISTINCT id, id FROM both_ways UNION SELECT reach.id, b.other FROM reach JOIN both_ways b ON b.id = reach.other),
named AS (SELECT id, min(other) AS group_id FROM reach GROUP BY 1)
SELECT id, group_id, links FROM named JOIN (SELECT id, count(*) AS links FROM both_ways GROUP BY 1) USING (id)""",
    "p2_members": """
WITH h AS (SELECT id AS asset_id, max(lower(sha256)) AS sha FROM assets WHERE sha256 IS NOT NULL GROUP BY 1),
m AS (SELECT c.id, c.text, max(h.sha) AS digest FROM chunks c LEFT JOIN h USING (asset_id) WHERE c.id IS NOT NULL AND c.text IS NOT NULL GROUP BY 1, 2)
SELECT id, digest, min(id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS copies FROM m""",
}
