"""Tokens, BM25, snippets, query plans, channels, fusion, gate, hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import STOP_WORDS, WEIGHTS
from ..functions.text import content_terms, snippet, tag_singular, visual_singular
from ..operators import chunking, library, metadata, postings
from ..plans import intent
from ..plans import search as S
from .common import ASSETS, CHUNKS, assets, chunks, table

Q: dict = {}
O: dict = {}  # noqa: E741


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


#: queries of several terms over texts of the library
TEXTS = ("kettle schedule", "garden plan", "the missing voucher in march", "rosé façade", "warranty ends", "ORD36525 folder", "curtain", "Książka na półce")
_VALUES = ", ".join(f"({k}, '{t}')" for k, t in enumerate(TEXTS))
TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}\p{Co}]+'), lambda x: x <> '')"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
TERMS = rf"list_filter(regexp_split_to_array(lower(query_text), '[^\p{{L}}\p{{N}}]+'), lambda x: strlen(x) > 2 AND NOT list_contains([{_STOP}], x))"
_DISTINCT = "list_filter(list_transform({x}, lambda v, i: CASE WHEN list_position({x}, v) = i THEN v END), lambda v: v IS NOT NULL)"
BM25 = rf"""
qs AS (SELECT q AS query_id, {_DISTINCT.format(x='t')} AS terms FROM (SELECT q, {TERMS} AS t FROM (VALUES {_VALUES}) AS v(q, query_text))),
tok AS (SELECT doc_id, {TOKENS} AS tokens FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
post AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS token FROM tok) GROUP BY 1, 2),
part AS (SELECT query_id, len(terms) AS k, unnest(terms) AS term FROM qs),
pre AS (SELECT p.query_id, p.k, p.term, post.doc_id, sum(tf) AS f FROM part p JOIN post ON starts_with(post.token, p.term) GROUP BY ALL),
npre AS (SELECT query_id, term, count(*) AS n FROM pre GROUP BY 1, 2),
cand AS (SELECT query_id, doc_id FROM pre GROUP BY query_id, doc_id, k HAVING count(*) = k),
phr AS (SELECT c.query_id, c.doc_id, len(list_filter(range(1, len(tokens) - len(terms) + 2), lambda i: tokens[i:i + len(terms) - 1] = terms)) AS f
        FROM cand c JOIN tok USING (doc_id) JOIN qs USING (query_id) WHERE len(terms) > 1),
nphr AS (SELECT query_id, count(*) AS n FROM phr WHERE f > 0 GROUP BY 1),
units AS (SELECT query_id, doc_id, f, n FROM pre JOIN npre USING (query_id, term) JOIN cand USING (query_id, doc_id)
          UNION ALL SELECT query_id, doc_id, f, n FROM phr JOIN nphr USING (query_id) WHERE f > 0),
bm AS (SELECT query_id, doc_id, greatest(0.0::DOUBLE, sum((CASE WHEN ln((st.n - units.n + 0.5) / (units.n + 0.5)) > 0 THEN ln((st.n - units.n + 0.5::DOUBLE) / (units.n + 0.5::DOUBLE)) ELSE 1e-6 END)
          * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(tokens) / avgdl)))) AS score
       FROM units JOIN tok USING (doc_id), st GROUP BY 1, 2)"""


def _queries(spark):
    q = spark.createDataFrame(list(enumerate(TEXTS)), "query_id int, query_text string")
    return q.withColumn("terms", content_terms(F.col("query_text")))


def _tokens(spark, d):
    return postings.tokenised(table(spark, d, "documents"), "doc_id")


@query(f"WITH tok AS (SELECT {TOKENS} AS tokens FROM documents WHERE text IS NOT NULL), u AS (SELECT unnest(tokens) AS token, row_number() OVER () AS r FROM tok) SELECT token, count(DISTINCT r) AS df, count(*) AS cf FROM (SELECT r, unnest(tokens) AS token FROM (SELECT tokens, row_number() OVER () AS r FROM tok)) GROUP BY 1")
def term_document_frequency(spark, d):
    return postings.document_frequency(_tokens(spark, d))


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM bm")
def bm25_conjunction(spark, d):
    return postings.bm25(_tokens(spark, d), "doc_id", _queries(spark)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {BM25}, k AS (SELECT query_id, doc_id, round(score, 6) AS score, sha256(text) AS content FROM bm JOIN documents USING (doc_id)),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY score DESC, doc_id) AS n FROM k),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS position FROM o WHERE n = 1)
    SELECT query_id, position, doc_id, score FROM t WHERE position <= 20"""
)
def bm25_top20(spark, d):
    """Best document of each content, the first 20 per query."""
    from pyspark.sql import Window

    scored = postings.bm25(_tokens(spark, d), "doc_id", _queries(spark)).withColumn("score", F.round("score", 6))
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content"))
    once = scored.join(docs, "doc_id").groupBy("query_id", "content").agg(F.min_by(F.struct("doc_id", "score"), F.struct((-F.col("score")).alias("s"), F.col("doc_id").alias("i"))).alias("r")).select("query_id", "r.*")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return once.withColumn("position", F.row_number().over(w)).where("position <= 20").select("query_id", "position", "doc_id", "score")


@query(
    """WITH w AS (SELECT doc_id, text, list_filter(list_transform(['kettle', 'garden', 'march'], lambda x: strpos(lower(text), x)), lambda p: p > 0) AS places FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, text, greatest(coalesce(places[1], 1) - 80, 1) AS st FROM w)
    SELECT doc_id, (CASE WHEN st > 1 THEN '…' ELSE '' END) || substring(text, st, 420) || (CASE WHEN st + 419 < length(text) THEN '…' ELSE '' END) AS snippet FROM s"""
)
def snippet_window(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", snippet(F.col("text"), F.lit("Kettle garden March")).alias("snippet"))


_W = r"list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"


@query(
    f"""WITH w AS (SELECT id, {_W} AS w FROM (SELECT DISTINCT id, text FROM chunks) WHERE text IS NOT NULL),
    n AS (SELECT id, w, CASE WHEN len(w) > 0 THEN 1 + ceil(greatest(len(w) - 350, 0) / 290.0)::INT ELSE 0 END AS n FROM w)
    SELECT id, k::INT AS chunk_index, array_to_string(w[k * 290 + 1:k * 290 + 350], ' ') AS text FROM (SELECT id, w, unnest(range(n)) AS k FROM n)"""
)
def chunk_350_60(spark, d):
    return chunking.word_windows(chunks(spark, d), ["id"]).select("id", "chunk_index", "text")


@query(
    r"""WITH l AS (SELECT id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\t\r\f\x0B]', ' ', 'g'))), lambda x: x <> '') AS l
      FROM (SELECT DISTINCT id, text, source FROM chunks) WHERE lower(source) LIKE 'ocr%'),
    g AS (SELECT id, l, unnest(range(0, (len(l) - 1) // 5 + 1)) AS k FROM l WHERE len(l) > 5)
    SELECT id, k::INT AS group_index, array_to_string(l[k * 5 + 1:k * 5 + 5], chr(10)) AS text FROM g
    WHERE length(regexp_replace(array_to_string(l[k * 5 + 1:k * 5 + 5], chr(10)), '[^\p{L}\p{N}]+', '', 'g')) >= 8"""
)
def regional_chunks(spark, d):
    scans = chunks(spark, d).where(F.lower("source").startswith("ocr"))
    return chunking.line_groups(scans, ["id"]).select("id", "group_index", "text")


@query(f"WITH {CHUNKS} SELECT asset_id, string_agg(text, chr(10) ORDER BY chunk_index, id) AS text FROM c WHERE text IS NOT NULL GROUP BY 1")
def asset_text_concat(spark, d):
    return chunking.asset_texts(chunks(spark, d))


_SIZES = [(1, 800, 600), (2, 5000, 3000), (3, 1080, 7000), (4, 4000, 900), (5, 900, 3900), (6, 1024, 288), (7, 1024, 280), (8, 20000, 20000), (9, 4096, 1151), (10, 300, 4097)]
_SV = ", ".join(map(str, _SIZES))


@query(
    f"""WITH s AS (SELECT * FROM (VALUES {_SV}) AS t(id, w, h)), p AS (SELECT *, greatest(w, h) AS l, greatest(w, h)::DOUBLE / least(w, h) AS a, ceil(w / 1536.0)::INT AS cols, ceil(h / 1536.0)::INT AS rows FROM s),
    g AS (SELECT id, r * cols + c AS k, 'grid' AS kind, c * w // cols AS x, r * h // rows AS y, (c + 1) * w // cols - c * w // cols AS rw, (r + 1) * h // rows - r * h // rows AS rh
      FROM (SELECT *, unnest(range(cols)) AS c FROM (SELECT *, unnest(range(rows)) AS r FROM p WHERE l > 4096))),
    n AS (SELECT *, least(greatest(ceil(a / (8.0::DOUBLE / 3))::INT, 2), 11) AS m FROM p WHERE l <= 4096 AND l >= 1024 AND a > 32.0::DOUBLE / 9),
    z AS (SELECT id, k, 'aspect' AS kind, CASE WHEN h >= w THEN 0 ELSE k * l // m END AS x, CASE WHEN h >= w THEN k * l // m ELSE 0 END AS y,
      CASE WHEN h >= w THEN w ELSE (k + 1) * l // m - k * l // m END AS rw, CASE WHEN h >= w THEN (k + 1) * l // m - k * l // m ELSE h END AS rh FROM (SELECT *, unnest(range(m)) AS k FROM n))
    SELECT id, -1 AS region_id, 'whole' AS kind, 0 AS x, 0 AS y, w AS region_width, h AS region_height FROM s
    UNION ALL SELECT id, (-k - 2)::INT, kind, x::INT, y::INT, rw::INT, rh::INT FROM (SELECT * FROM g UNION ALL SELECT * FROM z) WHERE k < 11"""
)
def image_regions(spark, d):
    return chunking.image_regions(spark.createDataFrame(_SIZES, "id int, width int, height int"), "id")


def _asked(spark, d):
    return table(spark, d, "search_results").select("query_id", "query_text").distinct()


def _any(words, col="q"):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


@query(rf"SELECT query_id, {_DISTINCT.format(x='t')} AS terms FROM (SELECT DISTINCT query_id, {TERMS} AS t FROM search_results)")
def query_terms(spark, d):
    return _asked(spark, d).select("query_id", content_terms(F.col("query_text")).alias("terms"))


def _labels_sql() -> str:
    from ..constants import DOCUMENT_EXPANSIONS, DOCUMENT_PHRASES

    ordered = sorted(DOCUMENT_PHRASES, key=lambda p: len(p[0]), reverse=True)
    case = " ".join(f"WHEN contains(q, '{p}') THEN ['{x}']" for p, x in ordered)
    broad = " || ".join(f"(CASE WHEN contains(q, '{w}') THEN {list(x)} ELSE [] END)" for w, x in DOCUMENT_EXPANSIONS)
    return f"CASE {case} ELSE list_sort(list_distinct({broad})) END"


@query(f"SELECT query_id, {_labels_sql()} AS labels, len({_labels_sql()}) > 1 AS broad FROM (SELECT DISTINCT query_id, lower(trim(query_text)) AS q FROM search_results)")
def document_expansion(spark, d):
    return intent.plan(_asked(spark, d)).select("query_id", F.sort_array("labels").alias("labels"), "broad")


def _primary_sql() -> str:
    from ..constants import CATEGORY_WORDS, DATE_WORDS, FILE_TYPE_WORDS, FILENAME_WORDS, FOLDER_WORDS, TEXTUAL_WORDS, VISUAL_WORDS

    return rf"""WITH b AS (SELECT DISTINCT query_id, trim(query_text) AS raw, lower(trim(query_text)) AS q, {TERMS} AS tt FROM search_results),
    l AS (SELECT *, len({_DISTINCT.format(x='tt')}) AS nt, {_labels_sql()} AS labels FROM b),
    f AS (SELECT *, regexp_matches(raw, '(?i)\b(?:[A-Z]{{2,}}[-_/ ]?\d{{2,}}[A-Z0-9-]*|\d{{4,}}|#[A-Z0-9]{{3,}})\b') AS ident,
      regexp_matches(raw, '(?i)(?:(?:₹|\$|€|£|rs\.?|usd|inr|eur|gbp)\s?\d|(?:\d[\d,]*\.?\d*)\s?(?:₹|\$|€|£|rupees|dollars|euros))') AS amount,
      {_any(DATE_WORDS)} AS dat, {_any(VISUAL_WORDS)} AS vis, {_any(FILENAME_WORDS)} AS fname, {_any(FOLDER_WORDS)} AS fold, {_any([w for w, _ in FILE_TYPE_WORDS])} AS ftype,
      len(labels) > 0 OR {_any(CATEGORY_WORDS)} AS cat FROM l),
    v AS (SELECT *, vis OR (len(labels) = 0 AND nt BETWEEN 1 AND 4 AND NOT {_any(TEXTUAL_WORDS)} AND NOT (ident OR dat OR amount OR fname OR fold OR ftype)) AS visual_query FROM f)
    SELECT query_id, CASE WHEN ident THEN 'exact_identifier' WHEN visual_query THEN 'visual' WHEN cat THEN 'category' WHEN dat THEN 'date_filtered' WHEN amount THEN 'amount_filtered'
      WHEN fname::INT + fold::INT + ftype::INT >= 2 THEN 'mixed' ELSE 'semantic_text' END AS primary_intent, visual_query FROM v"""


@query(_primary_sql())
def primary_intent(spark, d):
    return intent.plan(_asked(spark, d)).select("query_id", "primary_intent", "visual_query")


@query()
def query_plan(spark, d):
    """The whole plan; its parts have SQL of their own."""
    return intent.plan(_asked(spark, d)).drop("query_text")


_WORDS = ("classes", "boxes", "photos", "stories", "bus", "glass", "ties", "cats", "series", "buses", "is", "status")


@query(
    "WITH w AS (SELECT unnest(" + str(list(_WORDS)) + ") AS w) SELECT w, CASE WHEN strlen(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN strlen(w) > 4 AND (w LIKE '%sses' OR w LIKE '%xes') THEN w[:-3] "
    "WHEN strlen(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' AND w NOT LIKE '%us' THEN w[:-2] ELSE w END AS visual, "
    "CASE WHEN strlen(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN strlen(w) > 3 AND w LIKE '%es' THEN w[:-3] WHEN strlen(w) > 3 AND w LIKE '%s' THEN w[:-2] ELSE w END AS tag FROM w"
)
def singular_forms(spark, d):
    w = spark.createDataFrame([(x,) for x in _WORDS], "w string")
    return w.select("w", visual_singular(F.col("w")).alias("visual"), tag_singular(F.col("w")).alias("tag"))


def _plans(spark):
    return intent.plan(spark.createDataFrame([(0, "dinner notes pdf"), (1, "trip plan agenda"), (2, "meeting record"), (3, "storage guide invoice"), (4, "kettle"), (5, "ORD36525 warranty")], "query_id int, query_text string"))


_P = "(0, ['dinner', 'notes', 'pdf']), (1, ['trip', 'plan', 'agenda']), (2, ['meeting', 'record']), (3, ['storage', 'guide', 'invoice']), (4, ['kettle']), (5, ['ord36525', 'warranty'])"


@query(
    f"""WITH {ASSETS}, p AS (SELECT * FROM (VALUES {_P}) AS t(query_id, terms)), h AS (SELECT id, lower(filename || ' ' || relative_path) AS hay FROM a)
    SELECT query_id, id AS asset_id, round(score, 6) AS score FROM (SELECT query_id, id, CASE WHEN contains(hay, array_to_string(terms, ' ')) THEN 1.0::DOUBLE
      ELSE len(list_filter(terms, lambda t: contains(hay, t)))::DOUBLE / len(terms) END AS score FROM p, h) WHERE score > 0"""
)
def filename_channel(spark, d):
    return S.filename_channel(_plans(spark), assets(spark, d)).select("query_id", "asset_id", F.round("score", 6).alias("score"))


_TAG_TERMS = ("kettle", "garden", "mirror", "receipt", "curtain call", "orchard")


@query(
    "WITH q AS (SELECT unnest(" + str(list(_TAG_TERMS)) + """) AS term), t AS (SELECT DISTINCT asset_id, unnest(string_split(text, ', ')) AS label FROM chunks WHERE source = 'visual_tags')
    SELECT DISTINCT term, asset_id FROM t, q WHERE label = term OR label LIKE term || ' %' OR label LIKE '% ' || term OR label LIKE '% ' || term || ' %' OR term LIKE label || ' %'"""
)
def tag_like_match(spark, d):
    terms = spark.createDataFrame([(k, t) for k, t in enumerate(_TAG_TERMS)], "query_id int, term string")
    tags = chunks(spark, d).where("source = 'visual_tags'").select("asset_id", F.explode(F.split("text", ", ")).alias("normalized_label")).withColumn("confidence", F.lit(0.5))
    hits = S.tag_channel(terms.select("query_id", F.split("term", " ").alias("terms")), tags)
    # words of a term count for themselves in the channel; here the whole term is asked for
    words = tags.join(F.broadcast(terms), F.expr("concat(' ', normalized_label, ' ') like concat('% ', term, ' %') or term like concat(normalized_label, ' %')"))
    return words.join(hits.select("query_id", "asset_id"), ["query_id", "asset_id"], "left_semi").select("term", "asset_id").distinct()


_WEIGHTS_SQL = "w AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c}', {x}::DOUBLE)" for p, row in WEIGHTS.items() for c, x in row.items()) + ") AS t(profile, channel, weight))"
_CHANNELS_SQL = """s AS (SELECT DISTINCT query_id, asset_id, semantic_score, keyword_score, visual_score FROM search_results),
    ch AS (SELECT query_id, 'semantic' AS channel, asset_id, round(semantic_score, 6) AS score FROM s UNION ALL SELECT query_id, 'exact', asset_id, round(keyword_score, 6) FROM s
      UNION ALL SELECT query_id, 'visual', asset_id, round(visual_score, 6) FROM s),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, asset_id) - 1 AS rank FROM ch WHERE score > 0 AND NOT isnan(score)),
    rc AS (SELECT * FROM rk WHERE rank < CASE channel WHEN 'visual' THEN 100 ELSE 50 END)"""


def _score_channels(spark, d):
    s = table(spark, d, "search_results").select("query_id", "asset_id", "semantic_score", "keyword_score", "visual_score").distinct()
    named = (("semantic", "semantic_score"), ("exact", "keyword_score"), ("visual", "visual_score"))
    return s.select("query_id", "asset_id", F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), F.round(c, 6).alias("score")) for n, c in named])).alias("x")).select("query_id", "x.channel", "asset_id", "x.score")


@query(f"WITH {_CHANNELS_SQL} SELECT query_id, channel, asset_id, rank::INT AS rank, score AS raw, round(1.0::DOUBLE / (61 + rank), 9) AS term, count(*) OVER (PARTITION BY query_id, channel) AS candidates FROM rc")
def channel_diagnostics(spark, d):
    return S.diagnostics(S.rank_channels(_score_channels(spark, d)))


_FUSED_SQL = f"""{_CHANNELS_SQL}, {_WEIGHTS_SQL},
    fu AS (SELECT query_id, asset_id, round(sum(coalesce(weight, 0) / (61 + rank)), 9) AS fused, coalesce(max(score) FILTER (rc.channel = 'exact'), 0) AS exact,
      coalesce(max(score) FILTER (rc.channel = 'semantic'), 0) AS semantic, coalesce(max(score) FILTER (rc.channel = 'visual'), 0) AS visual
      FROM rc LEFT JOIN w ON w.profile = 'visual' AND w.channel = rc.channel GROUP BY 1, 2)"""


def _fused(spark, d):
    ch = _score_channels(spark, d)
    plans = _asked(spark, d).select("query_id").distinct().withColumn("primary_intent", F.lit("visual"))
    return S.fuse(S.rank_channels(ch), plans)


@query(f"WITH {_FUSED_SQL} SELECT query_id, asset_id, fused FROM fu")
def rrf_fusion(spark, d):
    return _fused(spark, d).select("query_id", "asset_id", "fused")


@query(
    f"""WITH {_FUSED_SQL} SELECT query_id, asset_id, CASE WHEN exact > 0 THEN 'strong' WHEN (semantic >= 0.85)::INT + (visual > 0)::INT >= 2 THEN 'moderate' WHEN visual > 0 THEN 'candidate' END AS confidence FROM fu"""
)
def evidence_gate(spark, d):
    ready = _fused(spark, d).withColumn("visual_query", F.lit(True)).withColumn("document_query", F.lit(False)).withColumn("n_terms", F.lit(2))
    return S.strengths(ready).select("query_id", "asset_id", "confidence")


@query(
    f"""WITH {ASSETS}, {_FUSED_SQL}, g AS (SELECT fu.*, coalesce(a.content_id, a.id) AS content FROM fu JOIN a ON a.id = fu.asset_id WHERE exact > 0 OR visual > 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY fused DESC, asset_id) AS n FROM g),
    t AS (SELECT query_id, asset_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, asset_id) AS position, max(fused) OVER (PARTITION BY query_id) AS best FROM o WHERE n = 1)
    SELECT query_id, position, asset_id, round(least(greatest(fused / best, 0), 1), 6) AS combined_score FROM t WHERE position <= 20"""
)
def fused_results(spark, d):
    ready = _fused(spark, d).withColumn("visual_query", F.lit(True)).withColumn("document_query", F.lit(False)).withColumn("n_terms", F.lit(2))
    shown = assets(spark, d).select("id", F.coalesce("content_id", "id").alias("content_id"))
    return S.results(S.strengths(ready), shown).select("query_id", "position", "asset_id", "combined_score")


ASKED = (*TEXTS, "dinner notes pdf", "photo of a lighthouse", "train ticket")


def _stored_vectors(spark, d, profile: str):
    """A vector for each query of the batch: query k takes the k-th usable chunk's of the profile, in the order of ids."""
    usable = chunks(spark, d).where((F.col("embedding_profile_id") == profile) & (F.size("embedding") == F.col("embedding_dimensions"))).where("not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    first = usable.orderBy("id").limit(len(ASKED)).select("id", "embedding").collect()  # one row per query
    return spark.createDataFrame([(k, [float(x) for x in r["embedding"]]) for k, r in enumerate(first)], "query_id long, q array<double>")


@query()
def hybrid_search(spark, d):
    """The flagship: all eight channels over the library for a batch of queries; its parts have SQL of their own.

    No model runs here, so the queries' vectors are stored ones; pictures' regions are the chunks of images."""
    from ..api import Engine

    e = Engine(spark, d)
    asked = spark.createDataFrame(list(enumerate(ASKED)), "query_id long, query_text string")
    images = assets(spark, d).where(library.is_image(F.col("extension"))).select(F.col("id").alias("asset_id"))
    regions = chunks(spark, d).where("embedding_profile_id = 'txt-base/v2' and size(embedding) = embedding_dimensions").join(images, "asset_id", "left_semi").select("asset_id", (-F.col("chunk_index") - 1).alias("region_id"), "embedding")
    return e.search(asked, vectors=_stored_vectors(spark, d, "txt-base/v3"), regions=regions, prompts=_stored_vectors(spark, d, "txt-base/v2"))


_IMPLIED = "CASE WHEN contains(q, 'pdf') THEN lower(extension) = 'pdf' WHEN contains(q, 'markdown') THEN lower(extension) = 'md' ELSE true END"


@query(f"WITH s AS (SELECT DISTINCT query_id, asset_id, extension, CASE query_id % 3 WHEN 0 THEN 'the pdf' WHEN 1 THEN 'markdown file' ELSE 'plain' END AS q FROM search_results) SELECT query_id, asset_id FROM s WHERE coalesce({_IMPLIED}, false)")
def implied_extension_filter(spark, d):
    s = table(spark, d, "search_results").select("query_id", "asset_id", "extension").distinct()
    q = s.select("query_id").distinct().withColumn("query_text", F.when(F.col("query_id") % 3 == 0, "the pdf").when(F.col("query_id") % 3 == 1, "markdown file").otherwise("plain"))
    return S.implied_filter(s, intent.plan(q)).select("query_id", "asset_id")


@query(
    f"""WITH {CHUNKS}, m AS (SELECT asset_id, list_distinct(flatten(list(regexp_extract_all(text, '(?i)\\b(?:[A-Z]{{2,}}[-_/]?\\d{{3,}}[A-Z0-9-]*|#[A-Z0-9]{{3,}}|\\d{{5,}})\\b')))) AS ids FROM c WHERE text IS NOT NULL GROUP BY 1)
    SELECT asset_id, count(*)::INT AS n FROM (SELECT asset_id, unnest(ids) AS v FROM m) WHERE contains(lower(v), 'ord3') OR contains(lower(v), 'rk-4') GROUP BY 1"""
)
def identifier_haystack(spark, d):
    """Identifiers of an asset that contain a query's terms: the metadata channel's haystack."""
    ids = chunks(spark, d).where("text is not null").select("asset_id", metadata.all_matches(F.col("text"), "identifier", unicode=False).alias("ids"))
    rows = ids.select("asset_id", F.explode("ids").alias("v")).distinct()
    return rows.where(F.lower("v").contains("ord3") | F.lower("v").contains("rk-4")).groupBy("asset_id").agg(F.count("*").cast("int").alias("n"))


QUERIES, ORACLE = Q, O
