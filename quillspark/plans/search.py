"""Hybrid search: ranking channels, weighted reciprocal rank fusion, evidence gate, results. Many queries at once.

A channel is a table (query_id, asset_id, score). All channels are one long table; ranks, fusion and the gate are one
grouping each, instead of one join per channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CHANNEL_LIMITS, MAX_RESULTS, RRF_K, SEMANTIC_MODERATE, WEIGHTS
from ..functions.text import content_terms, query_key, snippet
from ..operators.library import latest


BATCH = 20_000  # rows of the query side that are sent to every task at once


def against(rows: DataFrame, asked: DataFrame, condition) -> DataFrame:
    """Rows with the queries (or terms) they match by a condition that no key expresses.

    The query side is sent to every task, so its size is checked: a batch beyond ``BATCH`` rows is refused, not cut."""
    n = asked.limit(BATCH + 1).count()
    if n > BATCH:
        raise ValueError(f"a batch of queries may have {BATCH} rows here; ask in several batches")
    return rows.join(F.broadcast(asked), condition)


def filename_channel(plans: DataFrame, assets: DataFrame) -> DataFrame:
    """Share of a query's terms in file name and path, 1.0 when the whole phrase occurs. Terms meet names as substrings."""
    hay = F.lower(F.concat_ws(" ", "filename", "relative_path"))
    names = assets.select(F.col("id").alias("asset_id"), hay.alias("hay"))
    q = plans.where(F.size("terms") > 0).select("query_id", "terms", F.array_join("terms", " ").alias("phrase"))
    found = F.size(F.filter("terms", lambda t: F.contains(F.col("hay"), t)))
    score = F.when(F.contains(F.col("hay"), F.col("phrase")), 1.0).otherwise(found / F.size("terms"))
    return against(names, q, score > 0).select("query_id", "asset_id", score.alias("score"))


def metadata_channel(plans: DataFrame, metadata: DataFrame) -> DataFrame:
    """Number of a query's terms in an asset's identifiers, addresses, numbers and amounts."""
    values = F.concat("identifiers", "urls", "emails", "phone_numbers", F.transform("amounts", lambda a: a["raw"]))
    # each distinct value meets the terms; an asset's values never come together, however many chunks it has
    h = metadata.select("asset_id", F.explode(F.array_distinct(F.transform(values, lambda v: F.lower(v)))).alias("value")).distinct()
    terms = plans.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    return against(h, terms, F.contains(F.col("value"), F.col("term"))).groupBy("query_id", "asset_id").agg(F.count_distinct("term").cast("double").alias("score"))


def entity_channel(plans: DataFrame, entities: DataFrame) -> DataFrame:
    """Best confidence of an entity whose key is a query term's key."""
    keys = plans.select("query_id", F.explode("terms").alias("t")).select("query_id", query_key(F.col("t")).alias("normalized_value")).where("normalized_value is not null").distinct()
    return entities.join(keys, "normalized_value").groupBy("query_id", "asset_id").agg(F.max("confidence").alias("score"))


def tag_channel(plans: DataFrame, tags: DataFrame) -> DataFrame:
    """Best confidence of a tag that a query's term equals, begins, ends or is a word of, or that begins the term.

    Terms and labels meet on whole words: every word of a label is a key, so no label is compared with every term."""
    from ..functions.text import tag_terms

    terms = plans.select("query_id", F.explode(tag_terms(F.col("terms"))).alias("term")).distinct()
    words = tags.select("asset_id", "normalized_label", "confidence", F.explode(F.array_distinct(F.concat(F.split("normalized_label", " "), F.array("normalized_label")))).alias("term"))
    by_word = words.join(terms, "term").select("query_id", "asset_id", "confidence")
    # a term that starts with the label: labels meet terms on the term's first words
    firsts = terms.withColumn("w", F.split("term", " ")).where(F.size("w") > 1).select("query_id", "term", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.array_join(F.slice("w", 1, k), " "))).alias("normalized_label"))
    by_start = tags.join(firsts, "normalized_label").select("query_id", "asset_id", "confidence")
    # a label of several words around a phrase of several words
    several = terms.where("term like '% %'")
    inner = tags.where("normalized_label like '% %'").select("asset_id", "normalized_label", "confidence", F.explode(F.array_distinct(F.split("normalized_label", " "))).alias("w"))
    by_phrase = inner.join(several.withColumn("w", F.get(F.split("term", " "), F.lit(0))), "w").where(F.expr("concat(' ', normalized_label, ' ') like concat('% ', term, ' %')")).select("query_id", "asset_id", "confidence")
    return by_word.unionByName(by_start).unionByName(by_phrase).groupBy("query_id", "asset_id").agg(F.max("confidence").alias("score"))


def document_type_channel(plans: DataFrame, types: DataFrame) -> DataFrame:
    wanted = plans.select("query_id", F.explode("document_types").alias("document_type"))
    return types.join(F.broadcast(wanted), "document_type").groupBy("query_id", "asset_id").agg(F.max("confidence").alias("score"))  # one row per query and type


def best_chunks(scored: DataFrame) -> DataFrame:
    """Per (query, asset): best exact and semantic score, and the chunk where the greater of both is highest (the smallest id among equals)."""
    key = F.greatest("exact", "semantic")
    return scored.groupBy("query_id", "asset_id").agg(F.max("exact").alias("exact"), F.max(F.greatest("semantic", F.lit(0.0))).alias("semantic"), F.min_by("chunk_id", F.struct((-key).alias("k"), F.col("chunk_id").alias("i"))).alias("chunk_id"))


def rank_channels(channels: DataFrame) -> DataFrame:
    """Adds the zero-based ``rank`` inside each channel and cuts every channel to its limit."""
    limit = F.create_map(*[F.lit(x) for kv in CHANNEL_LIMITS.items() for x in kv])
    w = Window.partitionBy("query_id", "channel").orderBy(F.desc("score"), "asset_id")
    fine = channels.where(~F.isnan("score") & (F.col("score") > 0))
    ranked = fine.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < max(CHANNEL_LIMITS.values()))
    return ranked.where(F.col("rank") < F.element_at(limit, F.col("channel")))


def weight_table(spark) -> DataFrame:
    """(profile, channel, weight)."""
    return spark.createDataFrame([(p, c, float(x)) for p, row in WEIGHTS.items() for c, x in row.items()], "profile string, channel string, weight double")


def fuse(ranked: DataFrame, plans: DataFrame) -> DataFrame:
    """(query_id, asset_id, fused, <score of each channel>)."""
    spark = ranked.sparkSession
    named = [p for p in WEIGHTS if p != "other"]
    profile = plans.select("query_id", F.when(F.col("primary_intent").isin(*named), F.col("primary_intent")).otherwise("other").alias("profile"))
    weights = profile.join(F.broadcast(weight_table(spark)), "profile").select("query_id", "channel", "weight")
    part = F.coalesce(F.col("weight"), F.lit(0.0)) / (RRF_K + F.col("rank") + 1)
    return (
        ranked.join(weights, ["query_id", "channel"], "left")
        .groupBy("query_id", "asset_id")
        .agg(F.round(F.sum(part), 9).alias("fused"), *[F.coalesce(F.max(F.when(F.col("channel") == c, F.col("score"))), F.lit(0.0)).alias(c) for c in CHANNEL_LIMITS])
        .where("fused > 0")
    )


def strengths(fused: DataFrame) -> DataFrame:
    """Adds for each channel 0 none, 1 moderate, 2 strong, and the confidence; expects visual_query, document_query, n_terms."""
    c = F.col
    level = lambda strong, moderate: F.when(strong, 2).when(moderate, 1).otherwise(0)
    never = F.lit(False)
    out = {
        "exact": level(c("exact") > 0, never),
        "semantic": level(never, c("semantic") >= SEMANTIC_MODERATE),
        "visual": level(never, c("visual_query") & (c("visual") > 0)),
        "visual_tag": level(never, ~c("document_query") & ((c("visual_tag") >= 0.30) | (c("visual_query") & (c("visual_tag") >= 0.25)))),
        "metadata": level(c("metadata") >= 2, c("metadata") > 0),
        "filename": level((c("filename") >= 0.999) & (c("n_terms") >= 2), c("filename") > 0),
        "document_type": level(c("document_type") >= 0.80, c("document_type") > 0),
        "entity": level(c("entity") >= 0.80, c("entity") > 0),
    }
    named = F.array(*[F.struct(F.lit(n).alias("reason"), v.alias("strength")) for n, v in out.items()])
    with_levels = fused.withColumn("levels", named)
    strong, moderate = (F.size(F.filter("levels", lambda x: x["strength"] == k)) for k in (2, 1))
    confidence = F.when(strong >= 1, "strong").when(moderate >= 2, "moderate").when(c("visual_query") & (c("visual") > 0), "candidate")
    return with_levels.withColumn("confidence", confidence).withColumn("reasons", F.transform(F.filter("levels", lambda x: x["strength"] > 0), lambda x: x["reason"])).drop("levels")


def results(gated: DataFrame, briefs: DataFrame, n: int = MAX_RESULTS) -> DataFrame:
    """Best place of each content, first ``n`` per query, scores as shares of the query's best."""
    known = gated.where("confidence is not null").join(briefs, gated["asset_id"] == briefs["id"]).drop("id")
    rest = [x for x in known.columns if x not in ("query_id", "content_id")]
    # the greatest score, then the smallest id
    best = F.min_by(F.struct(*rest), F.struct((-F.col("fused")).alias("s"), F.col("asset_id").alias("i")))
    once = known.groupBy("query_id", "content_id").agg(best.alias("r")).select("query_id", "content_id", "r.*")
    w = Window.partitionBy("query_id").orderBy(F.desc("fused"), "asset_id")
    top = once.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
    most = F.max("fused").over(Window.partitionBy("query_id"))
    return top.withColumn("combined_score", F.round(F.least(F.greatest(F.col("fused") / most, F.lit(0.0)), F.lit(1.0)), 6))


def other_places(briefs: DataFrame) -> DataFrame:
    """(content_id, other_places)."""
    return briefs.groupBy("content_id").agg((F.count("*") - 1).alias("other_places"))


def diagnostics(ranked: DataFrame) -> DataFrame:
    """Per query and channel: candidates, best score; per row: raw score, rank and its fusion term."""
    n = F.count("*").over(Window.partitionBy("query_id", "channel"))
    return ranked.select("query_id", "channel", "asset_id", F.col("rank").alias("rank"), F.round("score", 6).alias("raw"), F.round(1 / (RRF_K + F.col("rank") + 1), 9).alias("term"), n.alias("candidates"))


def implied_filter(rows: DataFrame, plans: DataFrame, explicit: bool = False) -> DataFrame:
    """Where the query names a file type and the caller set no filter, only files of that type stay."""
    if explicit:
        return rows
    return rows.join(plans.select("query_id", "extensions"), "query_id").where((F.size("extensions") == 0) | F.coalesce(F.array_contains("extensions", F.lower("extension")), F.lit(False))).drop("extensions")


def with_snippets(rows: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    texts = latest(chunks.select(F.col("id").alias("chunk_id"), "text", "page_number"), ["chunk_id"], [F.col("text")])
    return rows.join(texts, "chunk_id", "left").join(queries.select("query_id", "query_text"), "query_id").withColumn("snippet", snippet(F.coalesce("text", F.lit("")), F.col("query_text"))).drop("text", "query_text")


__all__ = ["content_terms", "fuse", "rank_channels", "results", "strengths"]
