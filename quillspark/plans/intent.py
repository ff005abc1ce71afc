"""What a free-text query asks for: intents, terms, document labels, prompts. Deterministic expressions on a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    CATEGORY_WORDS,
    DATE_WORDS,
    DOCUMENT_EXPANSIONS,
    DOCUMENT_LABELS,
    DOCUMENT_PHRASES,
    FILE_TYPE_WORDS,
    FILENAME_WORDS,
    FOLDER_WORDS,
    STORED_TYPES,
    TEXTUAL_WORDS,
    VISUAL_WORDS,
)
from ..functions.patterns import contains_any, pattern
from ..functions.text import content_terms, visual_singular

PRIMARY_ORDER = ("exact_identifier", "visual", "category", "date_filtered", "amount_filtered", "mixed")


def _has(q: Column, words, word_boundary: bool) -> Column:
    if not word_boundary:
        return contains_any(q, words)
    import re

    return q.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(w) for w in words) + r")(?![\p{L}\p{N}])")


def implied_extensions(q: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(q, F.lit(w)), e) for w, e in FILE_TYPE_WORDS])))


def document_labels(q: Column) -> Column:
    """The label of the longest phrase that occurs (the last among equally long), else all labels of the broad words."""
    longest = F.lit(None).cast("string")
    for phrase, label in sorted(DOCUMENT_PHRASES, key=lambda p: len(p[0])):  # later ones go first
        longest = F.when(F.contains(q, F.lit(phrase)), label).otherwise(longest)
    broad = F.array_distinct(F.flatten(F.array_compact(F.array(*[F.when(F.contains(q, F.lit(w)), F.array(*[F.lit(x) for x in labels])) for w, labels in DOCUMENT_EXPANSIONS]))))
    return F.when(longest.isNotNull(), F.array(longest)).otherwise(broad)


def stored_types(labels: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STORED_TYPES.items() for x in kv])
    return F.array_distinct(F.array_compact(F.transform(labels, lambda x: F.try_element_at(table, x))))


def plan(queries: DataFrame, query: str = "query_text", word_boundary: bool = False) -> DataFrame:
    """Adds terms, intents, primary_intent, labels, primary_label, broad, extensions, visual_query, prompts, document_types.

    Intent words count wherever they occur, also inside words; ``word_boundary`` asks for whole words."""
    raw = F.trim(F.coalesce(F.col(query), F.lit("")))
    base = (
        queries.withColumn("q", F.lower(raw))
        .withColumn("terms", content_terms(F.col("q")))
        .withColumn("labels", document_labels(F.col("q")))
        .withColumn("extensions", implied_extensions(F.col("q")))
    )
    q = F.col("q")
    has = lambda words: _has(q, words, word_boundary)
    flags = {
        "exact_identifier": raw.rlike(pattern("query_identifier")),
        "amount_filtered": raw.rlike(pattern("query_amount")),
        "date_filtered": has(DATE_WORDS),
        "visual": has(VISUAL_WORDS),
        "filename": has(FILENAME_WORDS),
        "folder_filtered": has(FOLDER_WORDS),
        "file_type_filtered": F.size("extensions") > 0,
        "category": (F.size("labels") > 0) | has(CATEGORY_WORDS),
    }
    for name, cond in flags.items():
        base = base.withColumn(f"is_{name}", cond)
    structured = F.col("is_exact_identifier") | F.col("is_date_filtered") | F.col("is_amount_filtered") | F.col("is_filename") | F.col("is_folder_filtered") | F.col("is_file_type_filtered")
    short = (F.size("labels") == 0) & F.size("terms").between(1, 4) & ~contains_any(q, TEXTUAL_WORDS) & ~structured
    listed = [F.when(F.col(f"is_{n}"), n) for n in flags]
    semantic = F.when(q != "", "semantic_text")
    strong = sum((F.col(f"is_{n}").cast("int") for n in flags), F.lit(0))
    base = base.withColumn("visual_query", F.col("is_visual") | short).withColumn("strong", strong)
    # a short description turns visual after the mixed intent was decided once, so it may come behind it
    mixed_first = F.when(F.col("strong") >= 2, "mixed")
    turned = F.when(~F.col("is_visual") & F.col("visual_query"), "visual")
    mixed_then = F.when((F.col("strong") < 2) & (F.col("strong") + F.when(turned.isNotNull(), 1).otherwise(0) >= 2), "mixed")
    base = base.withColumn("intents", F.array_compact(F.array(*listed, semantic, mixed_first, turned, mixed_then)))
    primary = F.lit("semantic_text")
    for name in reversed(PRIMARY_ORDER):
        primary = F.when(F.array_contains("intents", name), name).otherwise(primary)
    phrase = F.array_join(F.transform("terms", visual_singular), " ")
    prompts = F.when(F.col("visual_query") & (phrase != ""), F.array(phrase, F.concat(F.lit("a photo of "), phrase))).otherwise(F.array(raw))
    n = F.size("labels")
    return (
        base.withColumn("primary_intent", primary)
        .withColumn("broad", n > 1)
        .withColumn("primary_label", F.when(n == 1, F.get("labels", F.lit(0))))
        .withColumn("exact_phrase", F.when(F.size("terms") >= 2, F.array_join("terms", " ")))
        .withColumn("prompts", prompts)
        .withColumn("document_types", stored_types(F.col("labels")))
        .withColumn("document_query", F.exists("labels", lambda x: x.isin(*DOCUMENT_LABELS)))
        .drop("q", "strong", *[f"is_{n}" for n in flags])
    )
