"""Metadata, entities, document type and summary of a text, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CAPS, DOCUMENT_TYPES, ENTITY_CONFIDENCE
from ..functions.patterns import all_matches, contains_any, pattern, sorted_distinct
from ..functions.text import amount_value, currency, entity_key


def emails(t: Column, unicode: bool = True) -> Column:
    return sorted_distinct(all_matches(t, "email", unicode=unicode))


def urls(t: Column, unicode: bool = True) -> Column:
    found = F.transform(all_matches(t, "url", unicode=unicode), lambda u: F.regexp_replace(u, r"[.,]+$", ""))
    return sorted_distinct(F.filter(found, lambda u: ~F.contains(u, F.lit("@"))))


def phones(t: Column) -> Column:
    found = F.transform(all_matches(t, "phone"), lambda p: F.trim(F.regexp_replace(p, r"\s+$", "")))
    return sorted_distinct(F.filter(found, lambda p: F.length(F.regexp_replace(p, r"[^0-9]", "")) >= 7))


def amounts(t: Column) -> Column:
    """Structs (raw, value, currency) in order; neighbours with equal text count once."""
    raws = F.transform(all_matches(t, "amount"), lambda a: F.trim(a))
    # beside each its neighbour before; the list itself is evaluated twice, not once for each element
    beside = F.zip_with(raws, F.concat(F.array(F.lit("")), raws), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    once = F.transform(F.filter(beside, lambda x: x["a"].isNotNull() & (x["a"] != x["b"])), lambda x: x["a"])
    one = lambda a: F.struct(a.alias("raw"), amount_value(F.regexp_extract(a, r"(\d[\d,]*(?:\.\d+)?)", 1)).alias("value"), currency(F.regexp_replace(a, r"[\d,\s]+(?:\.\d+)?", "")).alias("currency"))
    return F.slice(F.transform(once, one), 1, CAPS["amounts"])


def dates(t: Column, unicode: bool = True) -> Column:
    return sorted_distinct(F.concat(*[all_matches(t, f"date_{k}", unicode=unicode) for k in ("iso", "number", "text")]), CAPS["dates"])


def times(t: Column, unicode: bool = True) -> Column:
    return sorted_distinct(all_matches(t, "time", unicode=unicode), CAPS["times"])


def identifiers(t: Column, unicode: bool = True) -> Column:
    return sorted_distinct(all_matches(t, "identifier", unicode=unicode), CAPS["identifiers"])


def hashtags(t: Column) -> Column:
    return sorted_distinct(all_matches(t, "hashtag"))


def mentions(t: Column) -> Column:
    return sorted_distinct(all_matches(t, "mention", 1))


def locations(t: Column, unicode: bool = True) -> Column:
    return sorted_distinct(all_matches(t, "location", 1, unicode), CAPS["locations"])


def extract(df: DataFrame, text: str = "text", filename: str = "filename", unicode: bool = True) -> DataFrame:
    """Adds all metadata columns; the text is read together with the file's name."""
    h = F.concat_ws("\n", F.coalesce(F.col(filename), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return (
        df.withColumn("dates", dates(h, unicode))
        .withColumn("times", times(h, unicode))
        .withColumn("amounts", amounts(h))
        .withColumn("urls", urls(h, unicode))
        .withColumn("emails", emails(h, unicode))
        .withColumn("phone_numbers", phones(h))
        .withColumn("identifiers", identifiers(h, unicode))
        .withColumn("hashtags", hashtags(h))
        .withColumn("mentions", mentions(h))
        .withColumn("possible_locations", locations(h, unicode))
        .withColumn("possible_provider_names", F.array().cast("array<string>"))
        .withColumn("has_qr_code", F.lit(None).cast("boolean"))
    )


def entities(df: DataFrame, key: str, text: str = "text", unicode: bool = True, require_digit: bool = False, strict: bool = False) -> DataFrame:
    """(key, position, entity_type, raw_value, normalized_value, confidence): the first 40 of distinct typed values.

    Expects the columns of ``extract``. ``require_digit`` asks codes of ten characters to hold a digit; without it any
    word of ten letters is one. ``strict`` drops punctuation from keys, so that query terms can meet them."""
    t = F.coalesce(F.col(text), F.lit(""))
    typed = lambda values, kind: F.transform(values, lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("raw")))
    pnr = all_matches(t, "pnr", 1, unicode)
    if require_digit:
        pnr = F.filter(pnr, lambda v: v.rlike("[0-9]"))
    ends = F.zip_with(all_matches(t, "route", 1, unicode), all_matches(t, "route", 2, unicode), lambda a, b: F.array(F.struct(F.lit("origin").alias("entity_type"), a.alias("raw")), F.struct(F.lit("destination").alias("entity_type"), b.alias("raw"))))
    lists = F.concat(
        typed(pnr, "pnr"),
        *[typed(all_matches(t, k, 1, unicode), k) for k in ("train_number", "flight_number", "booking_id", "invoice_id")],
        F.flatten(ends),
        typed(F.col("dates"), "date"),
        typed(F.transform("amounts", lambda a: a["raw"]), "amount"),
    )
    keyed = F.filter(F.transform(lists, lambda e: F.struct(e["entity_type"].alias("entity_type"), F.trim(e["raw"]).alias("raw_value"), entity_key(e["raw"], strict).alias("normalized_value"))), lambda e: e["normalized_value"] != "")
    names = F.transform("keyed", lambda e: F.concat_ws("\x00", e["entity_type"], e["normalized_value"]))
    # columns of their own, as a list inside a function of elements would be evaluated for each element
    once = F.filter(F.arrays_zip("keyed", "names"), lambda e, i: F.array_position("names", e["names"]) == i + 1)
    table = F.create_map(*[F.lit(x) for kv in ENTITY_CONFIDENCE.items() for x in kv])
    return (
        df.select(key, keyed.alias("keyed"))
        .where(F.size("keyed") > 0)
        .withColumn("names", names)
        .select(key, F.posexplode(F.slice(once, 1, CAPS["entities"])).alias("position", "e"))
        .select(key, "position", "e.keyed.*")
        .withColumn("confidence", F.element_at(table, F.col("entity_type")))
    )


def classify(df: DataFrame, text: str = "text", filename: str = "filename", categories: str | None = None, unicode: bool = True, require_digit: bool = False) -> DataFrame:
    """Adds document_type, confidence and evidence: the type of the highest score whose cues or code occur."""
    t = F.coalesce(F.col(text), F.lit(""))
    cats = F.array_join(F.col(categories), " ") if categories else F.lit("")
    h = F.lower(F.concat_ws("\n", F.coalesce(F.col(filename), F.lit("")), t, cats))
    code = F.regexp_extract_all(t, F.lit(pattern("pnr", unicode)), F.lit(1))
    has_code = F.exists(code, lambda v: v.rlike("[0-9]")) if require_digit else F.size(code) > 0
    kind, score, evidence = F.lit("other"), F.lit(0.0), F.array().cast("array<string>")
    for name, value, cues in reversed(DOCUMENT_TYPES):
        fires = contains_any(h, cues)
        if name == "train_ticket":
            fires = fires | has_code
        if name == "flight_ticket":
            fires = fires | t.rlike(pattern("flight_number", unicode))
        kind, score = F.when(fires, name).otherwise(kind), F.when(fires, value).otherwise(score)
        evidence = F.when(fires, F.filter(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(h, c))).otherwise(evidence)
    return df.withColumn("document_type", kind).withColumn("confidence", score).withColumn("evidence", evidence)


def summary(filename: Column, categories: Column, dates_: Column, amounts_: Column, urls_: Column, identifiers_: Column, text: Column, document_type: Column) -> Column:
    """A searchable text of the facts; parts without facts are left out."""
    part = lambda label, values: F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, ", "), F.lit(".")))
    head = F.substring(text, 1, 400)
    return F.concat_ws(
        " ",
        F.concat(F.lit("Filename: "), filename, F.lit(".")),
        F.when(F.size(categories) > 0, F.concat(F.lit("Visual categories: "), F.translate(F.array_join(categories, ", "), "_", " "), F.lit("."))),
        part("Detected dates", dates_),
        part("Detected amounts", F.transform(amounts_, lambda a: a["raw"])),
        part("Detected URLs", urls_),
        part("Identifiers", identifiers_),
        F.when(F.trim(head) != "", F.concat(F.lit("OCR content: "), head)),
        F.concat(F.lit("Document type: "), F.translate(document_type, "_", " "), F.lit(".")),
    )
