"""Normalisation of text, terms, tags, entity keys and amounts as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CURRENCY_CODES, SNIPPET_BEFORE, SNIPPET_LENGTH, STOP_WORDS


def _folds() -> tuple[str, str]:
    """Letters whose canonical decomposition is a base letter with marks, and their base letters."""
    a, b = [], []
    for k in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(k))
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if len(parts) > 1 and len(base) == 1:
            a.append(chr(k))
            b.append(base)
    return "".join(a), "".join(b)


_FROM, _TO = _folds()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    low = F.lower(text)
    # most texts are plain, and the letter by letter translation is the dear part
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(F.regexp_replace(low, r"\p{Mn}+", ""), _FROM, _TO)).otherwise(low)


def tokens(text: Column) -> Column:
    """Runs of letters, digits and private-use characters, folded."""
    return F.array_remove(F.split(fold(text), r"[^\p{L}\p{N}\p{Co}]+"), "")


def content_terms(query: Column) -> Column:
    """Distinct terms of more than two bytes that are no stop words, in order."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}]+"), lambda t: (F.octet_length(t) > 2) & ~F.array_contains(stop, t)))


def _drop(t: Column, n: int) -> Column:
    return F.substring(t, F.lit(1), F.greatest(F.length(t) - n, F.lit(0)))


def visual_singular(t: Column) -> Column:
    n = F.octet_length(t)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(_drop(t, 3), F.lit("y")))
        .when((n > 4) & (t.endswith("sses") | t.endswith("xes")), _drop(t, 2))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss") & ~t.endswith("us"), _drop(t, 1))
        .otherwise(t)
    )


def tag_singular(t: Column) -> Column:
    n = F.octet_length(t)
    return F.when((n > 4) & t.endswith("ies"), F.concat(_drop(t, 3), F.lit("y"))).when((n > 3) & t.endswith("es"), _drop(t, 2)).when((n > 3) & t.endswith("s"), _drop(t, 1)).otherwise(t)


def normalise_tag(label: Column) -> Column:
    """Anything but letters and digits is one space; only ASCII letters change case."""
    spaced = F.trim(F.regexp_replace(label, r"[^\p{L}\p{N}]+", " "))
    return F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tag_terms(terms: Column) -> Column:
    """Every term, its singular, and all terms as one phrase if there are several."""
    phrase = F.when(F.size(terms) > 1, F.array(F.array_join(terms, " "))).otherwise(F.array().cast("array<string>"))
    both = F.flatten(F.transform(terms, lambda t: F.array(t, tag_singular(t))))
    return F.filter(F.array_distinct(F.transform(F.concat(both, phrase), normalise_tag)), lambda t: t != "")


def entity_key(raw: Column, strict: bool = False) -> Column:
    """Key of a stored entity: upper case without white space; ``strict`` drops punctuation too."""
    return F.upper(F.regexp_replace(raw, r"[^\p{L}\p{N}]+" if strict else r"\s+", ""))


def query_key(term: Column) -> Column:
    """Key of a query term: letters and digits, upper case; null under three bytes."""
    key = F.upper(F.regexp_replace(term, r"[^\p{L}\p{N}]+", ""))
    return F.when(F.octet_length(key) >= 3, key)


def currency(sign: Column) -> Column:
    s = F.lower(F.trim(sign))
    out = F.lit(None).cast("string")
    for word, code in CURRENCY_CODES.items():
        out = F.when(s == word, code).otherwise(out)
    return out


def amount_value(digits: Column) -> Column:
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double")


def merge_lines(first: Column, second: Column) -> Column:
    """Lines of two readings of one page: a line whose letters and digits (three bytes or more) came before is dropped."""
    lines = F.concat(F.split(first, "\n"), F.split(second, "\n"))
    keyed = F.filter(F.transform(lines, lambda x: F.struct(F.trim(x).alias("line"), F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")).alias("key"))), lambda x: F.octet_length(x["key"]) >= 3)
    keys = F.transform(keyed, lambda x: x["key"])
    first_ones = F.filter(keyed, lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    return F.array_join(F.transform(first_ones, lambda x: x["line"]), "\n")


def snippet(text: Column, query: Column) -> Column:
    """A window around the first query word (in the query's order) that the text contains, with ellipses at cut sides."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    places = F.filter(F.transform(words, lambda w: F.position(w, F.lower(text))), lambda p: p > 0)
    at = F.coalesce(F.get(places, F.lit(0)), F.lit(1))
    start = F.greatest(at - SNIPPET_BEFORE, F.lit(1))
    body = F.substring(text, start, F.lit(SNIPPET_LENGTH))
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + SNIPPET_LENGTH - 1 < F.length(text), "…").otherwise(""))
