"""Pattern extraction as columns.

``unicode`` word boundaries look at letters and digits of any script, ASCII ones only at [0-9A-Za-z_], as engines
without Unicode tables do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PATTERNS


def pattern(name: str, unicode: bool = True) -> str:
    if unicode:
        return "(?U)" + PATTERNS[name]
    edge = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    return PATTERNS[name].replace(r"\b", edge)


def all_matches(text: Column, name: str, group: int = 0, unicode: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern(name, unicode)), F.lit(group))


def sorted_distinct(values: Column, most: int | None = None) -> Column:
    out = F.array_sort(F.array_distinct(values))
    return F.slice(out, 1, most) if most else out


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out
