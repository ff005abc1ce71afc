"""Texts that were decoded with the wrong character encoding.

A text may have gone through a chain of steps, each of them bytes of one encoding read as another. Every chain that can
be undone gives a candidate text. Candidates are compared by description length: the size of the text when compressed
with a zstandard dictionary of its language (the best of all), plus a cost for each step. The shortest wins; where no
candidate is shorter, the text is left unchanged. Chains grow step by step, so twice misread texts and texts with
parts that were misread in different ways are undone as well.

  * UTF-8 read as a one-byte encoding leaves character groups that map back to valid UTF-8; only such groups change.
  * One one-byte encoding read as another always maps back; such steps are tried on single sentences and lines, and
    only where the letters look like it, and must save more.
  * A replacement character marks what is lost: the text is found, but that place stays as it is.

Defined results: null and plain ASCII texts are never found; texts of any length are treated whole; an empty table
gives no rows; repeated rows count once; the dictionaries come from at most ``per_language`` texts of each language,
chosen by hash, and an empty or missing set of training texts gives an empty dictionary; other columns are ignored.

Scale: one map over the rows without a shuffle of texts; what is broadcast is one dictionary of at most
twice ``dictionary_bytes`` for each of ``languages`` languages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: one-byte encodings in which UTF-8 is commonly misread, most likely first
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250")
#: (true, read as) pairs of one-byte encodings, with a pattern of letters that calls for a trial
SWAPS = (
    ("cp1251", "cp1252", r"[À-ÿ¸¨]{3,}"),
    ("koi8-r", "cp1252", r"[À-ÿ£³]{3,}"),
    ("koi8-r", "cp1251", r"[а-яё][А-ЯЁ]{2,}|[А-ЯЁ]{4,}"),
    ("cp1251", "koi8-r", r"[а-яё][А-ЯЁ]{2,}|[А-ЯЁ]{4,}"),
    ("cp866", "cp1251", r"[Ѐ-ӿ][^\w\s.,;:!?()\"'«»„“”’–—-]|[^\w\s.,;:!?()\"'«»„“”’–—-][Ѐ-ӿ]"),
    ("cp1250", "cp1252", r"[a-z][³¹¿œŸ]|[³¹¿œŸŒ£\x8f\x9f][a-z]"),
    ("iso8859-2", "latin-1", r"[a-z][³±¶¼¿]|[³±¶¼¿¦£¯¬][a-z]"),
    ("cp1252", "cp437", r"[a-z][ΘΦΣτπµφαßδΓ∞]|[ΘΦΣτπφαδΓ∞][a-z]"),
    ("cp437", "cp1252", r"[a-z][‚ˆŠ…‡„”¤¢£¡•][a-z]|[‚ˆŠ‡”¤¡][a-z]{2}"),
)
LOST = re.compile("�")
GARBLED = re.compile(r"[ÃÂÐÑ][\x80-¿‚-™]|�|â€|â‚|├|┬|√[©®†•±]|Γ[ÇÉ]|вЂ|Ð|[\x80-\x9f]")


@lru_cache(maxsize=None)
def _table(codec: str) -> tuple[dict[int, int], dict[int, str]]:
    """Character to byte and back; bytes that a codec leaves undefined stand for the control characters of that number."""
    back = {}
    for b in range(128, 256):
        try:
            back[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            back[b] = chr(b)
    return {ord(c): b for b, c in back.items()}, back


@lru_cache(maxsize=None)
def _groups(codec: str) -> re.Pattern:
    """Character groups that are valid UTF-8 sequences when written in ``codec``."""
    back = _table(codec)[1]
    cls = lambda a, b: "[" + "".join(re.escape(back[x]) for x in range(a, b + 1)) + "]"
    tail = cls(0x80, 0xBF)
    return re.compile(f"(?:{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}})+")


def _undo_group(codec: str):
    to = _table(codec)[0]

    def undo(m: re.Match) -> str:
        try:
            return bytes(to[ord(c)] for c in m[0]).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            return m[0]

    return undo


RUN = re.compile(r"[^\x00-\x7f]{2,}")


def undo_utf8(text: str, codec: str, runs: str) -> str | None:
    """``runs``: the text's runs of two and more characters beyond ASCII; a group never spans more."""
    groups = _groups(codec)
    if not groups.search(runs):
        return None
    undo = _undo_group(codec)
    new = RUN.sub(lambda m: groups.sub(undo, m[0]), text)
    return None if new == text else new


def undo_swap(part: str, true: str, read_as: str) -> str | None:
    """``part`` written in ``read_as`` and read as ``true``; ASCII stays."""
    to, back = _table(read_as)[0], _table(true)[1]
    out = []
    for c in part:
        if ord(c) < 128:
            out.append(c)
        elif (b := to.get(ord(c))) is not None:
            out.append(back[b])
        else:
            return None
    new = "".join(out)
    return None if new == part else new


MARK = "\x1e"
PARTS = re.compile(r"[^\n.!?;]*[\n.!?;]*")
_SWAPS = tuple((a, b, re.compile(p)) for a, b, p in SWAPS)


class Repairer:
    """Description lengths by language dictionaries; made once per process."""

    def __init__(self, dictionaries: dict[str, bytes], step_cost: float = 1.0, swap_cost: float = 3.0):
        import zstandard

        params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False)
        dicts = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, d in sorted(dictionaries.items()) if d]
        self.packers = [zstandard.ZstdCompressor(compression_params=params, dict_data=d) for d in dicts] or [zstandard.ZstdCompressor(compression_params=params)]
        self.step_cost, self.swap_cost = step_cost, swap_cost

    def length(self, text: str) -> int:
        raw = text.encode("utf-8", "surrogatepass")
        return min(len(p.compress(raw)) for p in self.packers)

    def _swapped(self, text: str) -> str:
        likely = [x for x in _SWAPS if x[2].search(text)]
        if not likely:
            return text
        out = []
        for m in PARTS.finditer(text):
            part = m[0]
            if part and not part.isascii():
                best, size = part, None
                for true, read_as, looks in likely:
                    if looks.search(part) and (new := undo_swap(part, true, read_as)) is not None:
                        if size is None:
                            size = self.length(part)
                        other = self.length(new) + self.swap_cost
                        if other < size:
                            best, size = new, other
                part = best
            out.append(part)
        return "".join(out)

    def _chains(self, text: str) -> str:
        """The text at the end of the chain of the least description length; unchanged if that is the empty chain.

        A step of a longer chain may lengthen the description, so every chain is followed to its end. There are few: a step
        leaves fewer characters than before, and chains that lead to the same text are one."""
        least, best, front, known, step = None, text, [text], {text}, 0
        while front:
            step, new = step + 1, []
            for now in front:
                runs = " ".join(set(RUN.findall(now)))
                for codec in READ_AS if runs else ():
                    got = undo_utf8(now, codec, runs)
                    if got is not None and got not in known:
                        known.add(got)
                        new.append(got)
            if new and least is None:
                least = float(self.length(text))
            for got in new:
                size = self.length(got) + self.step_cost * step
                if size < least:
                    least, best = size, got
            front = new
        return best

    def _affected(self, text: str) -> str:
        """Chains over the sentences and lines that could hold groups, so that the rest's length is no noise."""
        if MARK in text:
            return self._chains(text)
        parts = [m[0] for m in PARTS.finditer(text)]
        own = [k for k, p in enumerate(parts) if RUN.search(p)]
        if own:
            # undoing changes nothing in ASCII, so the marks stay
            for k, new in zip(own, self._chains(MARK.join(parts[k] for k in own)).split(MARK)):
                parts[k] = new
        return "".join(parts)

    def repair(self, text: str) -> str:
        grouped = self._affected(text)
        first = self._swapped(grouped)
        swapped = self._swapped(text)
        if swapped == text or swapped == first:
            return first
        # letters of another script may look like groups of UTF-8 and the other way round: the shorter of both orders
        second = self._affected(swapped)
        return min((self.length(first), 0, first), (self.length(second), 1, second))[2]


def train(documents: DataFrame, lang: str = "lang", text: str = "text", order: str = "doc_id", per_language: int = 800, dictionary_bytes: int = 65_536, languages: int = 100) -> dict[str, bytes]:
    """A dictionary per language: a bounded number of clean texts, chosen by hash and strung together in that order."""
    clean = documents.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(order).cast("string")).alias("h")).where("lang is not null and text is not null and length(text) > 80")
    frequent = {r["lang"] for r in clean.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    letters = F.length(F.regexp_replace("text", r"[^\p{L} ]+", "")) / F.length("text")
    clean = clean.where(F.col("lang").isin(*frequent) & (F.octet_length("text") <= dictionary_bytes) & ~F.col("text").rlike(GARBLED.pattern) & (letters >= 0.9))
    first = clean.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= per_language)
    before = F.coalesce(F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = first.withColumn("before", before).where(F.col("before") < 4 * dictionary_bytes).select("lang", "r", "text").collect()  # bounded: five times dictionary_bytes a language
    by: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["r"])):
        by.setdefault(r["lang"], []).append(r["text"])
    out = {}
    for k, texts in by.items():
        kept, size = [], 0
        for t in _common_half(texts):
            if size < dictionary_bytes:
                kept.append(t)
                size += len(t.encode())
        out[k] = "\n".join(kept).encode()
    return out


BEYOND = re.compile(r"\w*[^\W\x00-\x7f]\w*")


def _common_half(texts: list[str]) -> list[str]:
    """Without the half of the texts with words beyond ASCII whose such words stand in the fewest texts; the order stays."""
    words = [set(BEYOND.findall(t.lower())) for t in texts]
    n = Counter(w for ws in words for w in ws)
    score = {k: sum(math.log(n[w]) for w in ws) / len(ws) for k, ws in enumerate(words) if ws}
    out = set(sorted(score, key=lambda k: (score[k], k))[: len(score) // 2])
    return [t for k, t in enumerate(texts) if k not in out]


def find_garbled(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "id", text_col: str = "text", owner: str | None = None) -> DataFrame:
    """(id, restored, lost): texts with wrongly decoded characters, what they read after repair, how many places are lost;
    ``owner`` names a column to hand on as (owner)."""
    shared = df.sparkSession.sparkContext.broadcast(dictionaries)
    schema = pa.schema([("id", pa.string()), ("restored", pa.string()), ("lost", pa.int32()), ("owner", pa.string())])

    def run(batches):
        repairer = Repairer(shared.value)
        for batch in batches:
            out = {k: [] for k in schema.names}
            for i, t, o in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                new = repairer.repair(t)
                lost = len(LOST.findall(new))
                if new != t or lost:
                    for k, v in zip(schema.names, (i, new, lost, o)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    own = F.lit(None).cast("string") if owner is None else F.col(owner).cast("string")
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), own.alias("owner")).where("id is not null and text is not null").where(F.col("text").rlike(r"[^\x00-\x7f]"))
    found = rows.mapInArrow(run, "id string, restored string, lost int, owner string").dropDuplicates(["id"])
    return found.drop("owner") if owner is None else found
