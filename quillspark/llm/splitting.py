"""Texts above a word limit are cut at natural boundaries, every piece repeating the last words before it.

For one text, the state of a greedy cut is the number of words that are already placed. A table joins each state to
its farthest legal successor: with the repeated words at most ``limit`` words long, at the last paragraph end; without
one, the last sentence end; without one, the last line end; without one, at the limit. Pointer doubling then squares
that table: after step j the set of reached states holds the first 2**j cuts, so all cuts of a text of n words take
log2(n) vector steps.

Defined results: null, empty and short texts are not cut (``pieces`` gives them back whole, null texts not at all);
a word is what white space parts; blank lines and form feeds end paragraphs; texts of any length are cut whole;
repeated rows count once; an empty table gives no rows; other columns are ignored.

Scale: a map over the rows; only texts that can exceed the limit leave the JVM. New indexes come from two sums over
blocks of chunk indexes, so an asset that holds a third of all rows is numbered by many tasks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = re.compile(r"\S+")
SENTENCE = re.compile(r"""[.!?…。！？]["'”’»)\]}*_]*$""")
#: fixed values: abbreviations after which a full stop ends no sentence, without it and in lower case
ABBREVIATIONS = frozenset(
    """
    mr mrs ms dr prof st jr sr vs etc e.g i.e cf ca approx no nos nr vol fig p pp rs inc ltd co dept est ed eds rev gen col capt lt sgt
    jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun a.m p.m u.s u.k
    z.b d.h u.a bzw usw ggf evtl inkl zzgl abs str tel hr fr frl hrsg
    m mme mlle av bd p.ex env sra srta ud uds pág núm art dña sig ecc n.º dom r.o ul al nr tzn np itd itp godz tys zł
    т.е т.д т.п г гг ул им стр рис руб коп др
    """.split()
)


def ends_sentence(word: str, opens_line: bool) -> bool:
    if not SENTENCE.search(word):
        return False
    core = re.sub(r"""["'”’»)\]}*_]+$""", "", word)
    if core[-1] != "." or core.endswith(".."):
        return True
    bare = core[:-1].lstrip("\"'“‘«([{*_„¿¡").lower()
    if bare in ABBREVIATIONS:
        return False
    if len(bare) == 1 and bare.isalpha():  # an initial
        return False
    if opens_line and bare.isdigit():  # a number of a list
        return False
    return True


class Boundaries:
    """Word spans of a text; for each number of words, the last boundary of each kind at or before it."""

    def __init__(self, text: str):
        spans = [m.span() for m in WORD.finditer(text)]
        self.starts, self.ends = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
        n = self.n = len(spans)
        kinds = np.zeros((3, n + 1), bool)  # paragraph, sentence, line
        opens = True
        for k in range(n - 1):
            a, b = spans[k][1], spans[k + 1][0]
            gap = text[a:b] if b - a > 1 else ("\n" if text[a] in "\n\r\f\x0b\x85  " else " ")
            if gap == "\n" and text[a] == "\f":
                gap = "\f"
            lines = len(gap.splitlines()) - (not re.search(r"[\n\r\x0b\f\x1c-\x1e\x85  ]$", gap)) if gap != " " else 0
            kinds[0, k + 1] = "\f" in gap or lines >= 2
            kinds[2, k + 1] = lines >= 1 or "\f" in gap
            word = text[spans[k][0] : a]
            kinds[1, k + 1] = ends_sentence(word, opens)
            opens = bool(kinds[2, k + 1])
        at = np.arange(n + 1)
        self.last = [np.maximum.accumulate(np.where(row, at, 0)) for row in kinds]


def successors(b: Boundaries, limit: int, overlap: int) -> np.ndarray:
    """The farthest legal successor of every state; the end is its own."""
    done = np.arange(b.n + 1)
    first = done - np.minimum(overlap, done)
    far = np.minimum(first + limit, b.n)
    cut = far.copy()
    open_ = np.ones(b.n + 1, bool)
    for last in b.last:
        at = last[far]
        fits = open_ & (at > done)
        cut[fits] = at[fits]
        open_ &= ~fits
    return np.where(b.n - first > limit, cut, b.n)


def cut_words(text: str, limit: int = 350, overlap: int = 60) -> tuple[list[int], Boundaries | None]:
    """Numbers of words up to the end of each piece but the last."""
    if overlap >= limit:
        raise ValueError("the overlap must be smaller than the limit")
    b = Boundaries(text)
    if b.n <= limit:
        return [], b
    jump = successors(b, limit, overlap)
    reached = np.zeros(1, np.int64)
    while reached.max() < b.n:
        reached = np.unique(np.concatenate([reached, jump[reached]]))
        jump = jump[jump]
    return [int(x) for x in reached if 0 < x < b.n], b


def _long(df: DataFrame, limit: int) -> DataFrame:
    # n words and the spaces between them take 2n - 1 characters at least
    return df.where(F.col("text").isNotNull() & (F.length("text") > 2 * limit))


def cuts(df: DataFrame, id_col: str = "id", text_col: str = "text", limit: int = 350, overlap: int = 60) -> DataFrame:
    """(id, cut_word): one row for each piece but the last."""

    def run(batches):
        for batch in batches:
            ids, words = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, _ = cut_words(t, limit, overlap)
                ids += [i] * len(found)
                words += found
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string()), "cut_word": pa.array(words, pa.int32())})

    return _long(df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")), limit).where("id is not null").mapInArrow(run, "id string, cut_word int").distinct()


def pieces(chunks: DataFrame, limit: int = 350, overlap: int = 60) -> DataFrame:
    """(id, asset_id, chunk_index, page_number, piece, text): all texts within the limit, numbered anew in reading order.

    Texts keep their own white space; a piece's text runs from its first repeated word to its end."""
    schema = pa.schema([("id", pa.string()), ("asset_id", pa.string()), ("old", pa.int32()), ("page_number", pa.int32()), ("piece", pa.int32()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            out = {k: [] for k in schema.names}
            for i, a, o, p, t in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                found, b = cut_words(t, limit, overlap)
                ends = [*found, b.n]
                for k, end in enumerate(ends):
                    start = max(0, ends[k - 1] - overlap) if k else 0
                    out["text"].append(t if len(ends) == 1 else t[b.starts[start] : b.ends[end - 1]])
                    for name, value in zip(schema.names, (i, a, o, p, k)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    rows = chunks.select("id", "asset_id", F.col("chunk_index").cast("int").alias("old"), F.col("page_number").cast("int").alias("page_number"), "text").where("id is not null and text is not null")
    long = _long(rows, limit).select("id", "asset_id", "old", "page_number", "text").mapInArrow(run, "id string, asset_id string, old int, page_number int, piece int, text string")
    short = rows.where(F.length("text") <= 2 * limit).select("id", "asset_id", "old", "page_number", F.lit(0).alias("piece"), "text")
    both = long.unionByName(short).dropDuplicates(["id", "piece"])
    block = F.floor(F.coalesce("old", F.lit(-1)) / 1024)
    keyed = both.withColumn("block", block)
    before = Window.partitionBy("asset_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = keyed.groupBy("asset_id", "block").agg(F.count("*").alias("n")).select("asset_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("asset_id", "block").orderBy("old", "id", "piece")
    a, b = keyed.withColumn("pos", F.row_number().over(inside) - 1).alias("a"), bases.alias("b")
    return a.join(b, F.col("a.asset_id").eqNullSafe(F.col("b.asset_id")) & (F.col("a.block") == F.col("b.block"))).select("id", "a.asset_id", (F.col("base") + F.col("pos")).cast("int").alias("chunk_index"), "page_number", "piece", "text")
