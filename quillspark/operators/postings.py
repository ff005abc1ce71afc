"""Token index and BM25 with prefix terms and phrases."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BM25_B, BM25_K1
from ..functions.text import tokens


def tokenised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, tokens, length) of texts that are not null."""
    return docs.where(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("tokens")).withColumn("length", F.size("tokens"))


def postings(toks: DataFrame, key: str) -> DataFrame:
    """(token, key, tf)."""
    return toks.select(key, F.explode("tokens").alias("token")).groupBy("token", key).agg(F.count("*").alias("tf"))


def document_frequency(toks: DataFrame) -> DataFrame:
    """(token, df, cf): documents and occurrences per token, from one pass and one map-side sum."""
    every = F.transform("tokens", lambda t: F.struct(t.alias("token"), F.lit(0).alias("first")))
    once = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("token"), F.lit(1).alias("first")))
    rows = toks.select(F.explode(F.concat(every, once)).alias("x")).select("x.token", "x.first")
    return rows.groupBy("token").agg(F.sum("first").cast("long").alias("df"), F.sum(1 - F.col("first")).cast("long").alias("cf"))


QUERY_BLOCK = 4096  # queries that are held by a task at once


def bm25(toks: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """(query_id, key, score) of documents with all terms of a query as prefixes of tokens.

    ``queries``: (query_id, terms). Each prefix term and, with two and more terms, the exact phrase of all terms is one
    scoring unit. Statistics of the collection come from all its rows. Queries are taken in blocks; a block is one pass over
    the documents, in which a batch's distinct tokens meet the terms and only hits leave the task."""
    held = queries.select("query_id", "terms").where(F.size("terms") > 0).toArrow()  # a batch of queries, in blocks of bounded size
    blocks = [held.slice(k, QUERY_BLOCK) for k in range(0, held.num_rows, QUERY_BLOCK)] or [held]
    out = None
    for block in blocks:
        part = _bm25_block(toks, key, block)
        out = part if out is None else out.unionByName(part)
    return out


def _bm25_block(toks: DataFrame, key: str, block: pa.Table) -> DataFrame:
    kind = toks.schema[key].dataType.simpleString()
    shared = toks.sparkSession.sparkContext.broadcast((block.column("query_id").to_pylist(), block.column("terms").to_pylist()))
    query_type = block.schema.field("query_id").type

    def run(batches):
        match = Matcher(*shared.value)
        for batch in batches:
            rows, n, total = match.hits(batch.column(1), batch.column(2).to_numpy())
            rows.append((None, -2, None, n, total, False))  # documents and their tokens
            at = pa.array([r[2] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], query_type), pa.array([r[1] for r in rows], pa.int32()), batch.column(0).take(at), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows])],
                ["query_id", "unit", "key", "f", "length", "whole"],
            )

    query_kind = "long" if pa.types.is_int64(query_type) else "int" if pa.types.is_integer(query_type) else "string"
    found = toks.select(F.col(key).alias("key"), "tokens", F.col("length").cast("long")).mapInArrow(run, f"query_id {query_kind}, unit int, key {kind}, f long, length long, whole boolean")
    found = found.persist(StorageLevel.DISK_ONLY)  # hits only; read for the units' document counts and for the scores
    # n of a prefix counts all documents with it, also those that miss other terms
    n_units = found.where("unit > -2").groupBy("query_id", "unit").agg(F.count("*").alias("n"))
    size = found.where("unit = -2").agg(F.sum("f").cast("double").alias("n_docs"), (F.sum("length") / F.sum("f")).alias("avgdl"))
    idf = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    score = F.when(idf > 0, idf).otherwise(1e-6) * F.col("f") * (BM25_K1 + 1) / (F.col("f") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("avgdl")))
    return (
        found.where("whole")
        .join(n_units, ["query_id", "unit"])
        .crossJoin(F.broadcast(size))  # one row
        .groupBy("query_id", F.col("key").alias(key))
        .agg(F.greatest(F.sum(score), F.lit(0.0)).alias("score"))
    )


class Matcher:
    """A block of queries against token lists."""

    def __init__(self, ids: list, terms: list[list[str]]):
        self.ids, self.terms = ids, terms
        self.units: dict[str, list[tuple[int, int]]] = {}
        for q, own in enumerate(terms):
            for u, t in enumerate(own):
                self.units.setdefault(t, []).append((q, u))
        self.lengths = sorted({len(t) for t in self.units})
        self.known: dict[str, list[tuple[int, int]]] = {}

    def of_token(self, token: str) -> list[tuple[int, int]]:
        """(query, unit) of the terms that begin the token."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[token] = [x for n in self.lengths if n <= len(token) for x in self.units.get(token[:n], ())]
        return got

    def hits(self, tokens: pa.Array, lengths: np.ndarray) -> tuple[list[tuple], int, int]:
        """(query, unit, row, f, length, whether all terms of the query are there); unit -1 is the phrase."""
        coded = pc.list_flatten(tokens).dictionary_encode()
        owner, code = pc.list_parent_indices(tokens).to_numpy(), coded.indices.to_numpy()
        words = coded.dictionary.to_pylist()
        hit = np.array([bool(self.of_token(w)) for w in words], bool)
        at = np.flatnonzero(hit[code]) if len(code) else np.zeros(0, np.int64)
        counts: dict[tuple[int, int, int], int] = {}
        for row, c in zip(owner[at].tolist(), code[at].tolist()):
            for q, u in self.of_token(words[c]):
                counts[row, q, u] = counts.get((row, q, u), 0) + 1
        units = Counter((row, q) for row, q, _ in counts)
        out = []
        for (row, q, u), f in counts.items():
            out.append((self.ids[q], u, row, f, int(lengths[row]), units[row, q] == len(self.terms[q])))
        for (row, q), n in units.items():
            own = self.terms[q]
            if n == len(own) > 1:
                words_of = tokens[row].as_py()
                f = sum(words_of[k : k + n] == own for k in range(len(words_of) - n + 1))
                if f:
                    out.append((self.ids[q], -1, row, f, int(lengths[row]), True))
        return out, len(tokens), int(lengths.sum())


def bm25_value(idf_n: int, n: int, f: int, length: int, avgdl: float) -> float:
    """The formula for one unit, for tests."""
    idf = math.log((n - idf_n + 0.5) / (idf_n + 0.5))
    return (idf if idf > 0 else 1e-6) * f * (BM25_K1 + 1) / (f + BM25_K1 * (1 - BM25_B + BM25_B * length / avgdl))
