"""Interfaces to models that live outside: text and image embedding, recognition of pages.

A provider is a picklable object that works on a batch. The engine only needs its declared profile; the hashing embedder
is a deterministic stand-in that needs no model."""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator
from typing import Protocol
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmbeddingProvider(Protocol):
    dims: int
    profile_id: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of words; unit length, zero for no words."""

    def __init__(self, dims: int = 64, profile_id: str = "hashing/v1"):
        self.dims, self.profile_id = dims, profile_id

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for k, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[k, h % self.dims] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def check_profile(provider: EmbeddingProvider, dims: int) -> None:
    if provider.dims != dims:
        raise ValueError(f"{provider.profile_id} makes vectors of {provider.dims}, the profile declares {dims}")


def embed_column(df: DataFrame, provider: EmbeddingProvider, text: str = "text", out: str = "embedding", prefix: str = "", batch: int = 16) -> DataFrame:
    """Adds vectors and their profile; texts go to the provider in batches."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            texts = [prefix + (t or "") for t in s]
            rows = [v for k in range(0, len(texts), batch) for v in provider.embed(texts[k : k + batch])]
            yield pd.Series([r.astype("float32").tolist() for r in rows], dtype=object)

    udf = F.pandas_udf(run, "array<float>")
    return df.withColumn(out, udf(F.col(text))).withColumn(f"{out}_profile_id", F.lit(provider.profile_id)).withColumn(f"{out}_dimensions", F.lit(provider.dims))


class TextEmbeddingCache:
    """Query vectors by trimmed lower-case text: 128 entries, forgotten 20 minutes after the last use, least used first."""

    def __init__(self, size: int = 128, seconds: float = 20 * 60, clock=time.monotonic):
        self.size, self.seconds, self.clock, self.rows = size, seconds, clock, OrderedDict()

    def get(self, text: str, make):
        key, now = text.strip().lower(), self.clock()
        for k in [k for k, (t, _) in self.rows.items() if now - t > self.seconds]:
            del self.rows[k]
        value = self.rows.pop(key)[1] if key in self.rows else make(text)
        self.rows[key] = (now, value)
        while len(self.rows) > self.size:
            self.rows.popitem(last=False)
        return value
