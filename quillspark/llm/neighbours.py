"""The k most similar vectors of every vector, by balanced posting lists.

Fit (driver, on a bounded sample): the sample of each space is split again and again by small k-means steps until
every cell stands for at most ``list_size`` vectors; the cells' means are the centroids. Index (executors): every vector
is compared with all centroids and put into the lists of its nearest ones: the nearest, and, since a vector near a
boundary belongs to both sides, all up to ``replicas`` whose distance is at most ``1 + spread`` times the least. Search:
every vector is also a query; it opens the lists with a distance of at most ``1 + reach`` times the least, ``probes`` at
most. Inside a list all similarities are computed at once. Pairs found are finally checked on the vectors themselves.
The nearest centroids are the true ones, by a matrix product: a walk along a graph of centroids misses more of them the
more there are, and with them the pairs, and takes longer at the number of centroids there can be.

Defined results: a vector is usable if its space is not null, its length equals the declared one, all its values are
finite and not all are zero; others have no neighbours. Equal vectors are one class for the search and are expanded
afterwards, so that a class of any size costs each member ``k`` pairs; of equally similar vectors the smaller ids count.
Repeated rows count once. Spaces are never compared. An empty table gives no pairs. Other columns are ignored.

Scale: every vector is indexed; the sample is at most ``sample`` vectors of all spaces together and the broadcast model
about a fifth of that in centroids at most, whatever the input. Once the sample is the limit, lists grow; a list of more than
``INNER`` members is then split again where it is searched, by the same steps on its own members, and a query opens only
its nearest inner lists, so that the work for a vector grows with the root of a list's length. Lists that stand for more than
``HELD`` vectors are dealt out to blocks, with their queries sent to each block, so no task holds a whole hot list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import computed_once

SEED = 5
GROUP = 32  # centroids of which only the best is looked at first
INNER = 4096  # members beyond which a list is split where it is searched
HELD = 1 << 16  # vectors a block of a list stands for


def declared(df: DataFrame, id_col: str, vector: str, space: str, dims: str) -> DataFrame:
    """(id, space, cls, v0): vectors of a space with the declared length."""
    return (
        df.select(F.col(id_col).alias("id"), F.col(space).alias("space"), F.col(vector).alias("v0"), F.col(dims).alias("d"))
        .where("id is not null and space is not null and v0 is not null and size(v0) = d and d > 0")
        .select("id", "space", F.xxhash64("space", "v0").alias("cls"), "v0")
    )


def usable(rows: DataFrame) -> DataFrame:
    """(id, space, cls, v): vectors with a finite norm above 0, scaled to unit length. A null or infinite value or a NaN shows in the norm."""
    norm = F.sqrt(F.aggregate("v0", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return (
        computed_once(rows.select("id", "space", "cls", "v0", norm.alias("norm")))
        .where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
        .select("id", "space", "cls", F.transform("v0", lambda x: (x / F.col("norm")).cast("float")).alias("v"))
    )


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[k : k + 4096] @ c.T, axis=1) for k in range(0, len(x), 4096)])


def _largest(s: np.ndarray, want: int) -> np.ndarray:
    """Columns of the ``want`` largest values of each row, in no order."""
    return np.argpartition(-s, want - 1, axis=1)[:, :want] if want < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)


def _unit(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _split(x: np.ndarray, most: float, rng: np.random.Generator, ways: int = 12) -> list[np.ndarray]:
    """Cells (row numbers) of at most ``most`` rows each."""
    todo, done = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        n = int(min(ways, np.ceil(len(own) / most), len(own)))
        if n < 2:
            done.append(own)
            continue
        part = x[own]
        c = part[rng.choice(len(own), n, replace=False)]
        for _ in range(6):
            near = _nearest(part, c)
            sums = np.zeros_like(c)
            np.add.at(sums, near, part)
            size = np.bincount(near, minlength=n)
            c = _unit(np.where(size[:, None] > 0, sums, c))
        near = _nearest(part, c)
        cells = [own[near == k] for k in range(n) if (near == k).any()]
        if len(cells) == 1:  # nothing to tell them apart
            cells = np.array_split(own, n)
            done.extend(cells)
        else:
            todo.extend(cells)
    return done


class Lists:
    """Centroids of one space; how many blocks each list has."""

    def __init__(self, x: np.ndarray, standing_for: float, list_size: int):
        rng = np.random.default_rng(SEED)
        share = standing_for / len(x)
        cells = _split(x, max(8.0, list_size / share), rng)
        self.centroids = _unit(np.stack([x[c].mean(axis=0) for c in cells])).astype(np.float32)
        self.blocks = np.maximum(1, np.ceil(np.array([len(c) for c in cells]) * share / HELD)).astype(np.int32)

    def near(self, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of the ``want`` nearest centroids of each query, nearest first.

        They lie in the ``want`` groups with the largest best similarities, a group being every ``step``-th centroid."""
        n = len(self.centroids)
        want, step = min(want, n), -(-n // GROUP)
        sim = np.full((len(q), GROUP * step), -3, np.float32)
        np.matmul(q, self.centroids.T, out=sim[:, :n])
        groups = _largest(sim.reshape(len(q), GROUP, step).max(axis=1), want)
        ids = (groups[:, :, None] + step * np.arange(GROUP)).reshape(len(q), -1)
        s = np.take_along_axis(sim, ids, 1)
        top = _largest(s, want)
        ids, s = np.take_along_axis(ids, top, 1), np.take_along_axis(s, top, 1)
        order = np.argsort(-s, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)


def fit(rows: DataFrame, vectors: DataFrame, sample: int, list_size: int) -> dict[str, Lists]:
    """One set of lists per space, from about ``sample`` vectors of all, chosen by hash; each space has a share by the root of its size."""
    sizes = {r["space"]: r["n"] for r in rows.groupBy("space").agg(F.count("*").alias("n")).collect()}  # one row per space
    if not sizes:
        return {}
    million, roots = 1_000_000, sum(n**0.5 for n in sizes.values())
    shares = F.create_map(*[F.lit(x) for space, n in sorted(sizes.items()) for x in (space, int(min(1.0, sample * n**0.5 / roots / n) * million) + 1)])
    got = vectors.where(F.pmod(F.xxhash64("cls", F.lit(SEED)), F.lit(million)) < F.element_at(shares, F.col("space"))).select("space", "v").toArrow()
    names, v = np.array(got.column("space").to_pylist(), object), got.column("v").combine_chunks()
    model = {}
    for space, n in sorted(sizes.items()):
        own = np.flatnonzero(names == space)
        if len(own):
            x = v.take(pa.array(own)).flatten().to_numpy().reshape(len(own), -1).astype(np.float32)
            model[space] = Lists(x, n, list_size)
    return model


def inner_lists(x: np.ndarray, queries: np.ndarray, members: np.ndarray, opened: int = 8):
    """(queries, members) to compare: all, or for a long list each inner list with the queries it is among the nearest of."""
    if not len(members) or not len(queries):
        return
    if len(members) <= INNER:
        yield queries, members
        return
    cells = _split(x[members], len(members) ** 0.5 * 4, np.random.default_rng(SEED))
    centroids = _unit(np.stack([x[members[c]].mean(axis=0) for c in cells]))
    want = min(opened, len(cells))
    top = np.concatenate([np.argpartition(-(x[queries[k : k + 4096]] @ centroids.T), want - 1, axis=1)[:, :want] for k in range(0, len(queries), 4096)])
    for j, c in enumerate(cells):
        near = np.flatnonzero((top == j).any(axis=1))
        if len(near):
            yield queries[near], members[c]


def nearest(df: DataFrame, id_col: str, vector: str, space: str, dims: str, k: int = 5, least: float = 0.8, sample: int = 80_000, list_size: int = 512, replicas: int = 8, probes: int = 8, spread: float = 0.3, reach: float = 0.3) -> DataFrame:
    """(id, other, similarity): for each usable vector the ``k`` most similar others with a similarity of ``least`` or more."""
    spark = df.sparkSession
    rows = declared(df, id_col, vector, space, dims)
    vectors = usable(rows)
    model = spark.sparkContext.broadcast(fit(rows, vectors, sample, list_size))
    schema = pa.schema([("space", pa.string()), ("list", pa.int32()), ("block", pa.int32()), ("cls", pa.int64()), ("role", pa.int8()), ("v", pa.binary())])

    def assign(batches):
        for batch in batches:
            spaces = np.array(batch.column(0).to_pylist(), object)
            cls, v = batch.column(1).to_numpy(), batch.column(2)
            for name in set(spaces):
                lists = model.value.get(name)
                rows = np.flatnonzero(spaces == name)
                if lists is None:
                    continue
                part = v.take(pa.array(rows))
                x, own = part.flatten().to_numpy().reshape(len(rows), -1).astype(np.float32), cls[rows]
                for at in range(0, len(x), 512):
                    q, o = x[at : at + 512], own[at : at + 512]
                    ids, sim = lists.near(q, max(replicas, probes))
                    d = np.sqrt(np.maximum(0, 2 - 2 * sim))
                    d = d / np.maximum(d[:, :1], 1e-6)
                    pos = np.arange(d.shape[1])[None, :]
                    member, query = (d <= 1 + spread) & (pos < replicas), (d <= 1 + reach) & (pos < probes)
                    member[:, 0] = query[:, 0] = True
                    half = [r.tobytes() for r in q.astype(np.float16)]
                    out = {k: [] for k in schema.names}
                    for r, c in zip(*np.nonzero(member | query)):
                        cell = int(ids[r, c])
                        n = int(lists.blocks[cell])
                        home = int(o[r]) % n
                        for b in range(n) if query[r, c] else (home,):
                            out["space"].append(name)
                            out["list"].append(cell)
                            out["block"].append(b)
                            out["cls"].append(int(o[r]))
                            out["role"].append((1 if member[r, c] and b == home else 0) + (2 if query[r, c] else 0))
                            out["v"].append(half[r])
                    yield pa.RecordBatch.from_pydict(out, schema=schema)

    def search(whole: pa.Table) -> pa.Table:
        cls, role = whole.column("cls").to_numpy(), whole.column("role").to_numpy()
        x = np.frombuffer(b"".join(whole.column("v").to_pylist()), np.float16).reshape(len(cls), -1).astype(np.float32)
        members, queries = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        a, b, s = [], [], []
        for q, m in inner_lists(x, queries, members):
            for at in range(0, len(q), 1024):
                own = q[at : at + 1024]
                sim = x[own] @ x[m].T
                sim[cls[own][:, None] == cls[m][None, :]] = -2
                near = np.flatnonzero((sim >= least - 0.005).any(axis=1))
                own, sim = own[near], sim[near]
                top = _largest(sim, k + 2)
                val = np.take_along_axis(sim, top, 1)
                r, c = np.nonzero(val >= least - 0.005)
                a.append(cls[own][r])
                b.append(cls[m][top[r, c]])
                s.append(val[r, c])
        cat = lambda z, t: np.concatenate(z) if z else np.zeros(0, t)
        return pa.table({"cls": cat(a, np.int64), "near": cat(b, np.int64), "s": cat(s, np.float32).astype(np.float64)})

    # one row for each class; as a struct, it is the same exchange for the lists and for both sides of the exact check
    one = vectors.groupBy("cls").agg(F.first(F.struct("space", "v")).alias("o"))
    found = (
        one.select("o.space", "cls", "o.v")
        .mapInArrow(assign, "space string, list int, block int, cls long, role tinyint, v binary")
        .groupBy("space", "list", "block")
        .applyInArrow(search, "cls long, near long, s double")
        .groupBy("cls", "near")
        .agg(F.max("s").alias("s"))
    )
    # rounding of the lists' vectors may swap neighbours that are all but equally similar: two more are kept for the exact check
    w = Window.partitionBy("cls").orderBy(F.desc("s"), "near")
    found = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 2).select("cls", "near")
    return _exact(vectors, one, found, k, least)


def _exact(vectors: DataFrame, one: DataFrame, found: DataFrame, k: int, least: float) -> DataFrame:
    dot = F.aggregate(F.zip_with("va", "vb", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    exact = (
        found.join(one.select("cls", F.col("o.v").alias("va")), "cls")
        .join(one.select(F.col("cls").alias("near"), F.col("o.v").alias("vb")), "near")
        .select("cls", "near", F.round(dot, 6).alias("similarity"))
        .where(F.col("similarity") >= least)
    )
    ids = vectors.select("cls", "id").distinct()
    first = ids.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("r") <= k + 1)
    own = first.join(first.groupBy("cls").agg(F.max("r").alias("m")).where("m > 1"), "cls", "left_semi").select("cls", F.col("id").alias("other"), F.lit(1.0).alias("similarity"))
    others = exact.join(first.where(F.col("r") <= k).select(F.col("cls").alias("near"), F.col("id").alias("other")), "near").select("cls", "other", "similarity").unionByName(own)
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return ids.join(others, "cls").where("id <> other").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("id", "other", "similarity")


def as_pairs(near: DataFrame) -> DataFrame:
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
