"""Near-duplicate texts by a token-group matrix.

Tokens are the distinct runs of ``shingle`` words of a text; two texts are near-duplicates if the Jaccard similarity
of their token sets is at least ``threshold``. Exact copies are one class, named by a 64-bit hash of the text;
everything below works on classes.

  1. Sets: every text is read once; the token sets of its classes are written to the shared folder.
  2. Order: tokens are ordered by their counts over all classes (a table of 2**20 cells), then by hash. Any order that is
     the same for all texts gives the same pairs; rare tokens first give few candidates.
  3. Groups: classes that share their least token (by another hash) are one group of similar texts; a group is held as
     blocks of at most ``BLOCK`` members: the union of their tokens, and for each token of it which members have it.
  4. Columns: two sets of the required overlap share a token of both their prefixes, which are the first
     n - ceil(threshold * n) + 1 of n tokens. Every class stands, with its group, in the column of each token of its
     prefix. A column names the groups that a query (a class) may have a partner in: where 1 + the smaller number of
     tokens behind the common one, and half of what both sizes exceed the distance of two parity bitmaps by, reach the
     overlap that the threshold requires.
  5. Bound: the query's tokens that the union of a block holds are an upper bound of its overlap with any member; only
     blocks that reach the required overlap are opened, and there the overlap with each member is counted exactly.

No step loses a pair: at the first common token all bounds hold for every pair at or above the threshold.

Scale: texts are tokenised once. A column bucket has about ``COLUMN_ROWS`` entries whatever the input; the column of a
token that is more frequent than that is split into parts, and every two parts meet in a task of their own. A group is
split where its least token is frequent, and a group with many queries is sent to several tasks. Work grows with the
pairs of a column, so with the square of the frequency of tokens that stand in prefixes although they are frequent.

Defined results: null texts and texts of fewer than ``min_words`` words have no partners; rows without id are left out;
repeated rows count once; copies of one text are pairs of similarity 1; an empty table gives no pairs; other columns are
ignored. Members of a class that carry the same known ``digest`` are one unit, and pairs inside a unit or between units
of one digest do not count. Of a class of up to ``expand`` members every member is given in pairs. Of a larger one every
member of unknown digest and the smallest id of each known digest are given in the pairs with other classes, and its
copies as pairs of each of these with the smallest id of another unit; ``membership`` leads from these to the rest, so
no link between different texts is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions_of

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Tokens:
    """Token sets of many texts at once: ``hashes`` of all texts one after another, text i from starts[i]."""

    def __init__(self, shingle: int, min_words: int):
        self.shingle, self.min_words, self.known = shingle, max(min_words, shingle), {}

    def _hash(self, words: list[str]) -> np.ndarray:
        import xxhash

        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indexes of the texts that are long enough, their starts (one more than texts), and their sorted token hashes."""
        bare = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string())), r"[^\pL\pN]+", " ")
        words = pc.utf8_split_whitespace(pc.utf8_trim(bare, " "))
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(sizes >= self.min_words)
        if not len(kept):
            return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        coded = pc.list_flatten(words.take(pa.array(kept))).dictionary_encode()
        flat = self._hash(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        owner = np.repeat(np.arange(len(kept), dtype=np.uint64), sizes[kept])
        n, c = self.shingle, _constants(self.shingle, 7)
        mixed = np.zeros(len(flat) - n + 1, np.uint64)
        for j in range(n):
            mixed += _mix(flat[j : len(flat) - n + 1 + j] * c[j])
        own = owner[: len(mixed)]
        whole = own == owner[n - 1 :]
        pairs = np.unique((own[whole] << np.uint64(32)) | (_mix(mixed[whole]) >> np.uint64(32)))
        starts = np.searchsorted(pairs, np.arange(len(kept) + 1, dtype=np.uint64) << np.uint64(32))
        return kept, starts, (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)


SLICE = 4000  # texts that are worked on at once
CELLS, RANGES = 20, 16  # 2**CELLS counters in RANGES rows
FAR = 65535  # so many tokens behind, or more
COLUMN_ROWS = 1 << 20  # entries of a column bucket
HELD = 1 << 12  # members of a group in one task, about
BLOCK = 64  # members of a block
QUERIES = 1 << 15  # queries of a group in one task, about


def token_sets(texts: DataFrame, shingle: int, min_words: int) -> DataFrame:
    """(cls, tokens): packed sorted token hashes; a class may come once from each partition."""
    schema = pa.schema([("cls", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        tokens, seen = Tokens(shingle, min_words), set()  # copies are dropped within the partition
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                fresh = [k for k, c in enumerate(part.column(0).to_pylist()) if not (c in seen or seen.add(c))]
                cls = part.column(0).to_numpy()[fresh]
                kept, starts, hashes = tokens.of(part.column(1).take(pa.array(fresh, pa.int64())))
                raw = hashes.tobytes()
                yield pa.RecordBatch.from_pydict({"cls": cls[kept], "tokens": [raw[4 * a : 4 * b] for a, b in zip(starts[:-1], starts[1:])]}, schema=schema)

    return texts.select("cls", "text").mapInArrow(run, "cls long, tokens binary")


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts (one more than sets) and all tokens of packed sets."""
    packed = column.to_pylist()
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int64)
    return starts, np.frombuffer(b"".join(packed), np.uint32)


def cell(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint32(32 - CELLS)


def token_counts(sets: DataFrame) -> np.ndarray:
    """Counts of tokens by the first bits of their hashes, over all classes; a table of fixed size."""
    width = (1 << CELLS) // RANGES

    def run(batches):
        counts = np.zeros(1 << CELLS, np.int64)
        for batch in batches:
            counts += np.bincount(cell(_sets(batch.column(0))[1]), minlength=1 << CELLS)
        if counts.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(RANGES), pa.int32()), "counts": [counts[k * width : (k + 1) * width].tobytes() for k in range(RANGES)]})

    def add(whole: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for x in whole.column("counts").to_pylist():
            total += np.frombuffer(x, np.int64)
        return pa.table({"part": whole.column("part")[:1], "counts": [total.tobytes()]})

    out = np.zeros((RANGES, width), np.int64)
    for r in sets.select("tokens").mapInArrow(run, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():  # RANGES rows
        out[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def groups_of_sets(cls: np.ndarray, starts: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The group of each class: its least token by another hash, and a part where that token is frequent."""
    keys = (_mix(hashes.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) & np.uint64(0xFFFFFFFF00000000)) | hashes
    least = np.minimum.reduceat(keys, starts[:-1]) if len(cls) else keys[:0]
    parts = 1 + counts[cell((least & np.uint64(0xFFFFFFFF)).astype(np.uint32))] // HELD
    return (_mix(least + (cls % parts).astype(np.uint64)) >> np.uint64(33)).astype(np.int32)


def prefixes(starts: np.ndarray, hashes: np.ndarray, counts: np.ndarray, threshold: float):
    """Of the texts' prefixes the tokens, their texts (indexes) and how many tokens of the text come behind each."""
    sizes = np.diff(starts)
    own = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((hashes, counts[cell(hashes)], own))
    behind = np.repeat(starts[1:], sizes) - np.arange(len(hashes)) - 1
    inside = behind >= np.repeat(np.ceil(threshold * sizes - 1e-9).astype(np.int64), sizes) - 1
    return hashes[order][inside], own[inside], behind[inside]


def bitmap_words(sizes: np.ndarray) -> np.ndarray:
    """Words of 64 bits of a parity bitmap: a power of two, 8 and more, with at least two bits for each token."""
    return np.int64(1) << np.maximum(3, np.ceil(np.log2(np.maximum(sizes, 1) / 32)).astype(np.int64))


def parities(starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's bitmap starts (one more than texts), and the bitmaps.

    A bit is set if an odd number of the text's tokens has it, so two bitmaps differ in no more bits than the sets in
    tokens. The halves of a bitmap, put together by xor, are the bitmap of half the length."""
    words = bitmap_words(np.diff(starts))
    at = np.concatenate([[0], np.cumsum(words)])
    sizes = np.diff(starts)
    bit = ((hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & np.repeat(words * 64 - 1, sizes)
    odd = np.bincount(np.repeat(at[:-1] * 64, sizes) + bit, minlength=int(at[-1]) * 64) & 1
    return at, np.packbits(odd.astype(np.uint8)).view(np.uint64)


def apart(x: np.ndarray, y: np.ndarray, words: np.ndarray, levels: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """In how many bits the bitmaps of texts x and y differ, in the length of the shorter one."""
    out, least = np.zeros(len(x), np.int64), np.minimum(words[x], words[y])
    for w, (row, bits) in levels.items():
        k = np.flatnonzero(least == w)
        out[k] = np.bitwise_count(bits[row[x[k]]] ^ bits[row[y[k]]]).sum(axis=1, dtype=np.int64)
    return out


def bitmap_levels(words: np.ndarray, bits: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length its bitmaps, longer ones folded to it, and the row of each text in them."""
    at = np.cumsum(words) - words
    out = {}
    for w in np.unique(words):
        row, parts, n = np.full(len(words), -1, np.int64), [], 0
        for longer in np.unique(words[words >= w]):
            k = np.flatnonzero(words == longer)
            parts.append(np.bitwise_xor.reduce(bits[at[k][:, None] + np.arange(longer)].reshape(len(k), -1, w), axis=1))
            row[k] = n + np.arange(len(k))
            n += len(k)
        out[int(w)] = row, np.concatenate(parts)
    return out


def column_buckets(counts: np.ndarray, threshold: float) -> int:
    """How many buckets the columns are dealt to; twelve and more, each of about COLUMN_ROWS entries."""
    return max(12, int(np.ceil(counts.sum() * (1 - threshold) / COLUMN_ROWS)))


def spread(tok: np.ndarray, cls: np.ndarray, parts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, bucket): an entry of a column of one part goes to the token's bucket; one of several parts to the bucket of
    its part with each other one."""
    bucket = (_mix(tok.astype(np.uint64)) >> np.uint64(40)) % np.uint64(buckets)
    hot = np.flatnonzero(parts > 1)
    entries, where = [np.flatnonzero(parts <= 1)], [bucket[parts <= 1].astype(np.int64)]
    if len(hot):
        many = np.repeat(hot, parts[hot])
        other = np.arange(len(many)) - np.repeat(np.cumsum(parts[hot]) - parts[hot], parts[hot])
        own = cls[many] % parts[many]
        low, high = np.minimum(own, other), np.maximum(own, other)
        keep = own != other
        key = _mix(_mix(tok[many].astype(np.uint64) + np.uint64(1)) + low.astype(np.uint64) * np.uint64(1 << 20) + high.astype(np.uint64))
        entries.append(many[keep])
        where.append(buckets + (key[keep] >> np.uint64(34)).astype(np.int64))
    return np.concatenate(entries), np.concatenate(where)


COLUMNS = ("tokens", "which", "behind", "classes", "groups", "sizes", "bits")


def columns(sets: DataFrame, threshold: float, counts: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, tokens, which, behind, classes, groups, sizes, bits): packed arrays; ``which`` points into the row's classes."""
    schema = pa.schema([("bucket", pa.int64()), *[(n, pa.binary()) for n in COLUMNS]])
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for cls, starts, hashes in _batches(batches):
            tok, own, behind = prefixes(starts, hashes, shared.value, threshold)
            gid = groups_of_sets(cls, starts, hashes, shared.value)
            sizes, (begin, bits) = np.diff(starts).astype(np.uint32), parities(starts, hashes)
            entry, bucket = spread(tok, cls[own], 1 + shared.value[cell(tok)] // COLUMN_ROWS, buckets)
            order = np.lexsort((tok[entry], bucket))
            entry, bucket = entry[order], bucket[order]
            tok, own, behind = tok[entry], own[entry], np.minimum(behind[entry], FAR)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(tok)]])
            cols: dict[str, list] = {n: [] for n in ("bucket", *COLUMNS)}
            for a, b in zip(edges[:-1], edges[1:]):
                there, which = np.unique(own[a:b], return_inverse=True)
                row = (tok[a:b], which.astype(np.uint16), behind[a:b].astype(np.uint16), cls[there], gid[there], sizes[there], np.concatenate([bits[begin[k] : begin[k + 1]] for k in there]))
                cols["bucket"].append(int(bucket[a]))
                for n, x in zip(COLUMNS, row):
                    cols[n].append(x.tobytes())
            yield pa.RecordBatch.from_pydict(cols, schema=schema)

    return sets.mapInArrow(run, "bucket long, " + ", ".join(f"{n} binary" for n in COLUMNS))


def _batches(batches, most: int = 8000):
    """(cls, starts, hashes) of up to ``most`` sets at once, so that a class's bitmap is sent to a bucket once for many tokens."""
    held: list[pa.RecordBatch] = []

    def together():
        whole = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        return whole.column("cls").to_numpy(), *_sets(whole.column("tokens"))

    for batch in batches:
        for at in range(0, batch.num_rows, most):
            held.append(batch.slice(at, most))
            if sum(b.num_rows for b in held) > most // 2:
                yield together()
    if held:
        yield together()


def candidates(cols: DataFrame, threshold: float, block: int) -> DataFrame:
    """(q, gid): which groups a class must be bounded against. Those found are made distinct every ``block`` * 2**14."""
    share = threshold / (1 + threshold)

    def run(whole: pa.Table) -> pa.Table:
        read = lambda n, kind: [np.frombuffer(x, kind) for x in whole.column(n).to_pylist()]
        classes, tok = read("classes", np.int64), np.concatenate(read("tokens", np.uint32))
        base = np.cumsum([0, *[len(x) for x in classes[:-1]]])
        own = np.concatenate([w.astype(np.int64) + b for w, b in zip(read("which", np.uint16), base)])
        behind = np.concatenate(read("behind", np.uint16)).astype(np.int64)
        behind[behind == FAR] = 1 << 40
        cls, gid, sizes = np.concatenate(classes), np.concatenate(read("groups", np.int32)), np.concatenate(read("sizes", np.uint32)).astype(np.int64)
        words = bitmap_words(sizes)
        levels = bitmap_levels(words, np.concatenate(read("bits", np.uint64)))
        order = np.argsort(tok, kind="stable")
        tok, own, behind = tok[order], own[order], behind[order]
        size = sizes[own]
        at, d, held, kept = np.arange(len(tok)), 0, [], 0
        kind = np.dtype([("q", np.int64), ("gid", np.int32)])
        while True:
            d += 1
            at = at[: np.searchsorted(at, len(tok) - d)]
            at = at[tok[at] == tok[at + d]]
            if not len(at):
                break
            x, y = at, at + d
            need = share * (size[x] + size[y]) - 1e-9
            fits = (1 + np.minimum(behind[x], behind[y]) >= need) & (np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9)
            x, y, need = own[x[fits]], own[y[fits]], need[fits]
            fits = ((sizes[x] + sizes[y] - apart(x, y, words, levels)) / 2 >= need) & (cls[x] != cls[y])
            x, y = x[fits], y[fits]
            later = cls[x] > cls[y]  # of two classes the greater one is the query
            found = np.empty(len(x), kind)
            found["q"], found["gid"] = np.where(later, cls[x], cls[y]), np.where(later, gid[y], gid[x])
            held.append(found)
            kept += len(found)
            if kept > block << 14:
                held = [np.unique(np.concatenate(held))]
                kept = 0
        found = np.unique(np.concatenate([np.zeros(0, kind), *held]))
        return pa.table({"q": found["q"].copy(), "gid": found["gid"].copy()})

    return cols.groupBy("bucket").applyInArrow(run, "q long, gid int").distinct()


def grouped(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """(gid, cls, tokens)."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    schema = pa.schema([("gid", pa.int32()), ("cls", pa.int64()), ("tokens", pa.binary())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cls = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(groups_of_sets(cls, *_sets(batch.column(1)), shared.value)), batch.column(0), batch.column(1).cast(pa.binary())], schema=schema)

    return sets.mapInArrow(run, "gid int, cls long, tokens binary")


class Block:
    """Rows of the matrix: the union of up to BLOCK members' tokens, and which member has which."""

    def __init__(self, cls: np.ndarray, sets: list[np.ndarray]):
        self.cls, self.sizes = cls, np.array([len(x) for x in sets])
        self.union, where = np.unique(np.concatenate(sets), return_inverse=True)
        self.has = np.zeros((len(self.union), len(cls)), np.uint8)
        self.has[where, np.repeat(np.arange(len(cls)), self.sizes)] = 1

    def partners(self, q: np.ndarray, starts: np.ndarray, tokens: np.ndarray, threshold: float):
        """(query, member, overlap) of the pairs at the threshold; queries whose bound is too low are not compared."""
        size = np.diff(starts)
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        hit = self.union[at] == tokens
        owner = np.repeat(np.arange(len(q)), size)
        bound = np.bincount(owner[hit], minlength=len(q))
        need = threshold / (1 + threshold) * (size + np.maximum(self.sizes.min(), threshold * size)) - 1e-9
        opened = (bound >= need) & (self.cls.min() < q)
        take = hit & opened[owner]
        if not take.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = owner[take]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        both = np.add.reduceat(self.has[at[take]], first, axis=0, dtype=np.int64)
        rows = own[first]
        enough = (both >= threshold * (size[rows][:, None] + self.sizes[None, :] - both) - 1e-9) & (self.cls[None, :] < q[rows][:, None])
        r, c = np.nonzero(enough)
        return rows[r], c, both[r, c]


def open_groups(queries: DataFrame, members: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """(cls_a, cls_b, similarity) of all pairs of a query and an earlier member of its group at or above the threshold."""

    def run(whole: pa.Table) -> pa.Table:
        gid, slot, cls, role = (whole.column(n).to_numpy() for n in ("gid", "slot", "cls", "role"))
        packed = whole.column("tokens").to_pylist()
        order = np.lexsort((cls, role, slot, gid))
        new = np.ones(len(order), bool)  # copies in several partitions give a class's set several times
        for x in (gid, slot, role, cls):
            new[1:] &= x[order[1:]] == x[order[:-1]]
        new[1:] = ~new[1:]
        new[0] = True
        order = order[new]
        edges = np.concatenate([[0], np.flatnonzero((gid[order[1:]] != gid[order[:-1]]) | (slot[order[1:]] != slot[order[:-1]])) + 1, [len(order)]])
        a, b, sim = [], [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            rows = order[lo:hi]
            own, asked = rows[role[rows] == 0], rows[role[rows] == 1]
            if not len(own) or not len(asked):
                continue
            sets = {k: np.frombuffer(packed[k], np.uint32) for k in own}
            own = own[np.lexsort((cls[own], [len(sets[k]) for k in own], [int(sets[k][0]) for k in own]))]  # alike side by side
            starts = np.concatenate([[0], np.cumsum([len(packed[k]) // 4 for k in asked])])
            tokens, q = np.frombuffer(b"".join(packed[k] for k in asked), np.uint32), cls[asked]
            for at in range(0, len(own), BLOCK):
                part = own[at : at + BLOCK]
                block = Block(cls[part], [sets[k] for k in part])
                r, c, both = block.partners(q, starts, tokens, threshold)
                a.append(block.cls[c])
                b.append(q[r])
                sim.append(both / (np.diff(starts)[r] + block.sizes[c] - both))
        cat = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        return pa.table({"cls_a": cat(a, np.int64), "cls_b": cat(b, np.int64), "similarity": cat(sim, np.float64)})

    rows = members.select("gid", "slot", "cls", "tokens", F.lit(0).alias("role")).unionByName(queries.select("gid", "slot", "cls", "tokens", F.lit(1).alias("role")))
    return rows.groupBy(F.pmod(F.xxhash64("gid", "slot"), F.lit(buckets)).alias("bucket")).applyInArrow(run, "cls_a long, cls_b long, similarity double")


def similar_classes(texts: DataFrame, threshold: float = 0.8, shingle: int = 5, min_words: int = 5, block: int = 256, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cls_a, cls_b, similarity), cls_a < cls_b, from ``texts`` (cls, text), and (cls) of all texts that are long enough,
    maybe repeated; see the module's text."""
    sets = cut(token_sets(texts, shingle, min_words), "token-sets")
    counts = token_counts(sets)
    asked = cut(candidates(columns(sets, threshold, counts, buckets or column_buckets(counts, threshold)), threshold, block), "asked")
    slots = asked.groupBy("gid").agg((1 + F.floor(F.count("*") / QUERIES)).cast("int").alias("slots"))
    queries = asked.join(slots, "gid").select(F.col("q").alias("cls"), "gid", F.pmod(F.xxhash64("q"), F.col("slots")).cast("int").alias("slot")).join(sets, "cls")
    members = grouped(sets, counts).join(slots, "gid").select("gid", "cls", "tokens", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    pairs = open_groups(queries, members, threshold, buckets or max(48, 8 * partitions_of(texts))).dropDuplicates(["cls_a", "cls_b"])
    return cut(pairs, "class-pairs"), sets.select("cls")


def _rows(df: DataFrame, id_col: str, text_col: str, owner: str | None) -> DataFrame:
    """(cls, id, owner) of all rows with an id and a text."""
    own = F.lit(None).cast("string") if owner is None else F.col(owner)
    return df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("cls"), F.col(id_col).alias("id"), own.alias("owner"))


def _with_digests(rows: DataFrame, digests: DataFrame | None, owner: str) -> DataFrame:
    if digests is None:
        return rows.select("cls", "id", F.lit(None).cast("string").alias("digest")).distinct()
    known = digests.select(F.col(owner).alias("owner"), "digest").where("owner is not null and digest is not null").groupBy("owner").agg(F.max("digest").alias("digest"))
    return rows.join(known, "owner", "left").groupBy("cls", "id").agg(F.max("digest").alias("digest"))


def membership(df: DataFrame, id_col: str = "id", text_col: str = "text", digests: DataFrame | None = None, owner: str = "asset_id") -> DataFrame:
    """(cls, id, digest): which rows share one text; ``digests``: (owner, digest), known ones."""
    return _with_digests(_rows(df, id_col, text_col, owner if digests is not None else None), digests, owner)


def _pairs_and_members(df: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int, min_words: int, digests: DataFrame | None, owner: str, how: dict) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes, and (cls, id, digest) of the classes that are in a pair or have copies long enough to count."""
    rows = _rows(df, id_col, text_col, owner if digests is not None else None)
    texts = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("cls"), F.col(text_col).alias("text"))
    pairs, able = similar_classes(texts, threshold, shingle, min_words, **how)
    repeated = rows.groupBy("cls").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("cls").join(able, "cls", "left_semi")
    wanted = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).unionByName(repeated).distinct()
    return pairs, cut(_with_digests(rows.join(wanted, "cls", "left_semi"), digests, owner), "members")


def near_duplicate_pairs(
    df: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5, min_words: int = 5, digests: DataFrame | None = None, owner: str = "asset_id", expand: int = 256, **how
) -> DataFrame:
    """(id_a, id_b, similarity), the smaller id first; see the module's text for ``digests`` and ``expand``."""
    pairs, members = _pairs_and_members(df, id_col, text_col, threshold, shingle, min_words, digests, owner, how)
    unit = F.coalesce(F.col("digest"), F.concat(F.lit("\x00"), F.col("id")))
    sizes = members.groupBy("cls").agg(F.count("*").alias("n"))
    # the members that stand in pairs: all of a class of up to ``expand``, else one of each unit
    units = members.withColumn("unit", unit).join(sizes, "cls")
    large = units.where(F.col("n") > expand).groupBy("cls", "unit").agg(F.min("id").alias("id"), F.first("digest").alias("digest"))
    shown = units.where(F.col("n") <= expand).select("cls", "id", "digest", "unit").unionByName(large.select("cls", "id", "digest", "unit"))
    a, b = (shown.select(F.col("cls").alias(f"cls_{x}"), F.col("id").alias(f"id_{x}"), F.col("digest").alias(f"digest_{x}")) for x in "ab")
    counts = F.expr("digest_a is null or digest_b is null or digest_a <> digest_b")
    between = pairs.join(a, "cls_a").join(b, "cls_b").where(counts).select("id_a", "id_b", "similarity")
    small = units.where((F.col("n") > 1) & (F.col("n") <= expand))
    x, y = (small.select("cls", F.col("id").alias(f"id_{k}"), F.col("digest").alias(f"digest_{k}")) for k in "ab")
    inside = x.join(y, "cls").where("id_a < id_b").where(counts).select("id_a", "id_b", F.lit(1.0).alias("similarity"))
    # copies in a large class: the smallest id of all with that of each other unit
    first = large.groupBy("cls").agg(F.min("id").alias("first"))
    star = large.join(first, "cls").where("id <> first").select(F.col("first").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("similarity"))
    return between.unionByName(inside).unionByName(star).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity").distinct()


def known_digests(assets: DataFrame) -> DataFrame:
    """(asset_id, digest): known sha256 values, in lower case."""
    return assets.where("sha256 is not null and id is not null").select(F.col("id").alias("asset_id"), F.lower("sha256").alias("digest"))


def near_duplicate_groups(
    df: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = 0.8, shingle: int = 5, min_words: int = 5, digests: DataFrame | None = None, owner: str = "asset_id", **how
) -> DataFrame:
    """(id, group_id, links): connected groups of the pairs that count, named by their smallest id, and how many pairs each row
    is in. Works on classes, whatever their size; rows without a pair have no row."""
    pairs, members = _pairs_and_members(df, id_col, text_col, threshold, shingle, min_words, digests, owner, how)
    sizes = members.groupBy("cls").agg(F.count("*").alias("n"))
    by_digest = members.where("digest is not null").groupBy("cls", "digest").agg(F.count("*").alias("same"))
    both = pairs.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("other")).unionByName(pairs.select(F.col("cls_b").alias("cls"), F.col("cls_a").alias("other")))
    around = both.join(sizes.select(F.col("cls").alias("other"), F.col("n").alias("near")), "other")
    total = around.groupBy("cls").agg(F.sum("near").alias("near"))
    # of the rows around those with the row's own digest do not count
    shared = both.join(by_digest.select("cls", "digest"), "cls").join(by_digest.select(F.col("cls").alias("other"), "digest", "same"), ["other", "digest"]).groupBy("cls", "digest").agg(F.sum("same").alias("lost"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    linked = (
        members.join(sizes, "cls").join(by_digest, ["cls", "digest"], "left").join(total, "cls", "left").join(shared, ["cls", "digest"], "left")
        .select("cls", "id", "digest", (F.col("n") - F.coalesce(F.col("same"), F.lit(1)) + zero("near") - zero("lost")).alias("links"))
        .where("links > 0")
    )
    # two classes hold together unless all their members carry one digest; a linked row of a class is linked to every other unit of it
    one = members.groupBy("cls").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("digest").alias("k"), F.count("*").alias("n")).select("cls", F.when((F.col("low") == F.col("high")) & (F.col("k") == F.col("n")), F.col("low")).alias("only"))
    held = (
        pairs.join(one.select(F.col("cls").alias("cls_a"), F.col("only").alias("only_a")), "cls_a").join(one.select(F.col("cls").alias("cls_b"), F.col("only").alias("only_b")), "cls_b")
        .where("only_a is null or only_b is null or only_a <> only_b")
        .select(F.col("cls_a").alias("id_a"), F.col("cls_b").alias("id_b"))
    )
    labels = groups_of(held).select(F.col("id").alias("cls"), "group_id")
    named = linked.join(labels, "cls", "left").select("id", "links", F.coalesce("group_id", "cls").alias("label"))
    return named.join(named.groupBy("label").agg(F.min("id").alias("group_id")), "label").select("id", "group_id", "links")


def groups_of(pairs: DataFrame) -> DataFrame:
    """(id, group_id, links): connected groups of pairs, named by their smallest id; ids without a pair have no row.

    Labels spread along the pairs and jump along labels, so rounds grow with the logarithm of a chain's length. Each round
    is written to the shared folder; rounds end when no label changes. A node with many pairs is a map-side minimum."""
    edges = cut(pairs.select(F.col("id_a").alias("x"), F.col("id_b").alias("y")).unionByName(pairs.select(F.col("id_b").alias("x"), F.col("id_a").alias("y"))).where("x <> y").distinct(), "pairs")
    labels = cut(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label"), F.count("*").alias("links")), "labels")
    while True:
        near = edges.join(labels.select(F.col("x").alias("y"), F.col("label").alias("other")), "y").groupBy("x").agg(F.min("other").alias("near"))
        spread = labels.join(near, "x").select("x", "links", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("x").alias("mid"), F.col("label").alias("far"))
        new = cut(spread.join(jump, "mid").select("x", "links", "old", F.least("mid", "far").alias("label")), "labels")
        if new.where("label <> old").isEmpty():
            return new.select(F.col("x").alias("id"), F.col("label").alias("group_id"), "links")
        labels = new.select("x", "label", "links")
