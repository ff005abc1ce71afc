"""A mixture of sources in which each source has its target share of all tokens.

Entropy balancing: each document gets a rate, exp(tilt of its source * its tokens), bounded by what its source may
repeat; the tilts solve the convex dual of "each source's rates times tokens sum to its target". Newton steps need one
small sum per source; they run on counts of documents per (source, tokens), which are aggregated once. Where a bound
is reached, a step that leaves the bracket of the root is replaced by halving it.

The total is the largest that all sources can reach within their repeats, or as given. Rates become whole copies by
systematic rounding along the documents of each block of a source in the order of their lengths, so a block's copies
differ from its rates by less than one and no document exceeds its source's bound.

Defined results: documents of null or empty text have no tokens and are never chosen; documents of a source that has
no target, and of null source, are left out; a source without documents or with a target of 0 gets nothing, its share
is reported as missing and the others keep their proportions; repeated document rows count once; empty tables give an
empty mixture; other columns are ignored.

A tilt that is not found within ``rounds`` is an error.

Scale: one shuffle of (document, source, tokens), no text; blocks of a source are a bounded number of rows each, so a
source that holds a third of all documents is rounded by many tasks. The driver holds one row per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut

SCALE = 1000.0  # tokens are counted in thousands inside the exponent


def sizes(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens), written once to the shared folder."""
    named = documents.where("doc_id is not null and source is not null and text is not null and text <> ''").select("doc_id", "source", "text")
    # the source travels inside the key, which is unique, so that no join with the texts is needed
    shared = named.sparkSession.sparkContext.broadcast((tokens.serialise(tokens.read_ranks(path or tokens.vocabulary_path())), tokens.pattern()))

    def run(batches):
        import pyarrow as pa

        codec = tokens.Codec(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(codec.encode(t)) for t in b.column(2).to_pylist()], pa.int64())], ["doc_id", "source", "n_tokens"])

    return cut(named.mapInArrow(run, "doc_id long, source string, n_tokens long").dropDuplicates(["doc_id"]), "token-sizes")


def solve(counted: DataFrame, targets: list[dict], total: float | None = None, rounds: int = 60) -> tuple[dict[str, float], float]:
    """Tilts by source, and the total; ``counted``: (source, n_tokens, docs)."""
    have = {r["source"]: r["tokens"] for r in counted.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("tokens")).collect()}  # one row per source
    wanted = {t["source"]: (float(t["target_share"]), int(t["max_repeats"])) for t in targets if have.get(t["source"]) and (t["target_share"] or 0) > 0 and (t["max_repeats"] or 0) > 0}
    if not wanted:
        return {}, 0.0
    whole = sum(s for s, _ in wanted.values())
    share = {k: s / whole for k, (s, _) in wanted.items()}
    most = min(have[k] * cap / share[k] for k, (_, cap) in wanted.items())
    total = min(total, most) if total else most
    goal = {k: share[k] * total for k in wanted}
    spark = counted.sparkSession
    tilt = {k: 0.0 for k in wanted}
    low, high = {k: -1e6 for k in wanted}, {k: 1e6 for k in wanted}
    full = {k for k, (_, cap) in wanted.items() if goal[k] >= have[k] * cap * (1 - 1e-9)}  # every document at its bound
    for k in full:
        tilt[k] = 1e6
    open_ = set(wanted) - full
    x = F.col("n_tokens") / SCALE
    for _ in range(rounds):
        if not open_:
            break
        now = spark.createDataFrame([(k, tilt[k], float(wanted[k][1])) for k in sorted(open_)], "source string, tilt double, cap double")
        free = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        rate = F.least(free, F.col("cap"))
        sums = (
            counted.join(F.broadcast(now), "source")
            .groupBy("source")
            .agg(F.sum(rate * F.col("n_tokens") * F.col("docs")).alias("f"), F.sum(F.when(free < F.col("cap"), free * F.col("n_tokens") * x * F.col("docs")).otherwise(0.0)).alias("g"))
            .collect()  # one row per source
        )
        for r in sums:
            k = r["source"]
            miss = r["f"] - goal[k]
            if abs(miss) <= 1e-6 * goal[k]:
                open_.discard(k)
                continue
            (high if miss > 0 else low)[k] = tilt[k]
            step = tilt[k] - miss / r["g"] if r["g"] > 0 else None
            if step is None or not low[k] < step < high[k]:
                if high[k] > 1e5:
                    step = max(1.0, 2 * abs(low[k]))
                elif low[k] < -1e5:
                    step = min(-1.0, -2 * abs(high[k]))
                else:
                    step = (low[k] + high[k]) / 2
            tilt[k] = step
    if open_:
        raise RuntimeError(f"no tilt found within {rounds} rounds for {sorted(open_)}")
    return tilt, total


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, path: str | None = None, block_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The chosen documents (doc_id, source, n_tokens, copies), and the shares
    (source, target_share, max_repeats, documents, available_tokens, chosen_tokens, actual_share)."""
    spark = documents.sparkSession
    sized = sizes(documents, path)
    counted = cut(sized.where("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count("*").alias("docs")), "token-counts")
    rows = [r.asDict() for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()]  # one row per source
    tilt, _ = solve(counted, rows, total)
    cap = {r["source"]: r["max_repeats"] for r in rows}
    docs = {r["source"]: r["n"] for r in counted.groupBy("source").agg(F.sum("docs").alias("n")).collect()}  # one row per source
    model = spark.createDataFrame([(k, float(v), float(cap[k]), int(docs[k] // block_rows + 1)) for k, v in sorted(tilt.items())], "source string, tilt double, cap double, blocks int")
    rated = (
        sized.where("n_tokens > 0")
        .join(F.broadcast(model), "source")
        .withColumn("rate", F.least(F.exp(F.least(F.col("tilt") * F.col("n_tokens") / SCALE, F.lit(50.0))), F.col("cap")))
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    )
    w = Window.partitionBy("source", "block").orderBy("n_tokens", "doc_id")
    start = F.pmod(F.xxhash64("source", "block"), F.lit(1000)) / 1000
    upto = F.sum("rate").over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("rate").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = lambda c: F.floor(F.round(c + start, 9))
    chosen = (
        rated.withColumn("copies", F.least(whole(upto) - whole(before), F.col("cap").cast("long")).cast("int"))
        .where("copies > 0")
        .select("doc_id", "source", "n_tokens", "copies")
    )
    got = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("chosen_tokens"))
    have = counted.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("available_tokens"))
    named = spark.createDataFrame([(r["source"], r["target_share"], r["max_repeats"]) for r in rows], "source string, target_share double, max_repeats int")
    all_ = got.agg(F.sum("chosen_tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    shares = (
        named.join(got, "source", "left")
        .join(have, "source", "left")
        .crossJoin(F.broadcast(all_))  # one row
        .select("source", "target_share", "max_repeats", zero("documents"), zero("available_tokens"), zero("chosen_tokens"), F.round(F.coalesce(F.col("chosen_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"))
    )
    return chosen, shares
