import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import near_dup, neighbours, queries, ranking

S = "query_id long, asset_id string, semantic_score double, keyword_score double, combined_score double, visual_score double, category_score double"


def brute_fusion(rows, k=60):
    best = {}
    for q, a, *scores in rows:
        if q is not None and a is not None:
            old = best.setdefault((q, a), [None] * 5)
            for n, v in enumerate(scores):
                if v is not None and v == v and v != 0 and (old[n] is None or v > old[n]):
                    old[n] = v
    out = {}
    for (q, a), scores in best.items():
        total = 0.0
        for n, v in enumerate(scores):
            if v is not None:
                others = [s[n] for (p, _), s in best.items() if p == q and s[n] is not None]
                total += 1 / (k + sum(o > v for o in others) + (sum(o == v for o in others) + 1) / 2)
        out[q, a] = round(total, 12)
    return out


def test_fusion_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(q, f"a{rng.randrange(30)}", rng.choice([None, 0.0, float("nan"), rng.random()]), rng.gauss(0, 1e6), rng.choice([1e-300, 1e300, -5.0, 2.0]), 0.7, rng.random()) for q in (1, 2, None) for _ in range(60)] + [(3, "x", None, None, None, None, None), (4, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, S).withColumn("fused", F.lit("clash")).withColumn("rank", F.lit(None).cast("int"))
    got = {(r["query_id"], r["asset_id"]): r["fused"] for r in ranking.fuse_rankings(df, "query_id", "asset_id").collect()}
    want = brute_fusion(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-12 for k in want)
    assert got[3, "x"] == 0.0


def test_fusion_of_nothing_and_ties(spark):
    assert ranking.fuse_rankings(spark.createDataFrame([], S), "query_id", "asset_id").count() == 0
    df = spark.createDataFrame([(1, a, 0.5, 0.5, 0.5, 0.5, 0.5) for a in "cab"], S)
    top = ranking.first_of_each(ranking.fuse_rankings(df, "query_id", "asset_id"), "query_id", "asset_id", 2).orderBy("position").collect()
    assert [r["asset_id"] for r in top] == ["a", "b"]


def jaccard(a, b, n):
    x, y = ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in ([t for t in re.findall(r"[^\W_]+", s.lower())] for s in (a, b)))
    return len(x & y) / len(x | y) if x | y else 0.0


def library(rng, n):
    words = [f"word{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(25, 90))) for _ in range(n)]
    for k in range(n):
        w = texts[k].split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w = w[5:] + w[:5]
        texts.append(" ".join(w))
    return texts


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    texts = library(rng, 120) + ["one two three"] * 3 + ["same " * 3 + " ".join(map(str, range(30)))] * 3
    rows = [(f"i{k:04}", t) for k, t in enumerate(texts)] + [("null", None), ("empty", ""), ("i0000", texts[0])]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("cls", F.lit("clash")).withColumn("tokens", F.lit(1))
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in near_dup.near_duplicate_pairs(df, threshold=0.5, shingle=3, min_words=20).collect()}
    once = dict(rows[:-3])
    want = {(a, b): s for a, b in itertools.combinations(sorted(once), 2) if min(len(re.findall(r"[^\W_]+", once[x])) for x in (a, b)) >= 20 and (s := jaccard(once[a], once[b], 3)) >= 0.5}
    assert len(want) > 60 and set(got) <= set(want)
    assert len(set(got) & set(want)) >= 0.97 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_no_pair_at_the_threshold_is_missed(spark):
    """750 pairs of a similarity of exactly 0.5 and as many just below."""
    rng = random.Random(9)
    rows, want = [], set()
    for k in range(1500):
        w = [f"k{k}w{j}" for j in range(90)]
        v = w[: 60 + k % 2] + [f"k{k}v{j}" for j in range(30)]
        rows += [(f"{k:04}a", " ".join(w)), (f"{k:04}b", " ".join(v))]
        if jaccard(rows[-2][1], rows[-1][1], 3) >= 0.5:
            want.add((f"{k:04}a", f"{k:04}b"))
    rng.shuffle(rows)
    got = {(r["id_a"], r["id_b"]) for r in near_dup.near_duplicate_pairs(spark.createDataFrame(rows, "id string, text string"), threshold=0.5, shingle=3, min_words=20).collect()}
    assert len(want) >= 700 and got == want


def test_near_duplicates_of_nothing_and_long_texts(spark):
    assert near_dup.near_duplicate_pairs(spark.createDataFrame([], "id string, text string")).count() == 0
    long = " ".join(f"w{k}" for k in range(60_000))
    df = spark.createDataFrame([("a", long), ("b", long + " more"), ("c", long.upper())], "id string, text string")
    assert {(r["id_a"], r["id_b"]) for r in near_dup.near_duplicate_pairs(df).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_large_groups_are_compared_in_blocks(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(f"i{k:03}", " ".join([*base, f"tail{k}"])) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, text string")
    assert near_dup.near_duplicate_pairs(df, block=8).count() == 40 * 39 // 2


def test_large_classes_of_copies_become_stars(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(f"i{k:03}", text) for k in range(10)] + [("x", text + " more")], "id string, text string")
    got = {(r["id_a"], r["id_b"]) for r in near_dup.near_duplicate_pairs(df, expand=4).collect()}
    assert got == {("i000", f"i{k:03}") for k in range(1, 10)} | {(f"i{k:03}", "x") for k in range(10)}


def test_infinite_and_extreme_scores_have_ranks(spark):
    inf = float("inf")
    rows = [("a", inf), ("b", inf), ("c", 1e308), ("d", 1e-308), ("e", -1e-308), ("f", -1e308), ("g", -inf)]
    df = spark.createDataFrame([(1, i, v) for i, v in rows], "q long, i string, s double")
    got = {r["i"]: r["rank"] for r in ranking.rank_scores(df, "q", "i", ("s",)).collect()}
    assert got == {"a": 1.5, "b": 1.5, "c": 3, "d": 4, "e": 5, "f": 6, "g": 7}


def shared_library(rng):
    """Chunks with copies and edited copies in files of known, equal and unknown digests."""
    texts = library(rng, 60)
    rows = []
    for k, t in enumerate(texts):
        for c in range(rng.choice([1, 1, 2, 5])):
            rows.append((f"i{k:03}{c}", rng.choice([*"ABCDEF", None]), t))
    assets = [("A", "FF"), ("A", None), ("B", "ff"), ("C", "aa"), ("D", None), ("E", "aa"), ("E", "AA")]
    sha = {"A": "ff", "B": "ff", "C": "aa", "E": "aa"}
    pairs = set()
    for x, y in itertools.combinations(sorted(rows), 2):
        if min(len(r[2].split()) for r in (x, y)) >= 20 and (x[1] not in sha or sha[x[1]] != sha.get(y[1])) and jaccard(x[2], y[2], 3) >= 0.5:
            pairs.add((x[0], y[0]))
    return rows, assets, sha, pairs


@pytest.mark.parametrize("seed", (1, 2))
def test_pairs_and_groups_with_digests_equal_brute_force(spark, seed):
    rows, assets, sha, want = shared_library(random.Random(seed))
    chunks, files = spark.createDataFrame(rows, "id string, asset_id string, text string").withColumn("digest", F.lit("clash")), spark.createDataFrame(assets, "id string, sha256 string")
    how = dict(threshold=0.5, shingle=3, min_words=20, digests=near_dup.known_digests(files))
    assert {(r["id_a"], r["id_b"]) for r in near_dup.near_duplicate_pairs(chunks, **how).collect()} == want
    # in the compact form every pair is led to by members of the same text and digest
    compact = {(r["id_a"], r["id_b"]) for r in near_dup.near_duplicate_pairs(chunks, expand=1, **how).collect()}
    unit = {i: (t, sha.get(a) or i) for i, a, t in rows}
    led = {frozenset((unit[a], unit[b])) for a, b in compact}
    assert compact <= want and all(frozenset((unit[a], unit[b])) in led for a, b in want if unit[a][0] != unit[b][0])
    label = {i: i for p in want for i in p}
    for _ in label:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["id"]: (r["group_id"], r["links"]) for r in near_dup.near_duplicate_groups(chunks, **how).collect()}
    assert got == {i: (g, sum(i in p for p in want)) for i, g in label.items()}
    members = {r["id"]: (r["cls"], r["digest"]) for r in near_dup.membership(chunks, digests=near_dup.known_digests(files)).collect()}
    assert {i: sha.get(a) for i, a, _ in rows} == {i: d for i, (_, d) in members.items()} and len({c for c, _ in members.values()}) == len({t for _, _, t in rows})


def test_frequent_columns_and_groups_are_split(spark, monkeypatch):
    rng = random.Random(4)
    texts = library(rng, 80)
    df = spark.createDataFrame([(f"i{k:03}", t) for k, t in enumerate(texts)], "id string, text string")
    run = lambda: {(r["id_a"], r["id_b"]) for r in near_dup.near_duplicate_pairs(df, threshold=0.5, shingle=3, min_words=20).collect()}
    whole = run()
    for name, value in (("COLUMN_ROWS", 5), ("HELD", 3), ("BLOCK", 2), ("QUERIES", 2)):
        monkeypatch.setattr(near_dup, name, value)
    assert whole and run() == whole


def test_copies_of_a_large_class_keep_all_pairs_but_known_copies(spark, tmp_path):
    """Copies in files of other digests stay linked to each other and to neighbours, whatever becomes of the smallest id."""
    text = " ".join(f"w{k}" for k in range(30))
    chunks = [(f"i{k:03}", f"a{k % 7}" if k % 10 else None, text) for k in range(70)] + [("n", "a0", text + " more")]
    assets = [(f"a{k}", None if k == 6 else "FF" if k % 2 else "ff" if k == 2 else f"d{k}") for k in range(7)]
    spark.createDataFrame(chunks, "id string, asset_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame(assets, "id string, sha256 string").write.parquet(f"{tmp_path}/assets.parquet")
    sha = {a: s and s.lower() for a, s in assets} | {None: None}
    want = {(x[0], y[0]) for x, y in itertools.combinations(sorted(chunks), 2) if sha[x[1]] is None or sha[x[1]] != sha[y[1]]}
    assert {(r["id_a"], r["id_b"]) for r in queries.p2_found(spark, str(tmp_path)).collect()} == want


def test_groups_of_pairs(spark):
    chain = [(f"n{k:02}", f"n{k + 1:02}") for k in range(20)]
    pairs = spark.createDataFrame([*chain, ("z2", "z1"), ("q", "q")], "id_a string, id_b string").withColumn("label", F.lit(1))
    got = {r["id"]: (r["group_id"], r["links"]) for r in near_dup.groups_of(pairs).collect()}
    assert got == {f"n{k:02}": ("n00", 2 if 0 < k < 20 else 1) for k in range(21)} | {"z1": ("z1", 1), "z2": ("z1", 1)}
    assert near_dup.groups_of(pairs.where("false")).count() == 0


V = "id string, e array<float>, space string, d int"


def test_neighbours_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(150, 32))
    x = np.concatenate([c + rng.normal(scale=0.25, size=(10, 32)) for c in centres])
    rows = [(f"i{k:05}", [float(y) for y in v * (1 + k % 3)], "s" if k % 5 else "t", 32) for k, v in enumerate(x)]
    bad = [("n1", None, "s", 32), ("n2", [1.0] * 31, "s", 32), ("n3", [0.0] * 32, "s", 32), ("n4", [float("nan")] * 32, "s", 32), ("n5", [1.0] * 32, None, 32), ("n6", [float("inf")] * 32, "s", 32), ("n7", [1.0] * 32, "s", None)]
    df = spark.createDataFrame(rows + bad + rows[:20], V).withColumn("cls", F.lit("clash")).withColumn("v", F.lit(1))
    got = {(r["id"], r["other"]) for r in neighbours.nearest(df, "id", "e", "space", "d", k=5, least=0.8, list_size=64).collect()}
    want = set()
    for s in "st":
        own = [k for k, r in enumerate(rows) if r[2] == s]
        u = x[own] / np.linalg.norm(x[own], axis=1, keepdims=True)
        sim = u @ u.T
        np.fill_diagonal(sim, -1)
        for r, row in enumerate(sim):
            want |= {(rows[own[r]][0], rows[own[c]][0]) for c in np.argsort(-row)[:5] if row[c] >= 0.8}
    assert len(want) > 1000 and len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.98 * len(got)


@pytest.mark.parametrize("count", (3, 40, 3000))
def test_nearest_lists_are_the_nearest_however_many_there_are(count):
    """Random directions: nothing leads from one centroid to the next."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(count * 8, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = neighbours.Lists(x, len(x), 8)
    every = x @ lists.centroids.T
    ids, sim = lists.near(x, 6)
    want = min(6, len(lists.centroids))
    assert ids.shape == sim.shape == (len(x), want)
    assert np.allclose(sim, -np.sort(-every, axis=1)[:, :want], atol=1e-5) and np.allclose(np.take_along_axis(every, ids, 1), sim, atol=1e-5)


def test_long_lists_are_split_where_they_are_searched(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(200, 16))
    x = np.concatenate([c + rng.normal(scale=0.2, size=(30, 16)) for c in centres]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    every = np.arange(len(x))
    monkeypatch.setattr(neighbours, "INNER", 1000)
    best = (x @ x.T - 3 * np.eye(len(x))).argmax(axis=1)
    seen, work = set(), 0
    for q, m in neighbours.inner_lists(x, every, every):
        inside = set(m.tolist())
        seen.update(int(k) for k in q if int(best[k]) in inside)
        work += len(q) * len(m)
    assert len(seen) >= 0.97 * len(x) and work < 0.6 * len(x) ** 2
    assert not list(neighbours.inner_lists(x, every[:0], every)) and len(list(neighbours.inner_lists(x, every[:9], every[:900]))) == 1


def test_neighbours_of_copies_and_of_nothing(spark):
    df = spark.createDataFrame([(f"c{k:02}", [1.0, 2.0, 3.0], "s", 3) for k in range(12)] + [("z", [-1.0, 0.0, 0.0], "s", 3)], V)
    got = neighbours.nearest(df, "id", "e", "space", "d").collect()
    assert len(got) == 60 and {r["other"] for r in got if r["id"] == "c11"} == {f"c{k:02}" for k in range(5)}
    assert neighbours.nearest(spark.createDataFrame([], V), "id", "e", "space", "d").count() == 0
