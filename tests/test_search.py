import math

import pytest
from pyspark.sql import functions as F

from quillspark.api import Engine
from quillspark.constants import WEIGHTS
from quillspark.operators import chunking, postings, similarity
from quillspark.plans import intent, search


def test_weights_sum_to_one():
    for row in WEIGHTS.values():
        assert math.isclose(sum(row.values()), 1.0)


def docs(spark, rows):
    return postings.tokenised(spark.createDataFrame(rows, "id int, text string"), "id")


def test_bm25_by_hand_with_prefix_and_phrase(spark):
    rows = [(1, "red kettle red"), (2, "kettles are red"), (3, "blue pot"), (4, None), (5, "pot pot pot pot"), (6, "green"), (7, "nothing here at all")]
    queries = spark.createDataFrame([(0, ["red", "kettle"])], "query_id int, terms array<string>")
    got = {r["id"]: r["score"] for r in postings.bm25(docs(spark, rows), "id", queries).collect()}
    n, avg = 6, (3 + 3 + 2 + 4 + 1 + 4) / 6
    value = lambda f, length, df: postings.bm25_value(df, n, f, length, avg)
    assert got.keys() == {1, 2}
    assert got[1] == pytest.approx(value(2, 3, 2) + value(1, 3, 2) + value(1, 3, 1))
    assert got[2] == pytest.approx(value(1, 3, 2) * 2)  # the phrase takes no prefix


def test_bm25_no_terms_no_hits(spark):
    queries = spark.createDataFrame([(0, [])], "query_id int, terms array<string>")
    assert postings.bm25(docs(spark, [(1, "a b")]), "id", queries).count() == 0


def test_windows_match_a_loop(spark):
    for n in (0, 1, 350, 351, 640, 641, 1500):
        words = [f"w{k}" for k in range(n)]
        want, at = [], 0
        while at < n:
            want.append(" ".join(words[at : at + 350]))
            if at + 350 >= n:
                break
            at += 290
        df = spark.createDataFrame([(1, " ".join(words))], "id int, text string")
        assert [r["text"] for r in chunking.word_windows(df, ["id"]).orderBy("chunk_index").collect()] == want


def test_regions(spark):
    df = spark.createDataFrame([(1, 800, 600), (2, 5000, 3000), (3, 1080, 7000), (4, 0, 5), (5, 1080, 4000)], "id int, width int, height int")
    got = chunking.image_regions(df, "id").groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {1: 1, 2: 9, 3: 6, 5: 3}


def plan_of(spark, text, **how):
    return intent.plan(spark.createDataFrame([(0, text)], "query_id int, query_text string"), **how).first()


def test_intents(spark):
    assert plan_of(spark, "INV-93472")["primary_intent"] == "exact_identifier"
    p = plan_of(spark, "train tickets")
    assert p["labels"] == ["train_ticket"] and not p["broad"] and p["primary_label"] == "train_ticket" and p["document_types"] == ["train_ticket"]
    p = plan_of(spark, "tickets")
    assert p["broad"] and len(p["labels"]) == 5 and p["primary_intent"] == "category"
    p = plan_of(spark, "dogs")
    assert p["visual_query"] and p["prompts"] == ["dog", "a photo of dog"]
    assert plan_of(spark, "notes about the pdf")["extensions"] == ["pdf"]
    assert plan_of(spark, "")["intents"] == [] and plan_of(spark, "")["primary_intent"] == "semantic_text"


def test_intent_words_inside_words(spark):
    assert plan_of(spark, "roadmap video for the long project plan")["primary_intent"] == "visual"
    assert plan_of(spark, "roadmap video for the long project plan", word_boundary=True)["primary_intent"] != "visual"


def test_ties_go_to_the_smaller_id_and_bad_scores_drop(spark):
    rows = [(0, "exact", "b", 1.0), (0, "exact", "a", 1.0), (0, "exact", "c", float("nan")), (0, "exact", "d", 0.0), (0, "exact", "e", None)]
    got = search.rank_channels(spark.createDataFrame(rows, "query_id int, channel string, asset_id string, score double")).orderBy("rank").collect()
    assert [r["asset_id"] for r in got] == ["a", "b"]


@pytest.mark.parametrize(
    "scores, query, want",
    [
        ({"exact": 0.1}, {}, "strong"),
        ({"semantic": 0.99}, {}, None),
        ({"semantic": 0.9, "metadata": 1.0}, {}, "moderate"),
        ({"metadata": 2.0}, {}, "strong"),
        ({"filename": 1.0}, {"n_terms": 1}, None),
        ({"filename": 1.0}, {"n_terms": 2}, "strong"),
        ({"visual": 0.2}, {"visual_query": True}, "candidate"),
        ({"visual_tag": 0.9, "visual": 0.2}, {"visual_query": True, "document_query": True}, "candidate"),
        ({"entity": 0.8}, {}, "strong"),
    ],
)
def test_gate(spark, scores, query, want):
    base = {c: 0.0 for c in ("exact", "semantic", "visual", "visual_tag", "document_type", "entity", "metadata", "filename")} | scores
    q = {"visual_query": False, "document_query": False, "n_terms": 2} | query
    df = spark.createDataFrame([{**base, **q, "fused": 0.1, "asset_id": "a", "query_id": 0}])
    assert search.strengths(df).first()["confidence"] == want


def test_region_blend_and_robust_z(spark):
    s = spark.createDataFrame([(1, -1, 0.9), (1, -2, 0.5), (1, -3, 0.1), (2, -1, 0.4)], "a int, r int, s double")
    got = {r["a"]: (r["score"], r["best_region"]) for r in similarity.roll_up(s, "a", "r", "s").collect()}
    assert got == {1: (pytest.approx(0.82), -1), 2: (pytest.approx(0.4), -1)}
    z = {r["k"]: r["z"] for r in similarity.robust_z(spark.createDataFrame([(k, 0.5) for k in range(5)], "k int, s double"), "s").collect()}
    assert set(z.values()) == {0.0}


def test_mcut_floor_and_gap(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.85), (1, 0.3), (2, 0.5), (3, 0.1), (3, 0.05)], "k int, s double")
    got = {r["k"]: r["threshold"] for r in similarity.mcut(df, "k", "s").collect()}
    assert got == {1: pytest.approx(0.575), 2: 0.2, 3: 0.2}


def test_vector_hits_reach_every_allowed_asset(spark):
    """An asset of very many near chunks, or one that is filtered out, leaves no other asset without its score."""
    rows = [(f"c{k:04}", "big" if k % 2 else "out", [1.0, 0.0], "txt-base/v3", 2) for k in range(2400)] + [("s1", "small", [1.0, 1.0], "txt-base/v3", 2), ("s2", "small", [0.0, 1.0], "txt-base/v3", 2)]
    chunks = spark.createDataFrame(rows, "id string, asset_id string, embedding array<float>, embedding_profile_id string, embedding_dimensions int")
    assets = spark.createDataFrame([("big",), ("small",)], "id string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, q array<float>")
    got = {r["asset_id"]: (r["chunk_id"], r["semantic"]) for r in Engine(spark, "").near_chunks(chunks, assets, vectors).collect()}
    assert got == {"big": ("c0001", 1.0), "small": ("s1", pytest.approx(0.707107))}


def test_document_types_come_from_texts_too(spark):
    assets = spark.createDataFrame([("a", "scan1.png"), ("b", "invoice.pdf"), ("c", "scan2.png"), ("d", "x.txt")], "id string, filename string")
    chunks = spark.createDataFrame([("a", "nothing"), ("a", "Boarding Pass"), ("b", None), ("c", "TAX INVOICE"), ("c", "your PNR is"), ("d", "plain")], "asset_id string, text string")
    got = {r["asset_id"]: (r["document_type"], r["confidence"]) for r in Engine.document_types(chunks, assets).collect()}
    assert got == {"a": ("flight_ticket", 0.88), "b": ("invoice", 0.86), "c": ("train_ticket", 0.92)}


def test_tag_channel_matches_words_and_starts(spark):
    plans = spark.createDataFrame([(0, ["lighthouse", "keeper"])], "query_id int, terms array<string>")
    tags = spark.createDataFrame([("a", "old lighthouse", 0.4), ("b", "lighthouses of", 0.9), ("c", "lighthouse keeper hut", 0.7), ("d", "house", 0.9)], "asset_id string, normalized_label string, confidence double")
    got = {r["asset_id"]: r["score"] for r in search.tag_channel(plans, tags).collect()}
    assert got == {"a": 0.4, "c": 0.7}
