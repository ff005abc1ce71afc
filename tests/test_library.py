import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import vectors as VV
from quillspark.operators import evaluate, library, metadata, queue
from quillspark.sources import files, providers
from quillspark.streaming.retry import state_of, step


def test_reconcile_classifies_each_path(spark):
    t = dt.datetime(2024, 1, 1)
    old = spark.createDataFrame(
        [("1", "/r/a", "f", "AA", "indexed", t), ("2", "/r/b", "f", "bb", "indexed", t), ("3", "/r/c", "f", "cc", "failed", t), ("4", "/r/d", "f", "dd", "indexed", t), ("5", "/r/e", "f", "ee", "indexed", t)],
        "id string, absolute_path string, folder_id string, sha256 string, status string, indexed_at timestamp",
    )
    scan = spark.createDataFrame([("/r/a", "f", "aa"), ("/r/b", "f", "xx"), ("/r/c", "f", "cc"), ("/r/new", "f", "zz"), ("/r/moved", "f", "dd")], "absolute_path string, folder_id string, sha256 string")
    got = {r["absolute_path"]: (r["change"], r["id"]) for r in library.reconcile(old, scan).collect()}
    assert got["/r/a"] == ("unchanged", "1") and got["/r/b"] == ("changed", "2") and got["/r/c"] == ("changed", "3")
    assert got["/r/moved"] == ("moved", "4") and got["/r/e"] == ("missing", "5") and got["/r/new"][0] == "new" and "/r/d" not in got


def test_latest_upsert_ignore(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "id string, v int, s string")
    assert {(r["id"], r["s"]) for r in library.latest(df, ["id"], [F.col("v")]).collect()} == {("a", "y"), ("b", None)}
    new = spark.createDataFrame([("a", 9, "n"), ("c", 9, "n")], "id string, v int, s string")
    assert {r["id"]: r["v"] for r in library.upsert(df.where("v = 1"), new, ["id"]).collect()} == {"a": 9, "b": 1, "c": 9}
    assert {r["id"]: r["v"] for r in library.insert_ignore(df.where("v = 1"), new, ["id"]).collect()} == {"a": 1, "b": 1, "c": 9}


def test_content_dedup_takes_best_then_smallest_id(spark):
    df = spark.createDataFrame([("b", "c1", 1.0), ("a", "c1", 1.0), ("z", "c1", 0.5), ("q", "c2", 0.1)], "id string, content_id string, s double")
    assert {(r["id"], r["other_places"]) for r in library.first_of_content(df, "s").collect()} == {("a", 2), ("q", 0)}


def test_attempts(spark):
    df = spark.createDataFrame([("visual", 1), ("visual", 2), ("text_embedding", 2), ("text_embedding", 3)], "stage string, attempts int")
    assert [r["next_state"] for r in queue.after_failure(df).collect()] == ["pending", "failed", "pending", "failed"]


def test_retry_fold_equals_step():
    f, s = step(0, 0, ["error", "ok", "error", "error"], "error", "ok")
    assert (f, s) == (2, 1) and state_of(f, s, 3) == "pending" and state_of(3, s, 3) == "failed" and state_of(0, 1, 3) == "indexed"


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/c.txt", "/a/b"), ("/a/bc/c.txt", "/a/b"), ("/a/b/../x", "/a/b"), ("/a/b/.git/x.txt", "/a/b"), ("/a/b/Build/x.txt", "/a/b")], "p string, r string")
    assert [r["i"] for r in df.select(files.is_inside(F.col("p"), F.col("r")).alias("i")).collect()] == [True, False, False, True, True]
    assert [r["k"] for r in df.select(files.is_kept(F.col("p"), F.col("r")).alias("k")).collect()][3:] == [False, False]


def test_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xff\xc3\xa9")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.txt").write_text("no")
    (tmp_path / "pic").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"x")
    (tmp_path / "x.exe").write_bytes(bytes.fromhex("89504E470D0A1A0A"))
    (tmp_path / "empty.md").write_bytes(b"")
    got = {r["filename"]: r for r in files.as_assets(files.scan(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert got.keys() == {"a.txt", "pic"}  # the reader passes over files without bytes
    assert got["a.txt"]["text"] == "caf�é" and got["pic"]["extension"] == "png"
    sizes = spark.createDataFrame([(0,), (5,), (64 * 1024 * 1024 + 1,)], "n long").select(files.size_state(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in sizes] == ["empty", None, "too large"]


def test_label_file(spark, tmp_path):
    (tmp_path / "tags.csv").write_text("name,category\nlong_hair,0\nsomeone,4\ngeneral,9\n")
    assert [(r["label"], r["namespace"]) for r in files.read_labels(spark, str(tmp_path / "tags.csv")).collect()] == [("long hair", "general"), ("someone", "character"), ("general", "rating")]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([float("nan"), 1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(VV.cosine(F.col("a"), F.col("b")).alias("c"), VV.is_valid(F.col("a"), 2).alias("v"), VV.normalise(F.col("a"), 2).alias("n")).collect()
    assert rows[0]["c"] == pytest.approx(0.96) and rows[0]["n"] == [pytest.approx(0.6), pytest.approx(0.8)]
    assert rows[1]["c"] == 0.0 and rows[2]["c"] == 0.0 and [r["v"] for r in rows] == [True, False, False, False]


def test_metadata_entities_types(spark):
    text = "PNR: ABCDE12345 train no 12951 from Delhi to Mumbai\nFare Rs. 1,250.50 on 2024-05-06 at 10:30 pm, mail a@example.com or b@example.com. Rs. 1,250.50"
    df = spark.createDataFrame([(1, text, "x.txt"), (2, None, None), (3, "", "y.md")], "id int, text string, filename string")
    m = metadata.extract(df)
    r = m.where("id = 1").first()
    assert r["emails"] == ["a@example.com", "b@example.com"] and r["dates"] == ["2024-05-06"] and r["times"] == ["10:30 pm"]
    assert [(a["raw"], a["value"], a["currency"]) for a in r["amounts"]] == [("Rs. 1,250.50", 1250.5, "INR")]
    ents = {(e["entity_type"], e["normalized_value"]) for e in metadata.entities(m, "id").where("id = 1").collect()}
    assert {("pnr", "ABCDE12345"), ("train_number", "12951"), ("origin", "DELHI"), ("destination", "MUMBAI"), ("date", "2024-05-06")} <= ents
    types = {t["id"]: (t["document_type"], t["evidence"]) for t in metadata.classify(df).collect()}
    assert types[1] == ("train_ticket", ["pnr", "train"]) and types[2][0] == "other" and types[3] == ("other", [])


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, asset_id string, position int")
    labels = spark.createDataFrame([(1, "b", 3), (1, "z", 2), (1, "a", 0)], "query_id int, asset_id string, relevance int")
    r = evaluate.evaluate(ranked, labels).first()
    assert (r["precision_1"], r["precision_5"], r["recall_10"], r["reciprocal_rank"]) == (0.0, 0.2, 0.5, 0.5)


def test_embedding_provider_and_cache(spark):
    p = providers.HashingEmbedder(8)
    df = providers.embed_column(spark.createDataFrame([("a b",), (None,)], "text string"), p)
    rows = df.collect()
    assert np.linalg.norm(rows[0]["embedding"]) == pytest.approx(1, abs=1e-6) and rows[0]["embedding_dimensions"] == 8 and not any(rows[1]["embedding"])
    with pytest.raises(ValueError):
        providers.check_profile(p, 9)
    now, calls = [0.0], []
    c = providers.TextEmbeddingCache(2, 10, lambda: now[0])
    make = lambda t: calls.append(t) or len(calls)
    assert (c.get("A ", make), c.get("a", make), c.get("b", make), c.get("c", make)) == (1, 1, 2, 3) and len(c.rows) == 2
    now[0] = 11
    c.get("c", make)
    assert len(calls) == 4


def test_streamed_retry_equals_batch(spark, tmp_path):
    from quillspark.streaming.retry import retry_states

    rows = [(k % 3, "error" if k % 4 else "ok", k) for k in range(60)]
    df = spark.createDataFrame(rows, "user long, kind string, ts long")
    df.write.parquet(str(tmp_path / "in"))
    q = retry_states(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user", "kind", "ts", "error", "ok", 3).writeStream.outputMode("update").format("memory").queryName("retries").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["key"]: (r["failures"], r["state"]) for r in spark.table("retries").collect()}
    want = {r["user"]: (r["failures"], r["state"]) for r in queue.fold_events(df, "user", "kind", ["ts"], "error", "ok", 3).collect()}
    assert got == want


def test_streamed_ingest_equals_batch(spark, tmp_path):
    from quillspark.operators.chunking import word_windows
    from quillspark.streaming.ingest import ingest

    df = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(100 * k))) for k in range(8)], "doc_id long, text string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp"), 1).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "chunk_index", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, word_windows(df, ["doc_id"]).collect()))
