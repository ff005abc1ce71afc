import pytest
from pyspark.sql import functions as F

from quillspark import schema as S
from quillspark.operators import maintenance as M


def chunk(spark, rows):
    """rows: (id, asset_id, chunk_index, text, source)"""
    return spark.createDataFrame([(i, a, n, None, t, None, s, None, None) for i, a, n, t, s in rows], S.CHUNKS)


def test_generated_chunks_replace_delete_and_append(spark):
    old = chunk(spark, [("1", "A", 0, "text", None), ("2", "A", 4, "cat, sofa", "visual_tags"), ("3", "B", 0, "x", None), ("4", "C", 2, "old", "visual_tags")])
    new = chunk(spark, [("n2", "A", None, "dog, park", "visual_tags"), ("n3", "B", None, "hill", "visual_tags"), ("n4", "C", None, "  ", "visual_tags"), ("n5", "D", None, "lake", "visual_tags")])
    got = {(r["id"], r["asset_id"], r["chunk_index"]) for r in M.upsert_generated(old, new).collect()}
    assert got == {("1", "A", 0), ("n2", "A", 4), ("3", "B", 0), ("n3", "B", 1), ("n5", "D", 0)}
    assert M.upsert_generated(old, new.where("false")).count() == 4
    more = chunk(spark, [("y", "A", None, "b", None), ("x", "A", None, "a", None), ("z", "E", None, None, None)])
    assert {(r["id"], r["chunk_index"]) for r in M.append_chunks(old, more).where("id in ('x', 'y', 'z')").collect()} == {("x", 5), ("y", 6)}
    assert {r["id"] for r in M.replace_chunks(old, more, more).collect()} == {"3", "4", "x", "y", "z"}


JOBS = "id string, asset_id string, state string, attempts int, error_message string, updated_at timestamp"


def test_transitions_follow_the_table(spark):
    jobs = spark.sql("select * from values ('p', 'A', 'pending', 0, null), ('r', 'A', 'processing', 1, null), ('f', 'A', 'failed', 2, 'no'), ('d', 'A', 'indexed', 1, null) as t(id, asset_id, state, attempts, error_message)").withColumn("updated_at", F.lit("2026-01-01").cast("timestamp"))
    ask = lambda rows: spark.createDataFrame(rows, "id string, event string, message string").withColumn("at", F.lit("2026-02-01").cast("timestamp"))
    got = {r["id"]: r for r in M.transition(jobs, ask([("p", "start", None), ("r", "fail", "broken"), ("f", "retry", None), ("d", "cancel", None), ("zz", "start", None)])).collect()}
    assert (got["p"]["state"], got["p"]["attempts"]) == ("processing", 1)
    assert (got["r"]["state"], got["r"]["error_message"]) == ("failed", "broken")
    assert (got["f"]["state"], got["f"]["attempts"], got["f"]["error_message"]) == ("pending", 0, None)
    assert got["d"]["state"] == "indexed" and got["d"]["updated_at"].month == 1 and len(got) == 4
    claimed = M.claim(jobs.withColumn("created_at", F.col("updated_at")), 5).collect()
    assert [(r["id"], r["state"], r["attempts"]) for r in claimed] == [("p", "processing", 1)]
    changes = spark.createDataFrame([("A", "missing")], "id string, change string")
    assert {r["id"]: r["state"] for r in M.cancel_for_missing(jobs, changes).collect()} == {"p": "cancelled", "r": "cancelled", "f": "failed", "d": "indexed"}


def test_stored_tables_replace_only_what_is_new(spark, tmp_path):
    at = f"{tmp_path}/types"
    first = spark.createDataFrame([("a", "x"), ("b", "y")], "asset_id string, document_type string")
    M.merge_save(spark, first, at, ["asset_id"], n=4)
    M.merge_save(spark, spark.createDataFrame([("b", "z"), ("c", "w")], first.schema), at, ["asset_id"], n=4)
    assert {tuple(r) for r in spark.read.parquet(at).select("asset_id", "document_type").collect()} == {("a", "x"), ("b", "z"), ("c", "w")}


def test_reset_needs_a_library_and_a_confirmation(spark, tmp_path):
    root = str(tmp_path)
    spark.range(3).write.parquet(f"{root}/chunks")
    with pytest.raises(ValueError):
        M.reset(spark, root, ("chunks",), root)
    (tmp_path / "manifest.json").write_text("{}")
    with pytest.raises(ValueError):
        M.reset(spark, root, ("chunks",), "yes")
    assert M.reset(spark, root, ("chunks", "none", "../x"), root) == ["chunks"] and not (tmp_path / "chunks").exists()


def test_medians_and_z_per_group_equal_numpy(spark):
    import numpy as np

    from quillspark.operators import similarity as V

    rng = np.random.default_rng(1)
    rows = [(g, float(x)) for g, n in (("a", 1), ("b", 2), ("c", 501), ("d", 1000)) for x in rng.choice([rng.normal(size=n), rng.normal(size=n) * 100], axis=0)] + [("c", 0.0), ("c", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["m"] for r in V.exact_median(df, ["g"], "v", "m").collect()}
    for g in "abcd":
        own = [v for k, v in rows if k == g and v is not None and v == v]
        assert got[g] == pytest.approx(np.median(own), abs=1e-12)


def test_cosine_blocks_equal_a_loop(spark, monkeypatch):
    import numpy as np

    from quillspark.operators import similarity as V

    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    rows = [(f"v{k:02}", [float(x) for x in rng.normal(size=5)]) for k in range(30)] + [("zero", [0.0] * 5), ("short", [1.0]), ("none", None), ("twin", None)]
    rows[-1] = ("twin", rows[3][1])
    v = spark.createDataFrame(rows, "id string, e array<double>")
    q = spark.createDataFrame([(k, rows[k][1]) for k in range(8)] + [(99, [1.0])], "query_id long, q array<double>")
    got = {(r["query_id"], r["id"]): r["rank"] for r in V.top_by_cosine(v, "id", "e", q, 4).collect()}
    unit = {i: np.array(e) / np.linalg.norm(e) for i, e in rows if e and len(e) == 5 and any(e)}
    for k in range(8):
        score = {i: 0.0 for i, _ in rows} | {i: round(float(unit[rows[k][0]] @ u), 6) for i, u in unit.items()}
        want = sorted(score, key=lambda i: (-score[i], i))[:4]
        assert sorted((i for (n, i) in got if n == k), key=lambda i: got[k, i]) == want
    assert got[99, "short"] == 1 and V.cosine_scores(v, "id", "e", q.where("false")).count() == 0
    assert V.cosine_scores(v, "id", "e", q).count() == 9 * len(rows)
