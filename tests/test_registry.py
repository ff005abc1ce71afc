from pyspark.sql import functions as F

from quillspark.operators import registry as R


def test_migration_fills_missing_columns(spark):
    old = spark.createDataFrame([("a", "f", "x.txt", "AB")], "id string, folder_id string, filename string, sha256 string")
    new = R.migrate(old, "assets")
    row = R.backfill_content(new).first()
    assert len(new.columns) == 16 and row["content_id"] == "ab" and row["status"] is None and dict(new.dtypes)["size_bytes"] == "bigint"
    chunks = spark.createDataFrame([("1", "a"), ("2", "gone")], "id string, asset_id string")
    assert [r["id"] for r in R.purge_orphans(R.migrate(chunks, "chunks"), new).collect()] == ["1"]


def test_settings(spark):
    s = R.set_settings(spark.createDataFrame([("a", "1")], "key string, value string"), {"a": "2", "b": "3"})
    assert R.setting(s, "a") == "2" and R.setting(s, "none", "d") == "d"
    log = spark.createDataFrame([("a", "1", 1), ("a", "2", 5)], "key string, value string, at int")
    assert R.newest_settings(log).first()["value"] == "2"


def test_profiles_and_catalogue(spark):
    p = spark.createDataFrame([("x", "text")], "id string, role string")
    assert sorted(r["id"] for r in R.register(p, spark.createDataFrame([("x", "other"), ("y", "text")], "id string, role string")).collect()) == ["x", "y"]
    assert R.catalogue(spark, ("fast",)).where("installed").count() == 1 and R.profile_id("m") == "m/v3"


def test_vector_codec_round_trip(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>").withColumn("b", R.encode_vector("v"))
    rows = R.decode_valid(df, "b", 2, "u").withColumn("d", R.decode_vector("b")).collect()
    assert [r["d"] for r in rows] == [[3.0, 4.0], [0.0, 0.0], None]
    assert [round(x, 6) for x in rows[0]["u"]] == [0.6, 0.8] and rows[1]["u"] is None and rows[2]["u"] is None


def test_prompt_bank_is_built_once_and_again_when_broken(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("cat", [1.0])], "label string, p array<double>")

    for _ in range(2):
        assert R.prompt_bank(spark, str(tmp_path), "1", build).count() == 1
    (next(p for p in (tmp_path / "version=1").iterdir() if p.name.endswith(".parquet"))).write_bytes(b"broken")
    assert R.prompt_bank(spark, str(tmp_path), "1", build).count() == 1 and len(calls) == 2


def test_evidence_and_provenance(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "asset_id string, evidence array<string>")
    assert {r["asset_id"]: r["evidence"] for r in R.from_evidence_json(R.with_evidence_json(df)).collect()} == {"a": ["x", "y"], "b": []}
    p = R.provenance(df.select("asset_id"), "analysis", "rules", "1").first()
    assert p["stage"] == "analysis" and p["source_kind"] is None and p["created_at"] is not None
