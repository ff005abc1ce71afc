from pyspark.sql import functions as F

from quillspark.functions import text as X


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_tokens_fold_case_and_marks(spark):
    assert one(spark, X.tokens(F.col("t")), t="Café snake_case É́x  a-b") == ["cafe", "snake", "case", "ex", "a", "b"]
    assert one(spark, X.tokens(F.col("t")), t="") == []


def test_content_terms_order_stop_words_and_bytes(spark):
    assert one(spark, X.content_terms(F.col("t")), t="show my invoice of the garden garden") == ["invoice", "garden"]


def test_singular_forms(spark):
    for word, visual, tag in (("stories", "story", "story"), ("boxes", "box", "box"), ("classes", "class", "class"), ("bus", "bus", "bus"), ("glass", "glass", "glas"), ("cats", "cat", "cat")):
        assert one(spark, X.visual_singular(F.col("t")), t=word) == visual
        assert one(spark, X.tag_singular(F.col("t")), t=word) == tag


def test_keys_are_asymmetric_unless_strict(spark):
    assert one(spark, X.entity_key(F.col("t")), t="rcl-4821 x") == "RCL-4821X"
    assert one(spark, X.entity_key(F.col("t"), True), t="rcl-4821 x") == "RCL4821X"
    assert one(spark, X.query_key(F.col("t")), t="ab") is None


def test_currency_and_amount(spark):
    assert one(spark, X.currency(F.col("t")), t="Rs.") == "INR"
    assert one(spark, X.currency(F.col("t")), t="yen") is None
    assert one(spark, X.amount_value(F.col("t")), t="1,250.50") == 1250.5


def test_snippet_window(spark):
    body = "x" * 200 + " Kettle " + "y" * 600
    got = one(spark, X.snippet(F.col("t"), F.lit("none kettle")), t=body)
    assert got.startswith("…") and got.endswith("…") and "Kettle" in got and len(got) == 422
    assert one(spark, X.snippet(F.col("t"), F.lit("none")), t="short") == "short"


def test_merge_lines_first_reading_wins(spark):
    assert one(spark, X.merge_lines(F.col("a"), F.col("b")), a="Total 5\n--", b="TOTAL: 5\nMore") == "Total 5\nMore"
