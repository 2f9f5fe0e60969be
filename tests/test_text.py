"""Corpus cleaning edge cases (FIXTURES.md section 3: P1-P13, U1)."""

from pyspark.sql import functions as F

from sentspark.functions import text as T
from sentspark.operators import text as TO


def _docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_break_nbsp_split_order(spark):
    df = _docs(spark, ["가나다. 라마바\n사", "A. B"])
    out = TO.broken_lines(df, "text", ["doc_id"]).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.line) for r in out] == [(0, "가나다."), (0, "라마바"), (0, "사"), (1, "A. B")]


def test_strip_unicode_whitespace(spark):
    df = spark.createDataFrame([("\u3000\u00a0 x\u0085",), ("\t a b  ",), ("  ",)], "s string")
    got = [r[0] for r in df.select(T.strip_ws("s")).collect()]
    assert got == ["x", "a b", ""]


def test_min_length_counts_code_points(spark):
    emoji = "\U0001F600" * 10
    df = spark.createDataFrame([("123456789",), ("1234567890",), (emoji,)], "s string")
    got = [r[0] for r in df.where(T.long_enough("s")).collect()]
    assert got == ["1234567890", emoji]


def test_length_before_whitelist_keeps_empty(spark):
    out = TO.clean_sentences(_docs(spark, ["!!!!!!!!!!"])).collect()
    assert [r.sentence for r in out] == [""]


def test_whitelist(spark):
    df = spark.createDataFrame([("a!b#é가ㄱ一\t€?«·»",)], "s string")
    assert df.select(T.char_filter("s")).first()[0] == "ab가一?«·"


def test_whitelist_boundaries(spark):
    # every printable ASCII char except ! # $ & survives; CJK/Hangul ranges kept
    ascii_ = "".join(chr(c) for c in range(0x20, 0x7F))
    expect = "".join(ch for ch in ascii_ if ch not in "!#$&")
    df = spark.createDataFrame([(ascii_,), ("一龥龦가힣힤〈》「",)], "s string")
    got = [r[0] for r in df.select(T.char_filter("s")).collect()]
    assert got == [expect, "一龥가힣〈》"]


def test_drop_null_keeps_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "sentence string")
    assert [r[0] for r in TO.drop_null(df).collect()] == [""]


def test_fill_null_and_norm_score(spark):
    df = spark.createDataFrame([(None, "b", None), ("a", "b", 5.0)], "s1 string, s2 string, score double")
    got = df.select(T.fill_null_text("s1"), T.fill_null_text("s2"), T.norm_score("score")).collect()
    assert [tuple(r) for r in got] == [(" ", "b", 0.0), ("a", "b", 1.0)]


def test_rename(spark):
    df = spark.createDataFrame([(1, "t", "old")], "x long, title string, sentence string")
    assert TO.rename_col(df, "x", "x").columns == df.columns
    out = TO.rename_col(df, "title", "sentence")
    assert out.columns == ["x", "sentence"]
    assert out.first()["sentence"] == "t"


def test_label_name_prefers_label_ids(spark):
    df = spark.createDataFrame([(1, 0, 1)], "id long, label int, label_ids int")
    out = TO.label_name(df)
    assert out.columns == ["id", "labels"] and out.first()["labels"] == 1
    df2 = spark.createDataFrame([(1, 7)], "id long, label int")
    assert TO.label_name(df2).first()["labels"] == 7


def test_preview_is_top_n_by_key(spark):
    df = spark.range(100).select(F.col("id").alias("k"))
    assert [r.k for r in TO.preview(df, ["k"], 5).collect()] == [0, 1, 2, 3, 4]


def test_clean_chain_has_no_shuffle_or_python(spark):
    df = _docs(spark, ["Hello world. Second sentence here"])
    plan = TO.clean_sentences(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan
