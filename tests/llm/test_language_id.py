import zlib

import numpy as np
import regex
from pyspark.sql import functions as F

from spanveil.llm.language_id import Model, identify, train, words


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = train(docs, ~held)
    got = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(held).collect()
    assert len(got) > 200
    right = sum(r.lang_pred == r.lang for r in got)
    print(right, len(got))
    assert right / len(got) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "fr"), (4, "12 34 !", None), (5, "", "en"), (None, "le chien", None), (6, "xyzzy qqq", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("zz"))
    model = train(df, F.lit(True), sample=10)
    got = {r.doc_id: r for r in identify(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, None)] == ["en", "fr", "und", "und", "und", "fr"]
    assert identify(df.limit(0), model).collect() == []
    nothing = train(df, F.lit(False))
    assert {r.lang_pred for r in identify(df, nothing).collect()} == {"und"}
    assert zlib.crc32(b"1") % 4 in range(4)


def test_long_runs_are_read_whole():
    model = Model(["x", "y"], {}, {"a": 0, "b": 1}, np.array([[1, -1], [-1, 1]], np.float32))
    assert model.predict("a" * 200 + "b" * 700)[0] == "y" and model.predict("a" * 200 + "b" * 3000)[0] == "y"
    assert np.allclose(model.vector("a" * 1000 + "b" * 3000), [-0.5, 0.5])


def test_words_begin_with_a_letter_and_keep_marks():
    assert words("½ ② Ⅷ ٣ _ 7") == [] and words("हिन्दी x½y") == ["हिन्दी", "x", "y"] and words("Ça_va ÉTÉ") == ["ça", "va", "été"]
    assert all(regex.findall(r"\p{L}+", t.lower()) == words(t) for t in ("a1b_c-d", "Größe٣x", "日本 語"))
    model = Model(["x", "y"], {}, {"x": 0}, np.array([[1, -1]], np.float32))
    assert model.predict("½ ②́") == ("und", 0.0)


def test_words_met_once_and_repeated_rows(spark):
    once = [(1, "the cat", "en"), (2, "le chien", "fr")]
    schema = "doc_id long, text string, lang string"
    for rows in (once, once * 50):
        df = spark.createDataFrame(rows, schema)
        model = train(df, F.lit(True), sample=5)
        assert model.langs == ["en", "fr"]
        assert {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame(once, schema), model).collect()} == {1: "en", 2: "fr"}
    same = spark.createDataFrame([(7, f"word{i} text", "en") for i in range(50)], schema)
    assert len([w for w in train(same, F.lit(True), sample=5).grams if w == "wor"]) == 1
    assert train(same, F.lit(True), sample=5).words.keys() == {"text", "word"}
    assert train(spark.createDataFrame([(1, "12", "en")], schema), F.lit(True)).langs == []


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "the cat " * 100_000, "en"), (2, "le chien " * 100_000, "fr"), (3, "z" * 300_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in identify(df, train(df, F.lit(True))).collect()}
    assert got[1] == "en" and got[2] == "fr" and got[3] in ("en", "fr")
