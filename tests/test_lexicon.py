"""Phrases and lexicon packs."""

from pyspark.sql import functions as F

from spanveil.operators.lexicon import find_phrases, lexicon_findings, lexicon_table
from spanveil.rules.lexica import DE_DACH, EN_UK_IE, PACKS, Pack


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


def test_longest_first(spark):
    lexicon = spark.createDataFrame([("a b",), ("b c d",), ("d",), ("d e",), ("x",), ("",)], "t string").select("t", F.split(F.regexp_replace("t", "^$", ""), " ").alias("words")).filter("t <> ''")
    texts = ["a b c d e", "A-B a  B, x X", "d e d", "", None, "😀 x"]
    got = {}
    for r in find_phrases(docs(spark, texts), lexicon).collect():
        assert texts[r.doc_id][r.s : r.e] == r.value
        got.setdefault(r.doc_id, []).append((r.s, r.value, r.t))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(2, "b c d", "b c d")], 1: [(4, "a  B", "a b"), (10, "x", "x"), (12, "X", "x")], 2: [(0, "d e", "d e"), (4, "d", "d")], 5: [(2, "x", "x")]}


def test_empty_lexicon_and_texts(spark):
    none = lexicon_table(spark, PACKS).limit(0)
    assert find_phrases(docs(spark, ["herr x"]), none).count() == 0
    assert find_phrases(docs(spark, [None]).limit(0), lexicon_table(spark)).count() == 0


CASES = [
    ("Diagnose", [("health", "Diagnose", "low")]),  # a label by itself is none, but the term is one
    ("Telefon", []),
    ("Name: Herr Zabel", [("name", "Zabel", "medium")]),
    ("Herr Tiger", []),
    ("Herr Zabel" + " ~" * 30 + " Projekt", [("name", "Zabel", "low")]),
    ("mein Name ist Quirin Zabel", [("name", "Quirin Zabel", "medium")]),
    ("die Partei im Projekt", []),
    ("Therapie: Diagnose", [("health", "Diagnose", "medium")]),
    ("Therapie:" + " ~" * 30 + " Diagnose", [("health", "Diagnose", "low")]),
    ("die Variable heißt name", []),
]


def test_findings(spark):
    rows = lexicon_findings(docs(spark, [t for t, _ in CASES]), lexicon_table(spark, [DE_DACH])).collect()
    got = [sorted((r.category, r.value, r.confidence) for r in rows if r.doc_id == i) for i in range(len(CASES))]
    assert got == [want for _, want in CASES]


def test_packs(spark):
    assert len(PACKS) == 7 and {p.id for p in PACKS} >= {"de_dach", "pt_br"}
    own = Pack("own", ("xx",), "sensitive health: scurvy\nnegative: ship")
    assert own.terms() == [("sensitive", "health", "scurvy"), ("negative", "", "ship")]
    rows = lexicon_findings(docs(spark, ["the trade union member spoke", "scurvy at sea", "scurvy on a ship"]), lexicon_table(spark, [EN_UK_IE, own])).collect()
    assert sorted((r.doc_id, r.pack, r.value) for r in rows) == [(0, "en_uk_ie", "trade union"), (1, "own", "scurvy")]


def test_a_long_text(spark):
    rows = lexicon_findings(docs(spark, ["wort " * 50_000 + "gewerkschaft " * 2000]), lexicon_table(spark, [DE_DACH]))
    assert rows.count() == 2000


def test_texts_are_read_once(spark, tmp_path):
    texts = [" ".join(["~"] * 200 + ["Patient", "Herr Quirin Zabel", "mobile phone"] * k) for k in range(4)] + [" ".join(f"w{i}" for i in range(n)) + " Frau Zabel" for n in (126, 127, 128, 255, 256)]
    docs(spark, texts).write.parquet(f"{tmp_path}/texts")
    table = spark.read.parquet(f"{tmp_path}/texts")
    for found in (find_phrases(table, lexicon_table(spark), per=("pack", "kind")), lexicon_findings(table, lexicon_table(spark))):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
        assert found.count() and all(texts[r.doc_id][r.s : r.e] == r.value for r in found.collect())
