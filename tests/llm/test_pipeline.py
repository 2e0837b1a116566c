from corpus_pipeline import COLUMNS, STAGES, run
from pyspark.sql import functions as F
from test_decontaminate import contaminated
from test_jaccard_join import brute as groups
from test_native import brute_lines
from test_quality_rules import brute_verdicts

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r.doc_id: r.text for r in docs.collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, SF)
        if name == "sentencepiece":
            assert sorted(r.doc_id for r in out.collect()) == sorted(seen) and out.filter("not round_trip").count() == 0
            break
        assert out.columns == COLUMNS
        rows = out.collect()
        got = {r.doc_id: r.text for r in rows}
        assert len(rows) == len(got) and all(r.n_chars == len(r.text) for r in rows)
        if name == "quality_rules":
            langs = {r.doc_id: r.lang for r in docs.collect()}
            assert set(got) == brute_verdicts([(i, t, langs[i]) for i, t in seen.items()])
        elif name == "line_dedup":
            assert got == {i: t for i, _, _, t in brute_lines(list(seen.items()))}
        elif name == "near_duplicates":
            assert set(got) == {i for i, (_, c) in groups(list(seen.items()), 5, 80).items() if i == c} and len(got) < len(seen)
        else:
            assert set(seen) - set(got) == {r.doc_id for r in contaminated(docs, bench).collect()}
        docs, seen = spark.createDataFrame(rows, docs.schema), got


def test_run(spark):
    out = run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_ids", "round_trip"] and out.count() > 50


def test_stages_on_odd_tables(spark):
    """Nulls, repeated rows, an empty table and columns with names that operators use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.filter("length(text) > 1500").limit(3)
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, None, "en", "s", None), (None, "few words", None, "s", 9)], docs.schema)
    odd = odd.unionByName(clean).unionByName(clean.limit(1))
    odd = odd.withColumns({c: F.lit(i) for i, c in enumerate(("k1", "k2", "_gone", "_th", "_q1", "_key", "_stay", "row", "id", "node", "gone", "at"))})
    n = odd.count()
    for name, stage in STAGES:
        out = stage(spark, odd, SF)
        rows = out.collect()
        if name == "quality_rules":
            assert all(r.text for r in rows)
        elif name == "near_duplicates":
            assert len(rows) == n - 1
        else:
            assert len(rows) == n
        assert name == "sentencepiece" or out.columns == COLUMNS
        assert stage(spark, odd.limit(0), SF).collect() == []
