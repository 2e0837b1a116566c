"""The registered queries: against their SQL, or against each other's counts."""

import duckdb
import pytest

from spanveil.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = c.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    want = [tuple(dict(zip(names, r, strict=True))[k] for k in columns) for r in rel.fetchall()]
    assert sorted(names) == columns and sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op3_decontaminate", "op11_conversation_repair", "op13_vector_codes"}))
def test_a_row_for_each_document(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() == df.select("doc_id").distinct().count() == 200
