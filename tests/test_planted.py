"""Queries against their SQL on texts that the driver's tables seldom hold."""

import duckdb
import pytest

from spanveil.plans.catalogue import ORACLES, QUERIES, load

load()


@pytest.fixture
def same_as_sql(spark, tmp_path):
    def check(name, table, ddl, rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        df = QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        got = [tuple(r) for r in df.select(*columns).collect()]
        c = duckdb.connect()
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        want = c.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
        assert want and sorted(got, key=repr) == sorted(want, key=repr)
        return got

    return check


def test_categories_of_the_case_alone(same_as_sql):
    # short sentences behind one about a person, and those of a record, are about a person too
    rows = [(k, t, "user", "Reha, hand on. The religion and the union of all stand in this long sentence.") for k in range(20) for t in (0, 1)]
    same_as_sql("q_art9", "conversations", "conv_id long, turn long, role string, text string", rows)


def test_addresses_with_one_character_between(same_as_sql):
    texts = ["1.2.3.4 5.6.7.8", "1.2.3.4, 5.6.7.8", "1.2.3.4\n5.6.7.8\n9.9.9.9\n", "a1.2.3.4.5.6.7.8", "1.2.3.256 256.1.2.3.4", None, "", "01.2.3.4é5.6.7.8"]
    got = same_as_sql("q_ipv4_counts", "documents", "doc_id long, text string", list(enumerate(texts)))
    assert dict(got)[0] == 1 and dict(got)[1] == 2


def test_names_of_the_layout_alone(same_as_sql):
    same_as_sql("q_line_names", "documents", "doc_id long, text string", [(i, t) for i in range(24) for t in ["Heute kam Ines Aumann und Frau Anna Thelen.\nLG\nJonas\n"]])


def test_sentences_cut_as_by_the_sql(same_as_sql):
    odd = ["Prof. Dr. Vogt kam. ", "Dr. \nVogt ", "ca. \n\nZwei ", "Ein Wort. Zwei ", "Drei.\x0bVier ", "\n \n", "\n\x0b\n", " ", "\ntrſ. Dr. ſtr. Ab ", "DİPL. Ab ", "ing... Ab ", "z.B.\tAb ", "Ja!\r\n\r\n„Nein“ ", "x.  (Ab) ", "-Nr. Ä "]
    texts = [None, "", " ", "\n\n", "   ", *odd, *(a + b for a in odd for b in odd), "".join(odd)]
    same_as_sql("q_sentences", "documents", "doc_id long, text string", list(enumerate(texts)))
