from pyspark.sql import functions as F

from spanveil.enforcement import main, require_privacy_check
from spanveil.operators.icd import find_terms, read_index
from spanveil.operators.person import person_ages, person_sentences, sentences, special_categories
from spanveil.rules.pack import pack_spans

import pytest


def read(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.x for r in df.select("i", f(F.col("text")).alias("x")).orderBy("i").collect()]


def test_sentences(spark):
    texts = ["Herr Dahl fehlt. Ursache: Hepatitis. Das Netz ist z.B. Stabil. Wer? „Sie!“ (Ja.) nein", "Eins!\n\n \n Zwei.\nDrei. vier", " \n\n ", "", None, "Ein Gen-Art. Test. Dr.\nVogt 😀. Ende"]
    got = [[(x.s, x.e, x.text) for x in r] for r in read(spark, texts, sentences)]
    assert all(t[s:e] == v for t, r in zip(texts, got, strict=True) for s, e, v in r)
    assert [[v for _, _, v in r] for r in got] == [
        ["Herr Dahl fehlt.", "Ursache: Hepatitis.", "Das Netz ist z.B. Stabil.", "Wer?", "„Sie!“ (Ja.) nein"], ["Eins!", "Zwei.", "Drei. vier"], [], [], [],
        ["Ein Gen-Art. Test.", "Dr.", "Vogt 😀.", "Ende"],
    ]


@pytest.mark.parametrize("name", ["person", "record"])
def test_who_a_sentence_is_about(spark, name):
    cases = {
        "person": [
            ("Herr Dahl fehlt. Ursache: Hepatitis. Die Grippe geht um und alle sind im Haus krank geworden.", [True, True, False]),
            ("Sie nicht heute bei uns. Sie kommt morgen wieder zu uns ins Haus. Mein Vater dankt.", [False, True, True]),
            ("Er läuft seit Jahren ohne jeden Fehler und Halt. The pump is old.", [False, False]),
            ("Der neue Kunde zahlt. Die Kunden zahlen immer und überall sehr gern.", [True, False]),
            ("Siehe F32.1 im Blatt. Nichts weiter steht in den Akten dieses langen Falles.", [True, False]),
        ],
        "record": [
            ("Attest\n\nEs besteht seit langer Zeit eine Erkrankung der Lunge.", [True, True]),
            ("Mitarbeiter: Alle Leute\n\nEs besteht seit langer Zeit eine Regel für das Haus.", [False, False]),
            ("Bewerberin: Frau Roth\n\nEs besteht seit langer Zeit eine Anfrage aus dem Haus.", [True, True]),
            ("Arztbrief-Software kaufen\n\nEs besteht seit langer Zeit eine Regel für das Haus.", [False, False]),
        ],
    }[name]
    got = [[x.person for x in r] for r in read(spark, [t for t, _ in cases], person_sentences)]
    assert got == [want for _, want in cases]


def test_names_given_count_as_persons(spark):
    df = spark.createDataFrame([("Hanna Roth kommt. Das Haus steht leer und still am See.", [(0, 10)])], "text string, names array<struct<start:int,end:int>>")
    assert [x.person for x in df.select(person_sentences(F.col("text"), F.col("names")).alias("x")).first().x] == [True, False]


def test_special_categories_and_ages(spark):
    texts = ["Frau Meier hat die Diagnose erhalten.", "Die Diagnose der Netzwerkstörung läuft.", "My religion is private.", "The election is over.", None, "", "I vote and my doctor knows."]
    assert read(spark, texts, special_categories) == [["health"], [], ["religious"], [], [], [], ["health", "political"]]
    texts = ["Die Anlage ist 15 Jahre alt.", "Ich bin 15 Jahre alt, er kam im Alter von 7.", None]
    assert [[x.value for x in r] for r in read(spark, texts, person_ages)] == [[], ["15 Jahre alt", "im Alter von 7"], []]


def test_many_sentences(spark):
    text = "Herr Dahl ist 40 Jahre alt. Das Netz steht seit 12 Jahren in allen Orten des Landes fest. " * 2000
    [got] = read(spark, [text], person_sentences)
    assert len(got) == 4000 and [x.person for x in got[:3]] == [True, False, True]
    assert len(read(spark, [text], person_ages)[0]) == 2000


def test_icd(spark, tmp_path):
    lines = ["1|2|3|E11|5|6|7|Diabetes mellitus (Typ 2)", "1|2|3|K75|5|6|7|Hepatitis", "1|2|3|M54|5|6|7|Rücken", "0|2|3|K75|5|6|7|Kolitis", "1|2|3|Z00|5|6|7|Gastritis"]
    (tmp_path / "icd.txt").write_text("\n".join(lines))
    index = read_index(spark, str(tmp_path / "icd.txt"))
    t = "Befund: Diabetes mellitus und Hepatitis, HIV; kein Rücken, keine Gastritis."
    got = find_terms(spark.createDataFrame([(1, t), (2, None), (3, "")], "doc_id long, text string"), index).collect()
    assert sorted((r.doc_id, t[r.start : r.end], r.term) for r in got) == [(1, "Diabetes mellitus", "Diabetes mellitus"), (1, "HIV", "HIV"), (1, "Hepatitis", "Hepatitis")]


def test_pack(spark):
    df = spark.createDataFrame([("SSN: 123-45-6789",), ("call 123-45-6789",), ("nino AB123456C",)], "text string")
    got = [sorted((x.rule, x.value) for x in r.x) for r in df.select(pack_spans(F.col("text"), ("us", "uk")).alias("x")).collect()]
    assert ("us_ssn_labelled", "123-45-6789") in got[0] and not any(r == "us_ssn_labelled" for r, _ in got[1]) and ("uk_nino", "AB123456C") in got[2]


def test_decorator_and_cli(spark, tmp_path, capsys):
    send = require_privacy_check("openai")(lambda df: df.count())
    assert send(spark.createDataFrame([("fine",)], "text string")) == 1
    with pytest.raises(PermissionError):
        send(spark.createDataFrame([("fine",), ("streng vertraulich",)], "text string"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("mail me at a@b.co")
    assert main(["scan", str(tmp_path / "in"), "--out", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).first().overlay == "mail me at [EMAIL]"
    (tmp_path / "in" / "b.txt").write_bytes(b"\0")
    assert main(["scan", str(tmp_path / "in")]) == 2
