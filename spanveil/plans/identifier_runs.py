"""IBANs and cards in any layout: one of each made of the document's id, before its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.operators.identifier_runs import identifier_spans
from spanveil.plans.catalogue import query
from spanveil.session import table

#: What stands between groups of four: nothing, signs, a line end once, or a line end between all, which is no number any more.
JOINS = ["", " ", " | ", "–", "\n", "\n"]
_SETS = "case doc_id % 6 " + " ".join(f"when {k} then {chr(39)}{j}{chr(39)}" if j != "\n" else f"when {k} then chr(10)" for k, j in enumerate(JOINS)) + " end"
_BODY = "lpad(cast((doc_id * 48271 + 11) % 1000000007 as varchar), 10, '0')"
_FOURS = "[substr({x}, 1 + 4 * i, 4) for i in range(cast(ceil(length({x}) / 4.0) as int))]"
_JOINED = "case when doc_id % 6 = 4 then array_to_string({f}[1:2], chr(10)) || ' ' || array_to_string({f}[3:], ' ') else list_reduce({f}, lambda x, y: x || sep || y) end"


@query(
    "q_identifier_runs",
    f"""
WITH n AS (SELECT doc_id, {_SETS} AS sep, '50010517' || {_BODY} AS bban, '43' || {_BODY} || '271' AS head FROM documents),
c AS (SELECT doc_id, sep, 'DE' || lpad(CAST(98 - CAST(bban || '131400' AS HUGEINT) % 97 AS VARCHAR), 2, '0') || bban AS iban,
  head || CAST((10 - list_sum(list_transform(range(15), lambda i: CASE WHEN i % 2 = 1 THEN CAST(head[i + 1] AS INT) ELSE (2 * CAST(head[i + 1] AS INT)) // 10 + (2 * CAST(head[i + 1] AS INT)) % 10 END)) % 10) % 10 AS VARCHAR) AS card FROM n),
f AS (SELECT doc_id, sep, {_FOURS.format(x='iban')} AS i, {_FOURS.format(x='card')} AS k FROM c),
t AS (SELECT doc_id, 'Konto: ' AS a, {_JOINED.format(f='i')} AS i, ' ü Karte: ' AS b, {_JOINED.format(f='k')} AS k FROM f)
SELECT doc_id, 'iban' AS kind, CAST(length(a) AS INT) AS s, CAST(length(a || i) AS INT) AS e FROM t WHERE doc_id % 6 < 5
UNION ALL SELECT doc_id, 'credit_card', CAST(length(a || i || b) AS INT), CAST(length(a || i || b || k) AS INT) FROM t WHERE doc_id % 6 < 5
""",
)
def planted(spark: SparkSession, sf: str) -> DataFrame:
    """What is found in the made-up part, all of each document being read."""
    key = F.col("doc_id").cast("long")
    body = F.lpad(((key * 48271 + 11) % 1_000_000_007).cast("string"), 10, "0")
    bban, head = F.concat(F.lit("50010517"), body), F.concat(F.lit("43"), body, F.lit("271"))
    rest = F.aggregate(F.split(F.concat(bban, F.lit("131400")), ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)
    iban = F.concat(F.lit("DE"), F.lpad((98 - rest).cast("string"), 2, "0"), bban)
    # the check digit is the one of ten that makes the whole right
    card = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(head, d.cast("string"))), lambda x: F.call_function("luhn_check", x)), F.lit(0))
    join = F.get(F.array(*map(F.lit, JOINS)), (key % len(JOINS)).cast("int"))

    def laid_out(x: Column) -> Column:
        fours = F.regexp_extract_all(x, F.lit("....|.+$"), F.lit(0))
        wrapped = F.concat(F.array_join(F.slice(fours, 1, 2), "\n"), F.lit(" "), F.array_join(F.slice(fours, F.lit(3), F.size(fours)), " "))
        return F.when(key % 6 == 4, wrapped).otherwise(F.call_function("array_join", fours, join))

    lead = F.concat(F.lit("Konto: "), laid_out(iban), F.lit(" ü Karte: "), laid_out(card), F.lit(" ü\n"))
    docs = table(spark, sf, "documents").select("doc_id", F.length(lead).alias("n"), F.concat(lead, F.coalesce("text", F.lit(""))).alias("text"))
    found = docs.select("doc_id", "n", F.explode(identifier_spans(F.col("text"))).alias("x"))
    return found.filter("x.e < n").select("doc_id", "x.kind", "x.s", "x.e")
