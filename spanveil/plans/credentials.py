"""Secrets: one of every rule planted in front of the documents' texts, the texts as they are, and a table of the user's own."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.operators.credentials import find_credentials
from spanveil.plans.catalogue import query
from spanveil.rules.credentials import Rule, builtin_rules
from spanveil.session import table

PLANTED = [r for r in builtin_rules() if r.sample]
ROUNDS = range(6)
_CUT = re.compile(r"(<<|>>|\{[hdub]\d+\})")


def _pieces(sample: str) -> list[tuple[str, str, int, int]]:
    """(part of the sentence: before, secret or after; stream or literal; from; length) of a sample."""
    out, side, used = [], "before", dict.fromkeys("hdub", 0)
    for x in filter(None, _CUT.split(sample)):
        if x in ("<<", ">>"):
            side = "secret" if x == "<<" else "after"
        elif _CUT.fullmatch(x):
            kind, n = x[1], int(x[2:-1])
            out.append((side, kind, used[kind], n))
            used[kind] += n
        else:
            out.append((side, x, -1, 0))
    return out


def _seed(i: int) -> Column:
    return F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(i))), 256)


_PIECE = "array<struct<x:string,at:int,n:int>>"


def _samples(spark: SparkSession) -> DataFrame:
    """k and the pieces of the three sides of the sentence of each rule."""
    rows = [(k, *([(x, at, n) for part, x, at, n in _pieces(r.sample) if part == side] for side in ("before", "secret", "after"))) for k, r in enumerate(PLANTED)]
    return spark.createDataFrame(rows, f"k long, before {_PIECE}, secret {_PIECE}, after {_PIECE}")


def _said(pieces: Column) -> Column:
    streams = F.create_map(*(x for c in "hdub" for x in (F.lit(c), F.col(c))))
    return F.array_join(F.transform(pieces, lambda p: F.when(p["at"] < 0, p["x"]).otherwise(F.substring(streams[p["x"]], p["at"] + 1, p["n"]))), "")


def _sql_sentence(side: str) -> str:
    cases = []
    for k, r in enumerate(PLANTED):
        parts = [("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'") if at < 0 else f"substr({x}, {at + 1}, {n})" for part, x, at, n in _pieces(r.sample) if part == side]
        cases.append(f"WHEN {k} THEN {' || '.join(parts) or repr('')}")
    return f"CASE k {' '.join(cases)} END"


_SEEDS = [f"sha256(doc_id || ':{i}')" for i in ROUNDS]
_PLANTED_SQL = f"""
WITH a AS (SELECT doc_id, doc_id % {len(PLANTED)} AS k, {' || '.join(_SEEDS)} AS h, translate({' || '.join(f"substr(to_base64(from_hex({s})), 1, 43)" for s in _SEEDS)}, '+/', 'xy') AS b FROM documents),
c AS (SELECT doc_id, k, h, b, translate(h, 'abcdef', '012345') AS d, upper(translate(h, '0189', 'ghij')) AS u FROM a),
p AS (SELECT doc_id, k, 'Konfiguration: ' || {_sql_sentence('before')} AS before, {_sql_sentence('secret')} AS secret FROM c),
r AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{r.id}', {r.entropy}, {r.generic})" for k, r in enumerate(PLANTED))}) t(k, rule, low, guess))
SELECT doc_id, rule, CAST(length(before) AS BIGINT) AS s, CAST(length(before) + length(secret) AS BIGINT) AS e, secret
FROM p JOIN r USING (k) WHERE round(list_aggregate(string_split(secret, ''), 'entropy'), 9) >= low AND (NOT guess OR regexp_matches(secret, '[0-9]'))
"""


@query("q_credentials", _PLANTED_SQL)
def planted(spark: SparkSession, sf: str) -> DataFrame:
    """The secret of one rule, made of the document's id, in a sentence before each document's text: what the scan of the whole
    finds there."""
    docs = table(spark, sf, "documents").withColumn("k", F.col("doc_id") % len(PLANTED)).withColumn("h", F.concat(*map(_seed, ROUNDS)))
    docs = docs.withColumn("b", F.translate(F.concat(*(F.substring(F.base64(F.unhex(_seed(i))), 1, 43) for i in ROUNDS)), "+/", "xy"))
    docs = docs.withColumns({"d": F.translate("h", "abcdef", "012345"), "u": F.upper(F.translate("h", "0189", "ghij"))})
    docs = docs.join(F.broadcast(_samples(spark)), "k")
    lead = F.concat(F.lit("Konfiguration: "), *(_said(F.col(c)) for c in ("before", "secret", "after")), F.lit(" bitte nicht teilen\n"))
    docs = docs.select("doc_id", F.concat(lead, F.coalesce("text", F.lit(""))).alias("text"), F.length(lead).alias("n"))
    found = find_credentials(docs.select("doc_id", "text")).join(docs.select("doc_id", "n"), "doc_id").filter(F.col("s") < F.col("n"))
    return found.select("doc_id", "rule", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), F.col("value").alias("secret"))


_GUESS = next(r for r in builtin_rules() if r.id == "generic-api-key").regex.replace("'", "''")


@query(
    "q_credentials_documents",
    f"""
WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_GUESS}', 1)) AS secret FROM documents)
SELECT doc_id, 'generic-api-key' AS rule, secret, count(*) AS n FROM v
WHERE regexp_matches(secret, '[0-9]') AND NOT contains(secret, '://') AND list_aggregate(string_split(secret, ''), 'entropy') >= 3.5 GROUP BY ALL
""",
)
def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The secrets of the documents as they are, by all rules. The tables hold none but labelled hexadecimal tokens."""
    found = find_credentials(table(spark, sf, "documents"))
    return found.groupBy("doc_id", "rule", F.col("value").alias("secret")).agg(F.count("*").alias("n"))


#: A rule file's worth of rules that a user might add: words of the tables' own, so that they are found.
OWN = [
    Rule("ticket-code", r"\bT-[0-9]{4,}\b", ("t-",)),
    Rule("hex-token", r'token = "([0-9a-f]{40})"', ("token =",), 1, 3.0),
]


@query(
    "q_credentials_own_rules",
    """
WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, 'token = "([0-9a-f]{40})"', 1)) AS secret FROM documents)
SELECT doc_id, 'hex-token' AS rule, count(*) AS n FROM v WHERE list_aggregate(string_split(secret, ''), 'entropy') >= 3.0 GROUP BY 1
""",
)
def own_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A table of the user's rules in place of the built-in one."""
    return find_credentials(table(spark, sf, "documents"), OWN).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))
