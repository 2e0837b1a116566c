"""Queries over the oversight operators; messages and events are made from the columns of tables, in both languages alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.operators import oversight as O
from spanveil.operators.routing import MARKERS, languages_for
from spanveil.plans.catalogue import ORACLES, query
from spanveil.plans.decisions import quoted
from spanveil.session import table

_MESSAGES = [
    "Please extract the key terms of this Agreement as JSON", "What a nice day", "Summarise the contract", "Convert the NDA, map its clauses", "return the fields",
    "Bitte den Vertrag strukturiert ausgeben", "an invoice: total 12", "Rechnung", "subcontractor output", "",
]


def _pick(values: list[str], n: str) -> str:
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


def _says(words: str, column: str) -> str:
    return rf"regexp_matches(lower({column}), '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(?:{words})(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])')"


_ASKED = f"({_says(O.CONTRACT_REQUEST, 'm')} AND {_says(O.STRUCTURED_OUTPUT, 'm')})"


@query(
    "q_human_review",
    f"""SELECT o_orderkey, {_ASKED} AS requires_human_review, CASE WHEN {_ASKED} THEN 'review_required' ELSE 'allow' END AS decision,
      CASE WHEN {_ASKED} AND s NOT IN ('high', 'critical') THEN 'high' ELSE s END AS severity,
      CASE WHEN {_ASKED} THEN CASE WHEN o_custkey % 2 = 0 THEN 'Menschliche Aufsicht ist für die Vertrags-JSON-Extraktion verpflichtend.' ELSE 'Human oversight enforced for contract JSON extraction.' END END AS warning
    FROM (SELECT o_orderkey, o_custkey, {_pick(_MESSAGES, 'o_orderkey')} AS m, {_pick(list(O.SEVERITIES), 'o_custkey')} AS s FROM orders)""",
)
def human_review(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.expr(_pick(_MESSAGES, "o_orderkey")).alias("m"), F.expr(_pick(list(O.SEVERITIES), "o_custkey")).alias("s"))
    verdict = O.with_human_review(F.col("m"), F.lit("allow"), F.col("s"), F.when(F.col("o_custkey") % 2 == 0, "de").otherwise("en"))
    return rows.select("o_orderkey", verdict.alias("v")).select("o_orderkey", "v.*")


@query(
    "q_template_route",
    f"""SELECT o_orderkey, CASE WHEN {_says(O.CONTRACT_HINT, 'm')} AND o_custkey % 3 > 0 THEN 'contract_clause_only' WHEN {_says(O.INVOICE_HINT, 'm')} AND o_custkey % 4 > 0 THEN 'invoice_numeric_aggregate' END AS template
    FROM (SELECT o_orderkey, o_custkey, {_pick(_MESSAGES, 'o_orderkey')} AS m FROM orders)""",
)
def template_route(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.expr(_pick(_MESSAGES, "o_orderkey")).alias("m"))
    return rows.select("o_orderkey", O.route_template(F.lit(""), F.col("m"), F.col("o_custkey") % 3, F.col("o_custkey") % 4).alias("template"))


@query("q_needs_simplification", f"SELECT conv_id, turn, complexity >= 0.4 AS needed, coalesce(turn % 3 = 0, false) AS wanted FROM ({ORACLES['q_complexity']})")
def needs(spark: SparkSession, sf: str) -> DataFrame:
    override = F.when(F.col("turn") % 3 == 0, F.lit(True)).when(F.col("turn") % 3 == 1, F.lit(False))
    return table(spark, sf, "conversations").select("conv_id", "turn", O.needs_simplification(F.col("text")).alias("needed"), O.should_simplify(F.lit(None).cast("boolean"), override).alias("wanted"))


_EVENTS = ["unauthorized_access", "credential_exposure", "query", "external_blocked", "view"]


@query(
    "q_immediate_breach",
    f"""SELECT event_id, 'critical' AS severity, CASE WHEN k = 'unauthorized_access' THEN 'Unauthorized data access detected: user=''' || user_id || ''', resource=''unknown'', reason=''missing RBAC'''
      ELSE 'Credential exposure detected: type=''token'', location=''unknown''' END AS description
    FROM (SELECT *, {_pick(_EVENTS, 'event_id')} AS k FROM events) WHERE k IN ('unauthorized_access', 'credential_exposure')""",
)
def immediate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("k", F.expr(_pick(_EVENTS, "event_id")))
    details = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"))
    return rows.select("event_id", O.immediate_breach(F.col("k")).alias("severity"), O.breach_description(F.col("k"), details).alias("description")).filter("severity is not null")


_SURFACES = ["chat_inline", "file_inline", "folder_batch"]


@query(
    "q_review_profile",
    f"""SELECT surface, severity, count(*) AS n, severity IN ('critical', 'high') OR (severity = 'medium' AND surface <> 'folder_batch') AS acts, severity = 'critical' AS blocks
    FROM (SELECT {_pick(_SURFACES, 'event_id')} AS surface, {_pick(list(O.SEVERITIES), 'user_id')} AS severity FROM events) GROUP BY 1, 2""",
)
def profiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.expr(_pick(_SURFACES, "event_id")).alias("surface"), F.expr(_pick(list(O.SEVERITIES), "user_id")).alias("severity"))
    return O.apply_profile(rows).groupBy("surface", "severity", "acts", "blocks").agg(F.count("*").alias("n")).select("surface", "severity", "n", "acts", "blocks")


@query(
    "q_entities",
    """WITH f AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 'email' ELSE 'phone' END AS t, 'v' || l_suppkey % 5 AS v FROM lineitem),
    d AS (SELECT l_orderkey, t, v, min(l_linenumber) AS first FROM f GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, t ORDER BY first, v) - 1 AS i FROM d)
    SELECT l_orderkey, t || '_' || i AS entity, '[' || upper(t) || ' ' || v || ']' AS placeholder FROM r""",
)
def entity_maps(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("l_partkey") % 2 == 0, "email").otherwise("phone")
    row = F.struct("l_linenumber", kind.alias("pii_type"), F.concat(F.lit("v"), (F.col("l_suppkey") % 5).cast("string")).alias("value"))
    docs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("findings"))
    made = O.entities(F.col("findings"), lambda t, v: F.concat(F.lit("["), F.upper(t), F.lit(" "), v, F.lit("]")))
    return docs.select("l_orderkey", F.explode(made).alias("entity", "placeholder"))


_CATEGORIES = [*O.SEMANTIC_TYPES, "weather"]
_TYPE = _pick([*O.SEMANTIC_TYPES.values(), ""], "l_partkey")


@query(
    "q_semantic_merge",
    f"""WITH RECURSIVE m AS (SELECT l_orderkey AS doc_id, l_linenumber AS chunk, (l_linenumber - 1) * 150 AS s, (l_linenumber - 1) * 150 + 200 AS e, {_TYPE} AS pii_type, l_quantity / 50 AS score
        FROM lineitem WHERE l_quantity > 30 AND l_partkey % {len(_CATEGORIES)} < {len(_CATEGORIES) - 1}
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, {_TYPE} DESC) = 1),
    f AS (SELECT o_orderkey AS doc_id, o_custkey % 900 AS s, o_custkey % 900 + 10 AS e FROM orders WHERE o_orderkey % 3 = 0),
    c AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = m.doc_id AND f.s < m.e AND m.s < f.e)),
    t AS (SELECT *, chunk AS last FROM c WHERE chunk = (SELECT min(chunk) FROM c b WHERE b.doc_id = c.doc_id)
      UNION ALL SELECT n.*, n.chunk FROM t JOIN c n ON n.doc_id = t.doc_id AND n.chunk = (SELECT min(b.chunk) FROM c b WHERE b.doc_id = t.doc_id AND b.s >= t.e))
    SELECT doc_id, pii_type, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e,
      CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.8 THEN 'medium' ELSE 'low' END AS confidence FROM t""",
)
def semantic_merge(spark: SparkSession, sf: str) -> DataFrame:
    s = ((F.col("l_linenumber") - 1) * 150).cast("long")
    matches = table(spark, sf, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk"), s.alias("s"), (s + 200).alias("e"), F.expr(_pick(_CATEGORIES, "l_partkey")).alias("category"), (F.col("l_quantity") / 50).alias("score"))
    at = F.col("o_custkey") % 900
    found = table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"), at.alias("s"), (at + 10).alias("e"))
    return O.merge_semantic(found, matches).drop("layer")


@query("q_tenant_keys", r"SELECT c_custkey, CASE WHEN k = '' THEN 'default' ELSE k END AS tenant FROM (SELECT c_custkey, substr(regexp_replace(CASE WHEN c_custkey % 7 = 0 THEN ' /?' ELSE c_name || '/' || c_mktsegment || '.' || repeat('ä-x_', CAST(c_custkey % 30 AS INT)) END, '[^\p{L}\p{N}_.-]', '', 'g'), 1, 80) AS k FROM customer)")
def tenant_keys(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 7 == 0, " /?").otherwise(F.concat("c_name", F.lit("/"), "c_mktsegment", F.lit("."), F.repeat(F.lit("ä-x_"), (F.col("c_custkey") % 30).cast("int"))))
    return table(spark, sf, "customer").select("c_custkey", O.tenant_key(raw).alias("tenant"))


def _marks(language: str) -> str:
    return f"len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+'), lambda w: w IN ({', '.join(map(quoted, MARKERS[language]))})))"


@query(
    "q_language_routing",
    f"""SELECT doc_id, array_to_string(CASE WHEN doc_id % 5 = 0 THEN ['en'] WHEN doc_id % 5 = 1 OR (d = 0 AND e = 0) THEN ['de', 'en'] WHEN e > d THEN ['en', 'de'] WHEN e = 0 THEN ['de'] ELSE ['de', 'en'] END, ',') AS languages
    FROM (SELECT doc_id, {_marks('de')} AS d, {_marks('en')} AS e FROM documents)""",
)
def language_routing(spark: SparkSession, sf: str) -> DataFrame:
    declared = F.when(F.col("doc_id") % 5 == 0, " EN_us").when(F.col("doc_id") % 5 == 1, "xx")
    return table(spark, sf, "documents").select("doc_id", F.array_join(languages_for(F.col("text"), declared), ",").alias("languages"))
