"""Queries over classification, envelopes, anonymisation, text measures, threats, reviews and breaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.operators import anonymise, envelope, review
from spanveil.operators import text as T
from spanveil.operators.gate import art9_keywords, classify, decide, for_log, is_external, word
from spanveil.operators.redact import CLAUSE_START, clauses
from spanveil.operators.threats import java, scan_threats
from spanveil.plans.catalogue import query
from spanveil.rules import gate as R
from spanveil.rules.simplify import LATIN, PASSIVE, PLAIN
from spanveil.rules.threats import THREATS
from spanveil.session import spread, table
from spanveil.streaming import breach


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def contains_sql(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), {quoted(w)})" for w in words) + ")"


_ART9_SQL = "(" + " OR ".join(f"regexp_matches(lower(text), {quoted(word(p))})" for ps in R.ART9.values() for p in ps) + ")"
_CLASS_SQL = f"""CASE WHEN text IS NULL OR text = '' THEN 'public' WHEN {contains_sql(R.SECRECY)} THEN 'berufsgeheimnis' WHEN {contains_sql(R.CONFIDENTIAL)} THEN 'confidential'
 WHEN {_ART9_SQL} THEN 'confidential' WHEN {contains_sql(R.FINANCE)} THEN 'internal' ELSE 'public' END"""


@query("q_classify", f"SELECT conv_id, turn, {_CLASS_SQL} AS classification, {_CLASS_SQL} NOT IN ('confidential', 'berufsgeheimnis') AS allowed FROM conversations")
def classified(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").withColumn("classification", classify(F.col("text"), F.size(art9_keywords(F.col("text"))) > 0, F.lit(False)))
    return rows.select("conv_id", "turn", "classification", decide(F.col("classification"), F.lit("openai"), F.lit("standard")).alias("allowed"))


@query("q_classify_documents", f"SELECT {_CLASS_SQL} AS classification, count(*) AS n FROM documents GROUP BY 1")
def classified_documents(spark: SparkSession, sf: str) -> DataFrame:
    label = classify(F.col("text"), F.size(art9_keywords(F.col("text"))) > 0, F.lit(False))
    return spread(table(spark, sf, "documents")).select(label.alias("classification")).groupBy("classification").agg(F.count("*").alias("n"))


_NAMES = {"signup": " Local-Only ", "error": "OpenAI", "click": "LM Studio", "view": "gemini", "purchase": "ollama"}


@query("q_destination", "SELECT event_id, event_type IN ('error', 'view') AS external FROM events")
def destination(spark: SparkSession, sf: str) -> DataFrame:
    name = F.create_map(*(F.lit(x) for kv in _NAMES.items() for x in kv))[F.col("event_type")]
    return table(spark, sf, "events").select("event_id", is_external(name).alias("external"))


def _case(rules, default: str, column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {quoted(p)}) THEN '{n}'" for p, n in rules) + f" ELSE '{default}' END"


@query("q_intent", f"SELECT conv_id, turn, {_case(envelope.INTENT_PATTERNS, 'general_query', 'lower(text)')} AS intent, {_case(envelope.QUERY_TYPES, 'statement', 'trim(lower(text))')} AS query_type FROM conversations")
def intents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", envelope.intent(F.col("text")).alias("intent"), envelope.query_type(F.col("text")).alias("query_type"))


@query("q_envelope", "SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS BIGINT) AS context_tokens, substr(sha256(text), 1, 16) AS original_hash FROM conversations WHERE text IS NOT NULL")
def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").filter("text is not null")
    return rows.select("conv_id", "turn", envelope.context_tokens(F.col("text")).alias("context_tokens"), envelope.original_hash(F.col("text")).alias("original_hash"))


@query("q_rehydrate", "SELECT conv_id, turn, replace(replace(text, 'the', 'THE-VALUE'), 'and', 'AND-VALUE') AS text FROM conversations")
def rehydrated(spark: SparkSession, sf: str) -> DataFrame:
    mapping = F.create_map(F.lit("[ANON_NAME_1]"), F.lit("THE-VALUE"), F.lit("[ANON_NAME_10]"), F.lit("AND-VALUE"))
    masked = F.replace(F.replace("text", F.lit("the"), F.lit("[ANON_NAME_1]")), F.lit("and"), F.lit("[ANON_NAME_10]"))
    return table(spark, sf, "conversations").select("conv_id", "turn", envelope.rehydrate(masked, mapping).alias("text"))


_REGION_SQL = "CASE substr(v, 1, 1) " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in anonymise.REGIONS.items()) + " END"


@query(
    "q_generalise",
    f"""WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'age' WHEN 1 THEN 'plz_city' WHEN 2 THEN 'date_of_birth' ELSE 'health_data' END AS pii_type,
      CASE c_custkey % 4 WHEN 0 THEN 'Alter ' || (c_custkey % 90) WHEN 1 THEN CAST(10000 + c_custkey * 37 % 90000 AS VARCHAR) || ' Ort' WHEN 2 THEN '01.02.' || (1940 + c_custkey % 70) ELSE 'flu' END AS v FROM customer)
    SELECT c_custkey, CASE pii_type WHEN 'age' THEN '[AGE:' || (c_custkey % 90 // 10 * 10) || '-' || (c_custkey % 90 // 10 * 10 + 9) || ']' WHEN 'plz_city' THEN '[REGION:' || {_REGION_SQL} || ']'
      WHEN 'date_of_birth' THEN '[YEAR:' || substr(v, 7) || ']' ELSE '[HEALTH_DATA_REDACTED]' END AS generalised FROM c""",
)
def generalised(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "age").when(k % 4 == 1, "plz_city").when(k % 4 == 2, "date_of_birth").otherwise("health_data")
    value = (
        F.when(k % 4 == 0, F.concat(F.lit("Alter "), (k % 90).cast("string"))).when(k % 4 == 1, F.concat((10000 + k * 37 % 90000).cast("string"), F.lit(" Ort"))).when(k % 4 == 2, F.concat(F.lit("01.02."), (1940 + k % 70).cast("string"))).otherwise("flu")
    )
    return table(spark, sf, "customer").select("c_custkey", anonymise.generalise(kind, value).alias("generalised"))


@query(
    "q_assess",
    """WITH f AS (SELECT o_custkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'email' WHEN '2-HIGH' THEN 'health_data' ELSE 'plz_city' END AS t, o_orderstatus AS v FROM orders),
    g AS (SELECT k, count(*) FILTER (t = 'email') AS direct, count(*) FILTER (t = 'plz_city') AS quasi, count(*) FILTER (t = 'health_data') AS special, count(DISTINCT v) FILTER (t = 'plz_city') AS u FROM f GROUP BY 1)
    SELECT k, direct, quasi, special, CASE WHEN direct > 0 OR special > 0 THEN 'high' WHEN quasi >= 3 THEN 'medium' ELSE 'low' END AS risk,
      CASE WHEN u > 0 THEN greatest(1, quasi // u) END AS k_anonymity, round(greatest(0.0::DOUBLE, 1 - 0.1::DOUBLE * (direct + quasi + special)), 6) AS quality FROM g""",
)
def assessed(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "email").when(p == "2-HIGH", "health_data").otherwise("plz_city")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), kind.alias("pii_type"), F.col("o_orderstatus").alias("value"))
    return anonymise.assess(rows, "k").withColumn("quality", F.round("quality", 6))


@query("q_quality_score", "SELECT doc_id, round(CASE WHEN n_chars % 11 = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, (1 - (n_chars % 7) / greatest(n_chars % 11, 1)) * CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 1.0 END)) END, 6)::DOUBLE AS score FROM documents")
def scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.round(anonymise.quality_score(F.col("n_chars") % 11, F.col("n_chars") % 7, F.col("doc_id") % 2 == 0), 6).alias("score"))


_RAW = "'order ' || o_orderkey || ' total ' || CASE WHEN o_orderkey % 2 = 0 THEN '1.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') ELSE '2,' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') END || ' and 12,50'"


@query("q_money_topk", "SELECT o_orderkey, list_sort([12.5, CASE WHEN o_orderkey % 2 = 0 THEN 1000 + o_orderkey % 1000 + (o_custkey % 100) / 100.0 ELSE 2000 + o_custkey % 1000 + (o_orderkey % 100) / 100.0 END], 'DESC')[1]::DOUBLE AS most, 2::BIGINT AS n FROM orders")
def money(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", T.amounts(F.expr(_RAW.replace("VARCHAR", "STRING"))).alias("values"))
    return rows.select("o_orderkey", F.element_at(T.largest(F.col("values")), 1).alias("most"), F.size("values").cast("long").alias("n"))


@query(
    "q_template_confidence",
    """SELECT o_orderkey, CAST(least(99, CASE WHEN o_orderkey % 3 = 0 THEN 50 + CASE WHEN o_custkey % 5 >= 3 THEN 35 WHEN o_custkey % 5 >= 1 THEN 20 ELSE 0 END + CASE WHEN o_totalprice > 150000 THEN 10 ELSE 0 END
      WHEN o_orderkey % 3 = 1 THEN 50 + CASE WHEN o_custkey % 12 >= 8 THEN 35 WHEN o_custkey % 12 >= 3 THEN 20 ELSE 0 END + 10 ELSE 0 END) AS DOUBLE) / 100 AS confidence FROM orders""",
)
def confidence(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    template = F.when(k % 3 == 0, "contract_clause_only").when(k % 3 == 1, "invoice_numeric_aggregate")
    return table(spark, sf, "orders").select("o_orderkey", T.template_confidence(F.lit(True), c % 5, F.lit(True), c % 12, F.col("o_totalprice") > 150000, F.lit(True), template).alias("confidence"))


_PLAIN_SQL = "text"
for _k, _v in PLAIN.items():
    _PLAIN_SQL = f"regexp_replace({_PLAIN_SQL}, {quoted(_k.replace('-', '[-]'))}, {quoted(_v)}, 'gi')"


@query("q_quick_simplify", f"SELECT conv_id, turn, {_PLAIN_SQL} AS text FROM conversations")
def simplified(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.quick_simplify(F.col("text")).alias("text"))


_TERMS = " + ".join(f"CAST(contains(lower(text), {quoted(k.lower())}) AS INT)" for k in PLAIN)
_LATIN = " + ".join(f"CAST(regexp_matches(lower(text), {quoted(word(p))}) AS INT)" for p in LATIN)


@query(
    "q_complexity",
    f"""WITH m AS (SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '[^\\s]'))) AS sentences,
      {_TERMS} AS terms, {_LATIN} AS latin, len(regexp_extract_all(lower(text), '(?:^|[^a-z0-9_]){PASSIVE}')) AS passive FROM conversations),
    n AS (SELECT *, CASE WHEN sentences > 0 THEN words / sentences ELSE 0 END AS mean FROM m)
    SELECT conv_id, turn, CASE WHEN words = 0 THEN 0.0 ELSE least(10, CASE WHEN mean > 30 THEN 3 WHEN mean > 20 THEN 2 WHEN mean > 15 THEN 1 ELSE 0 END + CASE WHEN terms > 5 THEN 3 WHEN terms > 2 THEN 2 WHEN terms > 0 THEN 1 ELSE 0 END
      + latin + CASE WHEN passive > 5 THEN 2 WHEN passive > 2 THEN 1 ELSE 0 END) / 10 END::DOUBLE AS complexity FROM n""",
)
def complexities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.complexity(F.col("text")).alias("complexity"))


_HITS = ", ".join(f"CAST({contains_sql(words)} AS DOUBLE) AS {name}" for name, words in T.LABELS)


@query(
    "q_features16",
    f"""SELECT doc_id, round(ln(1 + length(text)), 6) AS text_length_log, round(ln(1 + len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))), 6) AS token_count_log,
    round(length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')) / greatest(length(text), 1), 6) AS digit_ratio, round(length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / greatest(length(text), 1), 6) AS uppercase_ratio,
    CAST(0 AS DOUBLE) AS direct_identifier_count, CAST(0 AS DOUBLE) AS name_finding_count, CAST(0 AS DOUBLE) AS address_finding_count, CAST(0 AS DOUBLE) AS special_category_count, {_HITS} FROM documents""",
)
def features(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<struct<pii_type:string>>")
    cols = T.features(F.col("text"), none)
    return table(spark, sf, "documents").select("doc_id", *((F.round(c, 6) if name.endswith(("_log", "_ratio")) else c).alias(name) for name, c in cols.items()))


@query(
    "q_best_context",
    """WITH p AS (SELECT * FROM embeddings WHERE vec_id < 9), s AS (SELECT e.vec_id, p.vec_id AS context, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS sim FROM embeddings e, p WHERE e.vec_id >= 9)
    SELECT vec_id, round(max(sim), 5) AS similarity FROM s GROUP BY 1""",
)
def best_context(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest of nine fixed phrase vectors: a table of constant size, so it is broadcast."""
    rows = table(spark, sf, "embeddings")
    phrases = F.broadcast(rows.filter("vec_id < 9").agg(F.collect_list("embedding").alias("phrases")))
    best = F.array_max(F.transform("phrases", lambda p: T.cosine(F.col("embedding"), p)))
    return rows.filter("vec_id >= 9").join(phrases).select("vec_id", F.round(best, 5).alias("similarity"))


@query("q_log_redaction", "SELECT event_id, '[EMAIL] paid' AS line FROM events")
def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@mail.example.com paid"))
    return table(spark, sf, "events").select("event_id", for_log(line).alias("line"))


_ASCII = [(i, t, p) for i, (_, t, p, _) in enumerate(THREATS) if "(?=" not in p and "\\b" not in p]


@query("q_threat_rules", " UNION ALL ".join(f"SELECT {i} AS rule, '{t}' AS threat, count(*) AS n FROM (SELECT text AS x FROM conversations UNION ALL SELECT html FROM pages) WHERE regexp_matches(x, {quoted('(?i)' + p)})" for i, t, p in _ASCII))
def threat_rules(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "conversations").select(F.col("text").alias("x")).unionAll(table(spark, sf, "pages").select("html"))
    hits = [F.struct(F.lit(i).alias("rule"), F.lit(t).alias("threat"), F.col("x").rlike(java(p)).cast("long").alias("hit")) for i, t, p in _ASCII]
    rows = texts.select(F.explode(F.array(*hits)).alias("h")).select("h.*")
    return rows.groupBy("rule", "threat").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("n"))


@query("q_html_injection", r"SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<\s*(?:script|iframe|object|embed|form|input|style|link|meta|base)(?:[^\pL\pN_>][^>]*)?>')) AS BIGINT) AS n FROM pages")
def html(spark: SparkSession, sf: str) -> DataFrame:
    tag = r"(?i)<\s*(?:script|iframe|object|embed|form|input|style|link|meta|base)(?![\p{L}\p{N}_])[^>]*>"
    return table(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(tag), F.lit(0))).cast("long").alias("n"))


@query("q_threat_scan")
def threat_scan(spark: SparkSession, sf: str) -> DataFrame:
    out = scan_threats(spread(table(spark, sf, "conversations")), strictness="high")
    return out.select("conv_id", "turn", F.size("threats").cast("long").alias("n"), "blocked", "sanitised")


@query("q_security_dedupe", "SELECT doc_id, sha256(text) AS h, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents")
def dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return rows.join(rows.groupBy("h").agg(F.count("*").alias("copies")), "h").select("doc_id", "h", "copies")


_BLOCKS = "SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'"


@query("q_breach_window", f"SELECT a.event_id, count(*) AS n FROM ({_BLOCKS}) a JOIN ({_BLOCKS}) b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 300 SECOND GROUP BY 1")
def breach_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").filter("event_type = 'error'").select("event_id", "user_id", "ts")
    return breach.windowed_count(rows, "user_id", "ts", 300).select("event_id", "n")


@query("q_query_spike", "SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 60 SECOND GROUP BY 1")
def query_spike(spark: SparkSession, sf: str) -> DataFrame:
    return breach.windowed_count(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 60).select("event_id", "n")


#: Event types of the table as events of the detector, and limits that its events, minutes apart, reach.
_EVENTS = {"error": "local_only_external_blocked", "view": "query_spike", "purchase": "unauthorized_access", "click": "credential_exposure"}
_SPARSE = {"blocked": (14_400, 5), "query": (7_200, 4)}


@query(
    "q_breach_escalation",
    f"""
WITH RECURSIVE e AS (SELECT CAST(user_id % 3 AS VARCHAR) AS tenant, CASE event_type WHEN 'error' THEN 'blocked' WHEN 'view' THEN 'query' WHEN 'purchase' THEN 'unauthorized' WHEN 'click' THEN 'credential' END AS kind, epoch_us(ts) AS us FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant, kind ORDER BY us) AS i, CASE kind WHEN 'blocked' THEN {_SPARSE['blocked'][0]} ELSE {_SPARSE['query'][0]} END * CAST(1000000 AS BIGINT) AS w, CASE kind WHEN 'blocked' THEN {_SPARSE['blocked'][1]} ELSE {_SPARSE['query'][1]} END AS most FROM e WHERE kind IN ('blocked', 'query')),
f AS (SELECT tenant, kind, i, us, [us] AS held, 1 AS n FROM r WHERE i = 1
  UNION ALL SELECT tenant, kind, i, us, CASE WHEN len(h) >= most THEN [] ELSE h END, len(h) FROM (SELECT r.tenant, r.kind, r.i, r.us, r.most, list_append(list_filter(f.held, lambda t: t > r.us - r.w), r.us) AS h FROM f JOIN r ON r.tenant = f.tenant AND r.kind = f.kind AND r.i = f.i + 1)),
b AS (SELECT f.tenant, f.us, f.kind, 'high' AS severity, CAST(f.n AS BIGINT) AS count FROM f JOIN r USING (tenant, kind, i) WHERE f.n >= r.most UNION ALL SELECT tenant, us, kind, 'critical', CAST(1 AS BIGINT) FROM e WHERE kind IN ('unauthorized', 'credential'))
SELECT tenant, us, kind, severity, count, us + {breach.DEADLINE_HOURS} * 3600000000 AS deadline_us, strftime(make_timestamp(us), '%Y_%m') AS month FROM b
""",
)
def escalation(spark: SparkSession, sf: str) -> DataFrame:
    """Breaches of all kinds over all events, three tenants."""
    names = F.create_map(*(F.lit(x) for pair in _EVENTS.items() for x in pair))
    rows = table(spark, sf, "events").select((F.col("user_id") % 3).alias("tenant"), names[F.col("event_type")].alias("event"), "ts")
    found = breach.with_deadline(breach.breaches(rows, "tenant", "event", "ts", _SPARSE))
    return found.select("tenant", F.unix_micros("ts").alias("us"), "kind", "severity", "count", F.unix_micros("deadline").alias("deadline_us"), "month")


@query(
    "q_review_state",
    """WITH f AS (SELECT l_orderkey AS doc, l_linenumber AS k, CASE WHEN l_returnflag = 'R' THEN 'approved' WHEN l_returnflag = 'A' THEN 'overridden' ELSE 'open' END AS d FROM lineitem),
    h AS (SELECT doc, k, max(d) FILTER (d <> 'open') AS d FROM f GROUP BY 1, 2),
    g AS (SELECT doc, count(*) AS finding_count, count(*) FILTER (d = 'approved') AS approved_count, count(*) FILTER (d = 'overridden') AS override_count FROM h GROUP BY 1)
    SELECT doc, finding_count, approved_count, override_count, approved_count + override_count AS resolved_count, CASE WHEN approved_count + override_count >= finding_count THEN CASE WHEN override_count > 0 THEN 'approved_override' ELSE 'approved' END
      WHEN approved_count + override_count > 0 THEN 'partially_approved' ELSE 'pending' END AS status, approved_count + override_count >= finding_count AS all_resolved FROM g""",
)
def review_state(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("k"), F.when(flag == "R", "approved").when(flag == "A", "overridden").otherwise("open").alias("d"))
    return review.review_state(rows, rows, "doc", "k", "d")


@query(
    "q_kg_summary",
    """SELECT event_type AS issue_key, CAST(user_id % 7 AS VARCHAR) AS solution_key, count(*) AS facts, count(*) FILTER (event_id % 3 = 0) AS applied, count(*) FILTER (event_id % 3 = 1) AS low_confidence,
      count(*) FILTER (event_id % 3 = 2) AS not_applied, max(lpad(CAST(event_id AS VARCHAR), 12, '0')) AS last_seen_at FROM events GROUP BY 1, 2""",
)
def kg_summary(spark: SparkSession, sf: str) -> DataFrame:
    status = F.element_at(F.array(F.lit("applied"), F.lit("Low_Confidence "), F.lit("rejected")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf, "events").select(F.col("event_type").alias("issue_key"), (F.col("user_id") % 7).cast("string").alias("solution_key"), status.alias("status"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("created_at"))
    return review.summarise_facts(rows)


@query("q_finding_keys", "SELECT l_orderkey, l_linenumber, 'psf_' || substr(sha1(lower(l_returnflag) || '|' || l_partkey || '|' || l_suppkey || '|' || l_linestatus), 1, 12) AS key FROM lineitem")
def finding_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", review.finding_key(F.col("l_returnflag"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linestatus")).alias("key"))


@query("q_audit_query", "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("entry_id", F.col("event_id"))
    return review.audit_query(rows, 50, event_type="error").select("event_id", "event_type", "user_id")


@query("q_context_budget", "SELECT doc_id, used FROM (SELECT doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used FROM documents) WHERE used <= 20000")
def budget(spark: SparkSession, sf: str) -> DataFrame:
    return review.within_budget(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars", 20000).select("doc_id", "used")


@query(
    "q_clauses",
    f"""WITH m AS (SELECT doc_id, string_split_regex(text, {quoted(CLAUSE_START)}) AS g, regexp_extract_all(text, {quoted(CLAUSE_START)}) AS m FROM documents),
    s AS (SELECT doc_id, unnest(list_prepend(g[1], list_transform(range(len(m)), lambda i: m[i + 1] || g[i + 2]))) AS part FROM m)
    SELECT doc_id, count(*) AS n, CAST(sum(length(part)) AS BIGINT) AS chars FROM s WHERE regexp_matches(part, '[^\\s]') GROUP BY 1""",
)
def clause_rows(spark: SparkSession, sf: str) -> DataFrame:
    return clauses(table(spark, sf, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


@query("q_size_limits", "SELECT CASE WHEN text IS NULL THEN 'no text' WHEN length(text) > 5000 THEN 'text too long' ELSE 'ok' END AS outcome, count(*) AS n FROM documents GROUP BY 1")
def sizes(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("text").isNull(), "no text").when(F.length("text") > 5000, "text too long").otherwise("ok")
    return table(spark, sf, "documents").select(outcome.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("q_zones")
def zone_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.explode(T.zones(F.col("text"))).alias("z")).groupBy("z.zone").agg(F.count("*").alias("n"))


_EXCERPT = "trim(text)"
for _pattern, _new in T.CLEAN:
    _EXCERPT = f"regexp_replace({_EXCERPT}, {quoted(_pattern.replace('(?iu)', '(?i)'))}, {quoted(_new)}, 'g')"


@query("q_excerpt", f"SELECT doc_id, left({_EXCERPT}, 6000) AS excerpt FROM documents")
def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("q_rule_pack")
def rule_pack(spark: SparkSession, sf: str) -> DataFrame:
    from spanveil.rules.pack import pack_spans

    rows = spread(table(spark, sf, "documents")).select("doc_id", F.explode(pack_spans(F.col("text"))).alias("x"))
    return rows.groupBy("doc_id", "x.rule").agg(F.count("*").alias("n"))
