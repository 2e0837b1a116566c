"""Human oversight: routing to templates, review policy and profiles, immediate breaches, semantic findings, stores of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanveil.operators.gate import word
from spanveil.operators.intervals import overlap_anti
from spanveil.operators.text import complexity

# The words that decide.
CONTRACT_HINT = r"contract|agreement|nda|msa|sow|clause|terms?|bedingungen|vertrag|vereinbarung"
INVOICE_HINT = r"invoice|rechnung|bill|total|amount due|vat|mwst|ust"
CONTRACT_REQUEST = r"contract|agreement|nda|msa|clause|term sheet|purchase order|statement of work|vertrag|vereinbarung|klausel|contrat|accord"
STRUCTURED_OUTPUT = r"json|schema|structured|fields?|keys?|extract|parse|convert|transform|map|output|return|extrahier|strukturiert|felder|schlüssel|extraire|structuré|champs?|clés?"
SEVERITIES = ("none", "low", "medium", "high", "critical")
SEMANTIC_TYPES = {
    "name": "name", "email": "email", "phone": "phone", "address": "address", "financial": "iban", "health": "health_data", "id_document": "id_card",
    "date_of_birth": "date_of_birth", "location": "address",
}
#: (profile, what happens to findings, severities acted on, severities that block)
PROFILES = [
    ("all", "review_all_detected_findings", ["critical", "high", "medium", "low"], ["critical"]),
    ("auto_not_recommended", "auto_apply_all_detected_redactions", ["critical", "high", "medium", "low"], ["critical"]),
    ("high_only", "review_high_confidence_only", ["critical", "high"], ["critical"]),
    ("high_and_medium_recommended", "review_high_and_medium", ["critical", "high", "medium"], ["critical"]),
]
DEFAULT_PROFILES = {"chat_inline": "high_and_medium_recommended", "file_inline": "high_and_medium_recommended", "folder_batch": "high_only"}


def _says(text: Column, words: str) -> Column:
    return F.coalesce(F.lower(text).rlike(word(words)), F.lit(False))


def needs_simplification(text: Column, threshold: float = 0.4) -> Column:
    return complexity(text) >= threshold


def should_simplify(setting: Column, override: Column) -> Column:
    """An override decides, else the user's setting, else not."""
    return F.coalesce(override, setting, F.lit(False))


def route_template(filename: Column, text: Column, clauses: Column, numbers: Column) -> Column:
    """A contract that has clauses, else an invoice that has amounts, else none (null)."""
    contract, invoice = (_says(filename, w) | _says(text, w) for w in (CONTRACT_HINT, INVOICE_HINT))
    return F.when(contract & (clauses > 0), "contract_clause_only").when(invoice & (numbers > 0), "invoice_numeric_aggregate")


def asks_for_contract_data(message: Column) -> Column:
    """A request to turn a contract into structured data."""
    return _says(message, CONTRACT_REQUEST) & _says(message, STRUCTURED_OUTPUT)


def with_human_review(message: Column, decision: Column, severity: Column, language: Column) -> Column:
    """``struct<requires_human_review, decision, severity, warning>``: requests for contract data always need a review of severity high or more."""
    asked = asks_for_contract_data(message)
    given = F.lower(F.trim(F.coalesce(severity, F.lit(""))))
    severe = F.when(given.isin("high", "critical"), given).otherwise("high")
    german = F.lower(F.trim(F.coalesce(language, F.lit("en")))) == "de"
    warning = F.when(german, "Menschliche Aufsicht ist für die Vertrags-JSON-Extraktion verpflichtend.").otherwise("Human oversight enforced for contract JSON extraction.")
    return F.struct(
        asked.alias("requires_human_review"), F.when(asked, "review_required").otherwise(decision).alias("decision"),
        F.when(asked, severe).otherwise(severity).alias("severity"), F.when(asked, warning).alias("warning"),
    )


def review_profiles(spark: SparkSession) -> DataFrame:
    """The profiles as a dimension table of fixed size, to be broadcast."""
    return spark.createDataFrame(PROFILES, "profile string, behaviour string, act_on array<string>, block_on array<string>")


def profile_for(surface: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in DEFAULT_PROFILES.items() for x in kv))[surface]


def apply_profile(findings: DataFrame, surface: str = "surface", severity: str = "severity") -> DataFrame:
    """``findings`` with profile, acts and blocks, by the default profile of their surface."""
    named = findings.withColumn("profile", profile_for(F.col(surface)))
    joined = named.join(F.broadcast(review_profiles(findings.sparkSession)), "profile", "left")
    acts, blocks = (F.coalesce(F.array_contains(c, F.col(severity)), F.lit(False)) for c in ("act_on", "block_on"))
    return joined.withColumns({"acts": acts, "blocks": blocks}).drop("act_on", "block_on", "behaviour")


def entities(findings: Column, placeholder) -> Column:
    """``map<type_i, placeholder>``: the distinct values of each type in their order; ``placeholder`` of (type, value)."""
    distinct = F.array_distinct(F.transform(findings, lambda f: F.struct(f["pii_type"].alias("pii_type"), f["value"].alias("value"))))

    def key(x: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(distinct, 1, i), lambda y: y["pii_type"] == x["pii_type"]))
        return F.struct(F.concat(x["pii_type"], F.lit("_"), before.cast("string")).alias("k"), placeholder(x["pii_type"], x["value"]).alias("v"))

    return F.map_from_entries(F.transform(distinct, key))


def semantic_confidence(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.8, "medium").otherwise("low")


def merge_semantic(findings: DataFrame, matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """The matches (key, chunk, s, e, category, score) that become findings: (key, pii_type, s, e, confidence, layer).

    A chunk that overlaps a finding is skipped, and so is one that overlaps a chunk taken before it: as chunks overlap only
    their neighbours, of a run of consecutive chunks every second is taken.
    """
    kind = F.create_map(*(F.lit(x) for kv in SEMANTIC_TYPES.items() for x in kv))[F.lower(F.trim("category"))]
    known = matches.withColumn("pii_type", kind).filter("pii_type is not null")
    best = known.groupBy(key, "chunk", "s", "e").agg(F.max_by(F.struct("pii_type", "score"), F.struct("score", "pii_type")).alias("m"))
    free = overlap_anti(best, findings.select(key, "s", "e"), [key])
    order = Window.partitionBy(key).orderBy("chunk")
    run = free.withColumn("run", F.col("chunk") - F.row_number().over(order))
    turn = F.row_number().over(Window.partitionBy(key, "run").orderBy("chunk"))
    taken = run.withColumn("turn", turn).filter("turn % 2 = 1")
    return taken.select(key, "m.pii_type", "s", "e", semantic_confidence(F.col("m.score")).alias("confidence"), F.lit(6).alias("layer"))


def immediate_breach(event: Column) -> Column:
    """The severity of events that are a breach by themselves; null for those that are counted."""
    return F.when(event.isin("unauthorized_access", "credential_exposure"), "critical")


def breach_description(event: Column, details: Column) -> Column:
    """What an immediate breach says; ``details`` is a map of strings."""
    say = lambda k, default: F.coalesce(details[k], F.lit(default))
    access = F.concat(F.lit("Unauthorized data access detected: user='"), say("user_id", "unknown"), F.lit("', resource='"), say("resource", "unknown"), F.lit("', reason='"), say("reason", "missing RBAC"), F.lit("'"))
    leak = F.concat(F.lit("Credential exposure detected: type='"), say("credential_type", "token"), F.lit("', location='"), say("location", "unknown"), F.lit("'"))
    return F.when(event == "unauthorized_access", access).when(event == "credential_exposure", leak)


def visible_rows(rows: DataFrame, user: str, include_deleted: bool = False, by: str = "uploaded_by", deleted: str = "deleted_at", at: str = "uploaded_at") -> DataFrame:
    """The rows of a document store that a user uploaded, the latest first; without deleted ones unless asked for. No user, no rows."""
    mine = rows.filter((F.trim(F.col(by)) == user.strip()) & F.lit(bool(user.strip())))
    return (mine if include_deleted else mine.filter(F.coalesce(F.trim(F.col(deleted)), F.lit("")) == "")).orderBy(F.trim(F.col(at)).desc())


def expired_rows(rows: DataFrame, now: Column, hours: float, at: str = "uploaded_at") -> DataFrame:
    """The temporary rows that have outlived their time."""
    return rows.filter(F.col(at).cast("timestamp") < now - F.make_dt_interval(hours=F.lit(int(hours)), mins=F.lit(int(hours * 60) % 60)))


def tenant_key(tenant: Column) -> Column:
    """A tenant's name as it may be part of a path: letters, digits, hyphen, underscore and point, at most 80 characters."""
    clean = F.substring(F.regexp_replace(F.coalesce(tenant, F.lit("")), r"[^\p{L}\p{N}_.-]", ""), 1, 80)
    return F.when(clean == "", "default").otherwise(clean)


def write_facts(facts: DataFrame, path: str, tenant: str = "tenant_id") -> None:
    """Appends facts as JSON lines, a folder for each tenant."""
    facts.withColumn(tenant, tenant_key(F.col(tenant))).write.mode("append").partitionBy(tenant).json(path)


def read_facts(spark: SparkSession, path: str, schema: str, tenant: str | None = None) -> DataFrame:
    """The facts of a tenant or of all; the folder names prune what is read."""
    facts = spark.read.schema(schema).json(path)
    return facts if tenant is None else facts.filter(F.col("tenant_id") == tenant_key(F.lit(tenant)))


def release_records(releases: DataFrame, now: Column) -> DataFrame:
    """The audit lines of releases (tenant_id, details as a struct), to be appended before anything is released."""
    return releases.select(
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit("art9_release").alias("event"), F.lit(True).alias("success"),
        F.nullif(F.col("tenant_id"), F.lit("")).alias("tenant_id"), "details",
    )
