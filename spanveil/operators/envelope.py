"""Anonymous envelopes: intent and query type by first match, placeholders per session, and back again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.operators.gate import word
from spanveil.operators.redact import lookup, number_values

# First match wins.
INTENTS = [
    (r"(?:review|analyze|check){B}.*{A}(?:contract|agreement|nda|license)", "contract_review"),
    (r"(?:nda|non-disclosure)", "nda_review"),
    (r"(?:license|licensing){B}.*{A}(?:agreement|review)", "license_review"),
    (r"(?:risk|compliance|audit){B}.*{A}(?:assess|review|check)", "risk_assessment"),
    (r"(?:gdpr|dsgvo|privacy){B}.*{A}(?:compliance|check|review)", "privacy_compliance"),
    (r"(?:ai\s?act|eu\s?ai)", "ai_act_review"),
    (r"(?:is|are|does|can|may){B}.*{A}(?:legal|lawful|enforceable|compliant)", "legal_question"),
    (r"(?:explain|what\s+is|define){B}.*{A}(?:law|regulation|article|section)", "legal_explanation"),
    (r"(?:draft|write|create){B}.*{A}(?:document|contract|policy)", "document_drafting"),
    (r"(?:summarize|summary|abstract)", "document_summary"),
    (r"(?:search|find|research){B}.*{A}(?:case|precedent|ruling)", "case_research"),
]
QUERY_TYPES = [
    (r"\?$", "question"),
    (word(r"(?:please|could you|can you)"), "request"),
    (word(r"(?:review|analyze|assess|check)"), "analysis"),
    (word(r"(?:draft|write|create|generate)"), "generation"),
    (word(r"(?:explain|define|what\s+is)"), "explanation"),
]
ABBREVIATIONS = {"name": "NAME", "email": "EMAIL", "phone": "PHONE", "address": "ADDR", "iban": "IBAN", "credit_card": "CC", "plz_city": "LOC", "date_of_birth": "DOB"}
# the two words of an intent may share the one character between them
_WORDS = r"[^\p{L}\p{M}\p{N}_]"
INTENT_PATTERNS = [(word(p.replace("{B}.*{A}", rf"(?:{_WORDS}|{_WORDS}.*{_WORDS})")), name) for p, name in INTENTS]


def _first(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    out = F
    for pattern, name in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(default)


def intent(text: Column) -> Column:
    return _first(F.lower(text), INTENT_PATTERNS, "general_query")


def query_type(text: Column) -> Column:
    return _first(F.trim(F.lower(text)), QUERY_TYPES, "statement")


def context_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda t: t != "")).cast("long")


def original_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def placeholders(findings: DataFrame, session: str, order: list[str]) -> DataFrame:
    """(session, pii_type, value, placeholder): ``[ANON_<type>_<n>]``, n from 1 per session and type."""
    short = lookup(ABBREVIATIONS, F.col("pii_type"), "")
    short = F.when(short == "", F.upper(F.substring("pii_type", 1, 4))).otherwise(short)
    numbered = number_values(findings, session, "pii_type", "value", order)
    return numbered.withColumn("placeholder", F.concat(F.lit("[ANON_"), short, F.lit("_"), (F.col("n") + 1).cast("string"), F.lit("]"))).drop("n")


def rehydrate(text: Column, mapping: Column) -> Column:
    """Placeholders back to values, longest placeholder first, so that none is part of another."""
    entries = F.array_sort(F.transform(F.map_entries(mapping), lambda x: F.struct((-F.length(x["key"])).alias("n"), x["key"].alias("k"), x["value"].alias("v"))))
    return F.aggregate(entries, text, lambda t, x: F.replace(t, x["k"], x["v"]))


def cloud_payload(df: DataFrame) -> DataFrame:
    """The envelope without what must stay: placeholders and the hash of the original."""
    return df.drop("placeholders", "original_hash")
