"""Text measures and rewrites: simplification, complexity, features, chunks, zones, excerpts, money and templates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.operators.gate import any_of, word
from spanveil.rules.simplify import LATIN, PASSIVE, PLAIN
from spanveil.rules.taxonomy import DIRECT, SPECIAL


def quick_simplify(text: Column) -> Column:
    """Jargon to plain words, in order, in any case, also inside words."""
    return reduce(lambda t, kv: F.regexp_replace(t, "(?iu)" + re.sub(r"([.()-])", r"\\\1", kv[0]), F.lit(kv[1])), PLAIN.items(), text)


def complexity(text: Column) -> Column:
    """0 (simple) to 1 by sentence length, jargon, Latin and passive voice."""
    low = F.lower(text)
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    sentences = F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != ""))
    mean = F.when(sentences > 0, words / sentences).otherwise(0.0)
    terms = reduce(lambda a, b: a + b, (F.contains(low, F.lit(t.lower())).cast("int") for t in PLAIN))
    passive = F.size(F.regexp_extract_all(low, F.lit(r"(?:^|[^a-z0-9_])" + PASSIVE), F.lit(0)))
    score = (
        F.when(mean > 30, 3).when(mean > 20, 2).when(mean > 15, 1).otherwise(0)
        + F.when(terms > 5, 3).when(terms > 2, 2).when(terms > 0, 1).otherwise(0)
        + sum((low.rlike(word(p)).cast("int") for p in LATIN), F.lit(0))
        + F.when(passive > 5, 2).when(passive > 2, 1).otherwise(0)
    )
    return F.when(words == 0, F.lit(0.0)).otherwise(F.least(F.lit(10), score) / 10)


def chunks(text: Column, size: int = 200, overlap: int = 50) -> Column:
    """``array<struct<chunk, start, text>>``: windows of ``size`` characters that share ``overlap``."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s, i: F.struct(i.alias("chunk"), s.alias("start"), F.trim(F.substring(text, s + 1, F.lit(size))).alias("text")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


# Words whose presence is a feature, in the order of the features.
LABELS = [
    ("name_label_hit", ("name", "full name", "vorname", "nachname", "nom", "nombre")),
    ("email_label_hit", ("email", "e-mail", "mail", "correo")),
    ("phone_label_hit", ("phone", "telefon", "mobile", "tel", "telefono")),
    ("address_label_hit", ("address", "adresse", "dirección", "endereço")),
    ("honorific_hit", ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "madame", "monsieur", "sr", "sra")),
    ("sensitive_lexicon_hit", ("health", "medical", "patient", "diagnosis", "religion", "political", "union", "biometric", "criminal", "genetic", "krankheit", "diagnose", "politique", "salud")),
    ("project_context_hit", ("project", "projekt", "product", "initiative", "codename", "code name")),
    ("internal_reference_hit", ("ticket", "jira", "asana", "linear", "internal", "confidential", "draft", "version")),
]


def features(text: Column, findings: Column) -> dict[str, Column]:
    """The sixteen features of a text and its findings, by name."""
    n = F.length(text)
    count = lambda kinds: F.size(F.filter(findings, lambda f: f["pii_type"].isin(*kinds))).cast("double")
    share = lambda p: F.length(F.regexp_replace(text, p, "")) / F.greatest(n, F.lit(1))
    low = F.lower(text)
    return {
        "text_length_log": F.log1p(n.cast("double")),
        "token_count_log": F.log1p(F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).cast("double")),
        "digit_ratio": share(r"[^\p{Nd}]"),
        "uppercase_ratio": share(r"[^\p{Lu}]"),
        "direct_identifier_count": count(sorted(DIRECT)),
        "name_finding_count": count(["name"]),
        "address_finding_count": count(["address", "plz_city"]),
        "special_category_count": count(sorted(SPECIAL)),
        **{name: any_of(low, words).cast("double") for name, words in LABELS},
    }


CLEAN = [
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[EMAIL]"),
    (r"\+?\d[\d\-\s().]{7,}\d", "[PHONE]"),
    (r"(?i)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "[IBAN]"),
    (r"\b\d{10,}\b", "[ID]"),
    (r"(?iu)\b(signed by|signature|executed by|signatory|unterschrift|unterzeichnet|signé par)\b[^\n]{0,160}", "[SIGNATURE REDACTED]"),
]


def excerpt(text: Column, most: int = 6000) -> Column:
    """A passage as it may enter a prompt."""
    return F.substring(reduce(lambda t, r: F.regexp_replace(t, r[0], F.lit(r[1])), CLEAN, F.trim(text)), 1, most)


MONEY = r"[0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]{2}"


def to_number(raw: Column) -> Column:
    """1.234,56 and 1,234.56 and 12,50: the last of the two marks is the decimal one."""
    comma, point = F.length(raw) - F.instr(F.reverse(raw), ","), F.length(raw) - F.instr(F.reverse(raw), ".")
    both = F.contains(raw, F.lit(",")) & F.contains(raw, F.lit("."))
    german = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    english = F.replace(raw, F.lit(","), F.lit(""))
    simple = F.replace(raw, F.lit(","), F.lit("."))
    return F.when(both, F.when(comma > point, german).otherwise(english)).otherwise(simple).try_cast("double")


def amounts(text: Column) -> Column:
    """The amounts of a text, at most 200; a payload bound of the overlay."""
    raw = F.slice(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])" + MONEY + r"(?![\p{L}\p{N}_])"), F.lit(0)), 1, 200)
    return F.filter(F.transform(raw, to_number), lambda v: v.isNotNull())


def largest(values: Column, k: int = 5) -> Column:
    return F.slice(F.sort_array(values, asc=False), 1, k)


def template_confidence(contract: Column, clauses: Column, invoice: Column, numbers: Column, long_text: Column, totals: Column, template: Column) -> Column:
    """How sure the routing to a template is: additive, at most 0.99."""
    by_contract = F.when(contract, 50).otherwise(0) + F.when(clauses >= 3, 35).when(clauses >= 1, 20).otherwise(0) + F.when(long_text, 10).otherwise(0)
    by_invoice = F.when(invoice, 50).otherwise(0) + F.when(numbers >= 8, 35).when(numbers >= 3, 20).otherwise(0) + F.when(totals, 10).otherwise(0)
    return F.least(F.lit(99), F.when(template == "contract_clause_only", by_contract).when(template == "invoice_numeric_aggregate", by_invoice).otherwise(0)) / 100


# What marks a signature near the end.
SIGNATURE = ("unterschrift", "signature", "signed", "gezeichnet", "mit freundlichen", "kind regards", "sincerely", "datum", "date:", "ort,", "place,")


def zones(text: Column) -> Column:
    """``array<struct<zone, from, to>>`` as shares of the page: header, body, perhaps signature, footer; under five lines all body."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    bottom = F.lower(F.array_join(F.slice(lines, F.floor(n * 0.7).cast("int") + 1, n), "\n"))
    head, foot = F.least(F.lit(0.15), 3 / n), F.greatest(F.lit(0.85), (n - 3) / n)
    sign = F.greatest(F.lit(0.75), (n - 6) / n)
    zone = lambda name, a, b: F.struct(F.lit(name).alias("zone"), a.alias("from"), b.alias("to"))
    start, end = F.lit(0.0), F.lit(1.0)
    plain = F.array(zone("header", start, head), zone("body", head, foot), zone("footer", foot, end))
    signed = F.array(zone("header", start, head), zone("body", head, sign), zone("signature", sign, foot), zone("footer", foot, end))
    return F.when(n < 5, F.array(zone("body", start, end))).when(any_of(bottom, SIGNATURE), signed).otherwise(plain)
