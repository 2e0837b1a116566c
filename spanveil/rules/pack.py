"""A declarative rule pack: patterns by jurisdiction, some of which only count near a label, and the review profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.spans import find_spans

LABEL_WINDOW = 48
# Fixed values: (id, type, confidence, jurisdictions, pattern, labels near which alone it counts).
PACK = [
    ("email_basic", "email", "high", ("global",), r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", ()),
    ("phone_international", "phone", "high", ("global",), r"\b(?:\+?\d{1,3}[\s.-]?)?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}\b", ()),
    ("iban_eu", "iban", "high", ("eu", "uk"), r"\b[A-Z]{2}\d{2}[\sA-Z0-9]{10,30}\b", ()),
    ("payment_card_major", "credit_card", "high", ("global",), r"\b(?:4\d{3}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}|5[1-5]\d{2}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}|3[47]\d{2}[\s-]?\d{6}[\s-]?\d{5}|6(?:011|5\d{2})[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4})\b", ()),
    ("ipv4", "ip_address", "high", ("global",), r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", ()),
    ("de_steuer_id", "steuer_id", "medium", ("de", "at"), r"\b\d{2}\s?\d{3}\s?\d{3}\s?\d{3}\b", ()),
    ("de_svnr", "svnr", "high", ("de", "at"), r"\b\d{2}[A-Z]\d{6}[A-Z]\d{3}\b", ()),
    ("uk_nino", "id_card", "medium", ("uk",), r"\b[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]\b", ()),
    ("us_ssn_labelled", "id_card", "high", ("us",), r"\b\d{3}-\d{2}-\d{4}\b", ("ssn", "social security", "social security number")),
    ("ca_sin_labelled", "id_card", "high", ("ca",), r"\b\d{3}[ -]?\d{3}[ -]?\d{3}\b", ("sin", "social insurance", "social insurance number")),
    ("br_cpf", "id_card", "high", ("br",), r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", ("cpf", "cadastro de pessoas fisicas")),
    ("fr_insee", "id_card", "medium", ("fr",), r"\b[12]\d{2}(?:0[1-9]|1[0-2])(?:2[AB]|\d{2})\d{6}\d{2}\b", ("nir", "numero de securite sociale", "numero de sécurité sociale")),
    ("es_nif_nie", "id_card", "medium", ("es",), r"\b(?:\d{8}[A-Z]|[XYZ]\d{7}[A-Z])\b", ("dni", "nif", "nie", "documento nacional de identidad")),
]


def pack_spans(text: Column, jurisdictions: tuple[str, ...] = ()) -> Column:
    """``array<struct<rule, pii_type, confidence, s, e, value>>`` of the rules of the jurisdictions (all if none is named).

    A label alone is never found; a labelled rule counts only with one of its labels in the characters before it.
    """
    found = []
    for rule, kind, confidence, where, pattern, labels in PACK:
        if jurisdictions and not {"global", *jurisdictions} & set(where):
            continue
        spans = find_spans(text, f"(?iU){pattern}")
        if labels:
            near = "(?iU)\\b(?:" + "|".join(labels) + ")\\b"
            spans = F.filter(spans, lambda x: F.substring(text, F.greatest(x["s"] - LABEL_WINDOW, F.lit(0)) + 1, F.least(x["s"], F.lit(LABEL_WINDOW))).rlike(near))  # noqa: B023  called at once
        row = lambda x: F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("pii_type"), F.lit(confidence).alias("confidence"), x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value"))  # noqa: B023, E731
        found.append(F.transform(spans, row))
    return F.concat(*found)
