"""The prompt-injection scan: which threats a text holds, whether it is blocked, and the text made harmless."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.spans import find_spans
from spanveil.operators.redact import merge_replacements, splice
from spanveil.rules.threats import BASE64, HOMOGLYPHS, INVISIBLE, SEVERITY, STRICTNESS, THREATS

_NONE = "array<struct<threat:string,severity:string,start:int,end:int,value:string,how:string>>"


def _rows(text: Column, pattern: str, threat: str, how: str) -> Column:
    row = lambda x: F.struct(F.lit(threat).alias("threat"), F.lit(SEVERITY[threat]).alias("severity"), x["s"].alias("start"), x["e"].alias("end"), x["value"].alias("value"), F.lit(how).alias("how"))
    # the search for places runs only where the pattern occurs at all
    return F.when(text.rlike(pattern), F.transform(find_spans(text, pattern), row)).otherwise(F.array().cast(_NONE))


def java(pattern: str) -> str:
    """Any case, Unicode-aware words and boundaries, as the patterns mean them."""
    return "(?iU)" + pattern


def threats(text: Column, strictness: str = "medium") -> Column:
    """All threats of a text in rule order; of equal spans the first rule's."""
    layers, invisible, homoglyphs = STRICTNESS[strictness]
    found = [_rows(text, java(p), t, how) for layer, t, p, how in THREATS if layer <= layers]
    decoded = F.decode(F.try_to_binary(F.regexp_extract(text, BASE64, 0), F.lit("base64")), "UTF-8")
    inner = [p for _, t, p, _ in THREATS if t in ("prompt_injection", "system_role_injection", "jailbreak")]
    hidden = F.when(text.rlike(BASE64) & F.length(F.regexp_extract(text, BASE64, 0)).__ge__(50), decoded.rlike(java("(?:" + "|".join(inner) + ")"))).otherwise(False)
    found.append(F.when(hidden, _rows(text, BASE64, "base64_payload", "strip")).otherwise(F.array().cast(_NONE)))
    if invisible:
        found.append(_rows(text, f"[{INVISIBLE}]+", "invisible_chars", "strip"))
    if homoglyphs:
        odd = "".join(HOMOGLYPHS)
        found.append(_rows(text, f"(?<=[A-Za-z])[{odd}]|[{odd}](?=[A-Za-z])", "homoglyph", "replace"))
    every = F.concat(*found)
    first = lambda x, i: ~F.exists(F.slice(every, 1, i), lambda y: (y["start"] == x["start"]) & (y["end"] == x["end"]))
    return F.filter(every, first)


def is_blocked(found: Column, block_high: bool = False) -> Column:
    bad = ["critical", "high"] if block_high else ["critical"]
    return F.exists(found, lambda x: x["severity"].isin(*bad))


def sanitise(text: Column, found: Column) -> Column:
    """Each threat made harmless as its own rule says: fenced by brackets, removed, or replaced by the letter it imitates."""
    plain = F.create_map(*(F.lit(x) for kv in HOMOGLYPHS.items() for x in kv))
    new = lambda x: F.when(x["how"] == "strip", "").when(x["how"] == "replace", F.try_element_at(plain, x["value"])).otherwise(F.concat(F.lit("[BLOCKED: "), x["threat"], F.lit("]")))
    return splice(text, merge_replacements(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), new(x).alias("new")))))


def scan_threats(df: DataFrame, text_col: str = "text", strictness: str = "medium", block_high: bool = False, once: bool = True) -> DataFrame:
    """``df`` with threats, blocked and sanitised. With ``once``, equal texts are scanned once: their hash is joined back."""
    if not once:
        out = df.withColumn("threats", threats(F.col(text_col), strictness))
        return out.withColumns({"blocked": is_blocked(F.col("threats"), block_high), "sanitised": sanitise(F.col(text_col), F.col("threats"))})
    keyed = df.withColumn("_h", F.sha2(F.col(text_col), 256))
    texts = keyed.filter(F.col(text_col).isNotNull()).select("_h", F.col(text_col).alias("_t")).dropDuplicates(["_h"])
    done = texts.withColumn("threats", threats(F.col("_t"), strictness))
    done = done.select("_h", "threats", is_blocked(F.col("threats"), block_high).alias("blocked"), sanitise(F.col("_t"), F.col("threats")).alias("sanitised"))
    return keyed.join(done, "_h", "left").drop("_h")
