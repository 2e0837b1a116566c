"""Review states of findings, the facts gathered about solutions, audit queries and context selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finding_key(kind: Column, start: Column, end: Column, value: Column) -> Column:
    """``psf_`` and 12 digits of sha1(type|start|end|value)."""
    return F.concat(F.lit("psf_"), F.substring(F.sha1(F.concat_ws("|", F.lower(F.trim(kind)), start.cast("string"), end.cast("string"), F.trim(value))), 1, 12))


def review_state(findings: DataFrame, decisions: DataFrame, doc: str, key: str, decision: str) -> DataFrame:
    """Per document: how many findings are approved or overridden, and the status that follows. Other decisions don't count;
    of two about one finding an override does."""
    valid = decisions.filter(F.col(decision).isin("approved", "overridden")).groupBy(doc, key).agg(F.max(decision).alias(decision))
    joined = findings.select(doc, key).distinct().join(valid, [doc, key], "left")
    out = joined.groupBy(doc).agg(F.count("*").alias("finding_count"), F.count_if(F.col(decision) == "approved").alias("approved_count"), F.count_if(F.col(decision) == "overridden").alias("override_count"))
    done = F.col("approved_count") + F.col("override_count")
    status = F.when(done >= F.col("finding_count"), F.when(F.col("override_count") > 0, "approved_override").otherwise("approved")).when(done > 0, "partially_approved").otherwise("pending")
    return out.withColumns({"resolved_count": done, "status": status, "all_resolved": done >= F.col("finding_count")})


def fact_id(*parts: Column) -> Column:
    return F.concat(F.lit("pskg_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20))


def summarise_facts(facts: DataFrame) -> DataFrame:
    """Facts by issue and solution: how many, by status, last seen. Rows without either key don't count."""
    given = facts.withColumns({c: F.trim(c) for c in ("issue_key", "solution_key")}).filter((F.col("issue_key") != "") & (F.col("solution_key") != ""))
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    return given.groupBy("issue_key", "solution_key").agg(
        F.count("*").alias("facts"),
        F.count_if(status == "applied").alias("applied"),
        F.count_if(status == "low_confidence").alias("low_confidence"),
        F.count_if(~status.isin("applied", "low_confidence")).alias("not_applied"),
        F.max("created_at").alias("last_seen_at"),
    )


def audit_query(entries: DataFrame, last: int, **equal: str) -> DataFrame:
    """The newest entries that match, newest first."""
    for name, value in equal.items():
        entries = entries.filter(F.col(name) == value)
    return entries.orderBy(F.desc("ts"), F.desc("entry_id")).limit(last)


def within_budget(docs: DataFrame, session: str, order: list, size: str, budget: int) -> DataFrame:
    """The documents of each session that fit a running budget of characters, in order."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return docs.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def rollup(scans: DataFrame, key: str | None = None) -> DataFrame:
    """The report over scanned documents: complete only if none failed, allowed only if all may go."""
    grouped = scans.groupBy(key) if key else scans.groupBy()
    return grouped.agg(
        F.count("*").alias("documents"),
        F.sum(F.size("findings")).alias("findings"),
        F.count_if(F.col("scan_error").isNotNull()).alias("errors"),
        F.coalesce(F.bool_and(F.col("scan_error").isNull()), F.lit(True)).alias("scan_complete"),
        F.coalesce(F.bool_and("egress_allowed"), F.lit(True)).alias("all_allowed"),
    )
