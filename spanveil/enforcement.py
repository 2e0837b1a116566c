"""Hooks around the gate: a sink that is told of decisions, a decorator that asks before it calls, and the command line."""

from __future__ import annotations

import argparse
import functools
import sys
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class EnforcementSink(Protocol):
    """Told of each batch of decisions; it can't change them. One that is configured but fails, fails loudly."""

    def record(self, decisions: DataFrame, batch: int) -> None: ...


def to_sink(decisions: DataFrame, sink: EnforcementSink):
    """A streaming query that hands every batch of decisions to the sink."""
    return decisions.writeStream.foreachBatch(sink.record)


def require_privacy_check(destination: str, mode: str = "standard") -> Callable:
    """Decorates a function of a DataFrame with ``text``: rows that the gate blocks make it raise PermissionError."""
    from spanveil.operators.gate import classify, decide
    from spanveil.operators.person import special_categories

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(df: DataFrame, *args, **kw):
            label = classify(F.col("text"), F.size(special_categories(F.col("text"))) > 0, F.lit(False))
            if not df.filter(~decide(label, F.lit(destination), F.lit(mode))).isEmpty():
                raise PermissionError(f"blocked for {destination}")
            return f(df, *args, **kw)

        return call

    return wrap


def main(args: list[str] | None = None) -> int:
    """``scan FOLDER [--out TABLE]``: 0 if everything may go, 2 if something is blocked, 1 on an error."""
    from spanveil.operators.gate import classify, decide
    from spanveil.operators.person import special_categories
    from spanveil.operators.redact import redact, residual
    from spanveil.operators.review import rollup
    from spanveil.operators.scan import scan_documents
    from spanveil.session import build_session
    from spanveil.sources.files import read_folder, write_overlays

    parser = argparse.ArgumentParser("spanveil")
    parser.add_argument("verb", choices=["scan"])
    parser.add_argument("target")
    parser.add_argument("--out")
    parser.add_argument("--destination", default="external_llm")
    parser.add_argument("--min-confidence", default="medium", choices=["low", "medium", "high"])
    a = parser.parse_args(args)
    try:
        spark: SparkSession = build_session()
        rows = scan_documents(read_folder(spark, a.target), min_confidence=a.min_confidence)
        rows = rows.withColumns({"overlay": redact(F.col("text"), F.col("findings")), "scan_error": F.coalesce("error", "scan_error")})
        label = classify(F.col("text"), F.size(special_categories(F.col("text"), F.filter("findings", lambda f: f["pii_type"] == "name"))) > 0, F.exists("findings", lambda f: (f["pii_type"] == "secret") & (f["confidence"] == "high")))
        rows = rows.withColumns({"residual": residual(F.col("overlay"), F.col("findings")), "classification": label})
        rows = rows.withColumn("egress_allowed", F.col("scan_error").isNull() & (F.col("residual") == 0) & decide(F.col("classification"), F.lit(a.destination), F.lit("standard")))
        # a scope that was chosen doesn't count against the files outside it
        report = rollup(rows.filter(F.coalesce(F.col("kind"), F.lit("")) != "filtered_chosen")).first()
        print(report.asDict())
        if a.out:
            write_overlays(rows.filter("scan_error is null"), a.out)
        return 0 if report["all_allowed"] and report["scan_complete"] else 2
    except Exception as e:  # noqa: BLE001  the exit code says that it failed
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
