"""Interval algebra over span tables: union, difference, overlap semi- and anti-join, all partitioned by document.

Spans are half-open [s, e). Two overlap if each starts before the other ends; spans that only touch do not overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_spans(spans: DataFrame, keys: Sequence[str], s: str = "s", e: str = "e", touching: bool = False) -> DataFrame:
    """(keys, s, e, n): maximal unions of overlapping spans; n spans each. One sort per key: gaps and islands."""
    before = Window.partitionBy(*keys).orderBy(F.col(s), F.col(e).desc()).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(F.col(s), F.col(e).desc()).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(e).over(before)
    new = reach.isNull() | ((F.col(s) > reach) if touching else (F.col(s) >= reach))
    marked = spans.withColumn("_new", new.cast("int")).withColumn("_island", F.sum("_new").over(upto))
    return marked.groupBy(*keys, "_island").agg(F.min(s).alias(s), F.max(e).alias(e), F.count("*").alias("n")).drop("_island")


def _overlap(keys: Sequence[str], s: str, e: str):
    cond = (F.col(f"a.{s}") < F.col(f"b.{e}")) & (F.col(f"b.{s}") < F.col(f"a.{e}"))
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return cond


def overlap_semi(spans: DataFrame, others: DataFrame, keys: Sequence[str], s: str = "s", e: str = "e") -> DataFrame:
    """The spans that overlap one of the others. The others are united first, so a key compares few intervals."""
    return spans.alias("a").join(union_spans(others, keys, s, e).alias("b"), _overlap(keys, s, e), "left_semi")


def overlap_anti(spans: DataFrame, others: DataFrame, keys: Sequence[str], s: str = "s", e: str = "e") -> DataFrame:
    """The spans that overlap none of the others."""
    return spans.alias("a").join(union_spans(others, keys, s, e).alias("b"), _overlap(keys, s, e), "left_anti")


def subtract_spans(spans: DataFrame, claims: DataFrame, keys: Sequence[str], s: str = "s", e: str = "e") -> DataFrame:
    """What the claims leave of each span: nothing, one piece or several; other columns are kept.

    A span row is numbered by its content so that equal rows stay apart.
    """
    held = union_spans(claims, keys, s, e).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(s).alias("_cs"), F.col(e).alias("_ce"))
    cond = (F.col(s) < F.col("_ce")) & (F.col("_cs") < F.col(e))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    rest = [c for c in spans.columns]
    counted = spans.groupBy(*rest).agg(F.count("*").alias("_copies"))
    joined = counted.join(held, cond, "left").groupBy(*rest, "_copies").agg(F.sort_array(F.collect_list(F.when(F.col("_cs").isNotNull(), F.struct("_cs", "_ce")))).alias("_claims"))
    starts = F.concat(F.array(F.col(s)), F.transform("_claims", lambda c: c["_ce"]))
    ends = F.concat(F.transform("_claims", lambda c: c["_cs"]), F.array(F.col(e)))
    pieces = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: p["a"] < p["b"])
    out = joined.withColumn("_piece", F.explode(pieces)).withColumns({s: F.col("_piece.a"), e: F.col("_piece.b")})
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*rest)
