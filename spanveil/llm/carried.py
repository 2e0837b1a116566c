"""Rows of a caller carried whole beside an operator's own columns, so that no name can clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(docs: DataFrame, without: str | None = None, **own: Column) -> DataFrame:
    """``row`` (the columns of ``docs`` as one struct, but for ``without``) and the operator's, computed from those of ``docs``."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != without] or [F.lit(True).alias("none")]
    return docs.select(F.struct(*rest).alias("row"), *(v.alias(k) for k, v in own.items()))


def unpack(packed: DataFrame) -> DataFrame:
    """The caller's rows as they were."""
    return packed.select("row.*")
