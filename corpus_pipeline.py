"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and, but for the last, returns the columns of
documents. ``run`` writes what a stage returns as Parquet into the shared folder and reads it back for the next.

Columns other than those of documents are dropped, whatever their names. An empty table passes every stage as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.decontaminate import remove_contaminated
from spanveil.llm.jaccard_join import keep_first
from spanveil.llm.line_dedup import drop_lines
from spanveil.llm.quality_rules import reject
from spanveil.llm.queries import PIECES
from spanveil.llm.sentencepiece_codec import encode
from spanveil.session import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 9: documents that the rules or the perplexity band reject go; so do null, empty and very short texts, which fail the
    rules. Repeated rows share one verdict and all stay or go; a null id changes nothing."""
    return reject(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 5: lines of recurring templates go; the document stays, if need be with an empty text. A null text stays null; repeated
    rows are one text and keep their lines; a null id changes nothing."""
    return drop_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 6: one document of each group of near duplicates (five words, 0.8) stays, that of the smallest id; of repeated rows one.
    Null and empty texts are like nothing and stay. A row without an id stays if nothing with an id is like it."""
    return keep_first(docs, size=5, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 3: documents that hold a benchmark item go, repeated rows alike. Null and empty texts hold none and stay."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 8: the ids of each document: doc_id, ids, n_ids, round_trip for every row; null and empty texts have no ids."""
    return encode(docs, PIECES)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

#: Perplexity, template trees and encoding have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
