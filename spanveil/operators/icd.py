"""Terms of the alphabetical index of ICD-10-GM: the index as a table, and its terms in texts by n-gram join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.operators.lexicon import find_phrases

# Which entries of the index are terms.
CHAPTERS = "ABCDEFGHIJKLMNOPQRST"
ENDINGS = ("itis", "ose", "osis", "om", "oma", "ämie", "pathie", "algie", "plegie", "karzinom", "sarkom", "infarkt", "sklerose", "syndrom", "krankheit")
ACRONYMS = ("AIDS", "HIV", "ADHS", "COPD", "KHK", "PAVK", "FSME", "TBC", "PCOS")
TOKEN = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"
LONGEST = 4


def normal(token: Column) -> Column:
    """Lowered, one ending off words of more than five letters: the longest of en, em, er, es, e, n, s that fits."""
    low = F.lower(token)
    return F.when(F.length(low) > 5, F.regexp_replace(low, "(?:en|em|er|es|e|n|s)$", "")).otherwise(low)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(key, n): normalised terms of one to four words of a pipe-separated index file, and the acronyms."""
    fields = F.split(F.col("value"), r"\|")
    rows = spark.read.text(path).filter((F.size(fields) >= 8) & (fields[0] != "0") & F.contains(F.lit(CHAPTERS), F.substring(fields[3], 1, 1)) & (fields[3] != ""))
    term = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(fields[7], r"\[.*?\]|\(.*?\)", ""), r"\s+(?:a\.n\.k\.|o\.n\.A\.)", ""), r"\s+-\s+s\..*$", ""))
    terms = rows.select(term.alias("t"), F.regexp_extract_all(term, F.lit(TOKEN), F.lit(0)).alias("p")).filter(F.size("p").between(1, LONGEST) & (F.upper("t") != F.col("t")) & F.col("t").rlike(r"^\p{Lu}"))
    single = (F.size("p") == 1) & (F.length(F.col("p")[0]) >= 4) & F.lower(F.col("p")[0]).rlike("(?:" + "|".join(ENDINGS) + ")$")
    kept = terms.filter((F.size("p") > 1) | single).select(F.array_join(F.transform("p", normal), " ").alias("key"), F.size("p").alias("n"))
    more = spark.createDataFrame([(a.lower(), 1) for a in ACRONYMS], "key string, n int")
    return kept.unionByName(more).distinct()


def find_terms(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, term) of the terms of the index in the texts: the longest in words first, of equals the leftmost."""
    lexicon = index.select(F.split("key", " ").alias("words"))
    found = find_phrases(docs, lexicon, normal, id_col, text_col)
    return found.select(id_col, F.col("s").alias("start"), F.col("e").alias("end"), F.col("value").alias("term"))
