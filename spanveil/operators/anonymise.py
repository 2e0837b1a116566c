"""Generalisation, risk and quality of anonymised findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.operators.redact import lookup
from spanveil.rules.taxonomy import DIRECT, SPECIAL

# Fixed values.
REGIONS = {
    "0": "Sachsen/Thüringen",
    "1": "Berlin/Brandenburg",
    "2": "Hamburg/Schleswig-Holstein/Mecklenburg-Vorpommern",
    "3": "Niedersachsen/Bremen",
    "4": "Nordrhein-Westfalen (West)",
    "5": "Nordrhein-Westfalen (Süd)/Rheinland-Pfalz",
    "6": "Hessen/Saarland",
    "7": "Baden-Württemberg",
    "8": "Bayern (Süd)",
    "9": "Bayern (Nord)/Thüringen",
}


def generalise(kind: Column, value: Column) -> Column:
    """Year of birth, decade of age, region of a postcode; anything else is suppressed, special categories always."""
    year, number, digit = F.regexp_extract(value, r"(19|20)[0-9]{2}", 0), F.regexp_extract(value, "[0-9]+", 0), F.regexp_extract(value, "[0-9]", 0)
    low = (F.floor(F.try_to_number(F.when(F.length(number).between(1, 6), number), F.lit("999999")) / 10) * 10).cast("int")
    gone = F.concat(F.lit("["), F.upper(kind), F.lit("_REDACTED]"))
    return (
        F.when(kind.isin(*SPECIAL), gone)
        .when(kind == "date_of_birth", F.when(year != "", F.concat(F.lit("[YEAR:"), year, F.lit("]"))).otherwise("[DATE_REDACTED]"))
        .when(kind == "age", F.when(low.isNotNull(), F.concat(F.lit("[AGE:"), low.cast("string"), F.lit("-"), (low + 9).cast("string"), F.lit("]"))).otherwise("[AGE_REDACTED]"))
        .when(kind == "plz_city", F.when(digit != "", F.concat(F.lit("[REGION:"), lookup(REGIONS, digit, "Deutschland"), F.lit("]"))).otherwise("[LOCATION_REDACTED]"))
        .otherwise(gone)
    )


def assess(findings: DataFrame, key: str) -> DataFrame:
    """Per key: counts by group, risk, k-anonymity (null without quasi-identifiers) and quality."""
    kind = F.col("pii_type")
    direct, special = kind.isin(*DIRECT), kind.isin(*SPECIAL)
    quasi = ~direct & ~special
    out = findings.groupBy(key).agg(F.count_if(direct).alias("direct"), F.count_if(quasi).alias("quasi"), F.count_if(special).alias("special"), F.count_distinct(F.when(quasi, F.struct("pii_type", "value"))).alias("unique_quasi"))
    risk = F.when((F.col("direct") > 0) | (F.col("special") > 0), "high").when(F.col("quasi") >= 3, "medium").otherwise("low")
    k = F.when(F.col("unique_quasi") > 0, F.greatest(F.lit(1).cast("long"), F.floor(F.col("quasi") / F.col("unique_quasi"))))
    total = F.col("direct") + F.col("quasi") + F.col("special")
    return out.withColumns({"risk": risk, "k_anonymity": k, "quality": F.greatest(F.lit(0.0), 1 - 0.1 * total)}).drop("unique_quasi")


def quality_score(original: Column, residual: Column, special_left: Column) -> Column:
    rate = 1 - residual / F.greatest(original, F.lit(1))
    rate = F.when(special_left, rate * 0.5).otherwise(rate)
    return F.when(original == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate)))
