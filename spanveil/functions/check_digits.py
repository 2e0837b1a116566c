"""Check digits as native expressions over arrays of character values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.rules.identifiers import Scheme

_SIGNS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def values_of(value: Column) -> Column:
    """0 to 35 of each character of a string of digits and capital letters."""
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(_SIGNS), c) - 1)


def scheme_holds(value: Column, scheme: Scheme) -> Column:
    """Whether a string has the shape of the scheme and the right check digit; null has not."""
    body = F.substring(value, 1, scheme.length)
    numbers = values_of(body)
    if scheme.paired:  # a letter counts as two digits, its place in the alphabet
        numbers = F.flatten(F.transform(numbers, lambda v: F.when(v < 10, F.array(v)).otherwise(F.array(F.floor((v - 9) / 10).cast("int"), (v - 9) % 10))))
    weights = F.array(*(F.lit(w) for w in scheme.weights))
    products = F.transform(numbers, lambda v, i: v * F.get(weights, i % len(scheme.weights)))
    if scheme.crossed:
        products = F.transform(products, lambda p: F.floor(p / 10).cast("int") + p % 10)
    total = F.aggregate(products, F.lit(0), lambda a, p: a + p)
    check = F.substring(value, scheme.length + 1, 1)
    right = (total % 10) == check.try_cast("int")
    if scheme.optional:
        right = (check == "") | right
    return F.coalesce(value.rlike(f"^(?:{scheme.shape})\\z") & right, F.lit(False))


def iban_holds(value: Column) -> Column:
    """Whether a string, but for its white space, has the shape of an IBAN and the remainder 1 of 97."""
    v = F.upper(F.regexp_replace(value, r"\s", ""))
    turned = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))
    rest = F.aggregate(values_of(turned), F.lit(0), lambda a, x: (a * F.when(x < 10, 10).otherwise(100) + x) % 97)
    return F.coalesce(v.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z") & (rest == 1), F.lit(False))
