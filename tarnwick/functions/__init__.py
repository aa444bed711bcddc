"""Scalar functions that Spark lacks, built of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row; inside a lambda a plain expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words of an array, joined by a blank."""

    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - F.lit(n))
        return F.when(F.size(w) >= n, F.transform(at, lambda i: F.concat_ws(" ", *[w[i + k] for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    return bound(words, runs)


def ascii_words(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
