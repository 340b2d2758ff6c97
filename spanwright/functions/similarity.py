"""Name similarity: a native part by tokens and a vectorised part by matching blocks."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' words, where a word also matches one that it begins or that begins it."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    met = lambda p, q: F.size(F.filter(p, lambda u: F.exists(q, lambda v: u.startswith(v) | v.startswith(u))))
    shared = F.least(met(x, y), met(y, x))
    return shared / (F.size(x) + F.size(y) - shared)


@F.pandas_udf(DoubleType())
def block_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, by longest matching blocks; null for a null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    return F.round(F.greatest(token_similarity(a, b), block_similarity(a, b)), 3)
