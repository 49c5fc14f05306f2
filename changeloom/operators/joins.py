"""Joins in which nulls are equal to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """A join by columns of equal names in which nulls are equal to each other."""
    other = right.withColumnsRenamed({c: f"_of_{c}" for c in key})
    same = F.lit(True)
    for c in key:
        same &= left[c].eqNullSafe(other[f"_of_{c}"])
    return left.join(other, same, how).drop(*(f"_of_{c}" for c in key))
