"""Expressions that are evaluated a single time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds ``value``, computed once a row however often it is used.

    The optimizer copies a projected expression into every filter and projection above it; it can't copy
    a generator's output.
    """
    return df.withColumn(name, F.explode(F.array(value)))
