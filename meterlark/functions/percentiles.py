"""Percentiles that are exact at any number of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentile(column: str, share: float) -> Column:
    """The least value that ``share`` of the rows with a value don't exceed; one of the values.

    A group is held as counts of its distinct values, so memory grows with these, not with rows.
    """
    return F.expr(f"percentile_disc({share}D) WITHIN GROUP (ORDER BY {column})")
