"""Timestamps from text, without errors on malformed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """Timestamp or NULL; an offset followed by a stray Z is repaired first."""
    return F.try_to_timestamp(F.regexp_replace(text.cast("string"), r"([+-]\d{2}:\d{2})Z$", "$1"))


def seconds(time: Column) -> Column:
    """Whole seconds since the epoch, rounded down."""
    return F.floor(F.unix_micros(time) / 1_000_000).cast("long")


def shown(time: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(time, pattern)
