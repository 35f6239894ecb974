"""Declarative row rules, compiled to one array of the names of violated rules.

A rule is violated only where its condition is TRUE: a condition that is NULL passes, as in a CASE.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    violated: Column
    category: str = "rule"


def required(column: str, prefix: str = "missing_", category: str = "schema") -> Rule:
    return Rule(f"{prefix}{column}", F.col(column).isNull(), category)


def holds(name: str, condition: str, category: str = "business") -> Rule:
    """A rule in SQL text that must not be definitely false."""
    return Rule(f"failed_{name}", ~F.expr(condition), category)


def in_range(column: str, low: float, high: float) -> Rule:
    return Rule(f"invalid_range_{column}", (F.col(column) < low) | (F.col(column) > high), "value")


def one_of(column: str, values: Iterable) -> Rule:
    # A NULL among the values would make every comparison NULL, so it is left out.
    return Rule(f"invalid_enum_{column}", ~F.col(column).isin(*[v for v in values if v is not None]), "value")


def violations(rules: Iterable[Rule]) -> Column:
    """Names of the violated rules, in the rules' order."""
    parts = [F.when(rule.violated, F.lit(rule.name)) for rule in rules]
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def flag(df: DataFrame, rules: Iterable[Rule], column: str = "_quality_flags") -> DataFrame:
    return df.withColumn(column, violations(rules))


def split(df: DataFrame, column: str = "_quality_flags") -> tuple[DataFrame, DataFrame]:
    """(rows without, rows with violations)."""
    return df.filter(F.size(column) == 0), df.filter(F.size(column) > 0)
