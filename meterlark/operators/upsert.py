"""Upserts and comparisons of table versions as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _new_values(left: DataFrame, right: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in left.columns if c not in keys and c in right.columns]


def insert_absent(source: DataFrame, target: DataFrame, keys: tuple = ("event_id",), order: tuple = ("event_timestamp", "src_offset")) -> DataFrame:
    """Rows of ``source`` to append: the first of each key that ``target`` doesn't hold (first write wins)."""
    by = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    first = source.withColumn("_rn", F.row_number().over(by)).filter("_rn = 1").drop("_rn")
    return first.join(target.select(*keys), list(keys), "left_anti")


def last_write(source: DataFrame, target: DataFrame, keys: tuple, version: str, condition: Column | None = None) -> DataFrame:
    """The merged table, the larger ``version`` of a key winning and the target on ties.

    ``condition`` limits which source rows may replace or add anything.
    """
    fresh = source if condition is None else source.filter(condition)
    both = target.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    by = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), "_new")
    return both.withColumn("_rn", F.row_number().over(by)).filter("_rn = 1").drop("_rn", "_new")


def changed_rows(old: DataFrame, new: DataFrame, keys: tuple, values: tuple) -> DataFrame:
    """Keys in both versions with any value different: old_ and new_ columns."""
    before = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values])
    after = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values])
    differs = reduce(lambda a, b: a | b, [~F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}")) for v in values])
    return before.join(after, list(keys)).filter(differs)


def version_counts(versions: dict[str, DataFrame], condition: Column | None = None) -> DataFrame:
    """One row per named version: its number of rows."""
    parts = [
        (df if condition is None else df.filter(condition)).agg(F.count("*").alias("row_count")).select(F.lit(name).alias("version"), "row_count")
        for name, df in versions.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def mark(table: DataFrame, ids: DataFrame, key: str = "event_id", column: str = "marked") -> DataFrame:
    """Sets ``column`` where the key is among ``ids``."""
    named = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return table.join(named, key, "left").withColumn(column, F.coalesce("_hit", F.lit(False))).drop("_hit")
