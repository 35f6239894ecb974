"""Connected components by alternating large-star and small-star rounds.

Every round is two shuffles over the links; labels never reach the driver. A hub's neighbours
are reduced by a partial minimum before the shuffle and the hub's row is joined back to them, so
AQE can split its join partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.llm.common import discard, materialise

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step on links (u, v) with u > v."""
    if large:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u != v").distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"),
        F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (u long, v long, in any direction, repeats allowed) to (node, component).

    component is the smallest node of its component. Nodes without links are absent; links to
    themselves and links with a null end are ignored. No links give an empty table.
    """
    start = links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialise(start, "links")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        then = materialise(_star(_star(now, True), False), "links")
        discard(now)
        now, before, state = then, state, _state(then)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
