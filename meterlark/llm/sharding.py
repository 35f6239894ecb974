"""Sharding by sampled splitters: equal bytes per shard along a sampled key order.

Records are ordered by (hash of text, doc_id), so copies of a text are neighbours and a group is
only cut where a shard boundary falls inside it. A size-weighted sample of keys gives quantile
splitters; records are dealt to the ranges between them, a range that holds more than its share is
subdivided from a second sample of its own keys, and exact prefix sums over the ranges and inside
each range place every record. A shard is a sixteenth of the bytes, to within one record.

The driver only sees the sampled keys (bounded by ``SAMPLE``) and one total per range (bounded by
``RANGES`` and the subdivision).

Defined results: null text has size 1 (no bytes, plus one) and the checksum of the empty text;
repeated rows and null ids are placed like any other row; shards may stay empty when there are
fewer rows than shards or one record outweighs a shard; an empty table gives an empty table; extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlark.llm.common import materialise

#: Keys that a round of sampling sends to the driver, about.
SAMPLE = 16_384
#: Ranges of the first round.
RANGES = 512
#: A range with more rows than this, or over twice its share of bytes, is subdivided.
RANGE_ROWS = 200_000
ROUNDS = 6


class Splitters:
    """Sorted boundaries over (hash, id); range k holds the keys from boundary k-1 on, below k."""

    def __init__(self, keys: list[tuple[int, int]]):
        self.keys = sorted(set(keys))
        self.hashes = np.array([k[0] for k in self.keys], np.int64)
        self.ids = np.array([k[1] for k in self.keys], np.int64)

    def of(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.hashes, hashes, "left")
        high = np.searchsorted(self.hashes, hashes, "right")
        for at in np.unique(low[high > low]):
            own = np.flatnonzero((low == at) & (high > low))
            low[own] = at + np.searchsorted(self.ids[at : high[own[0]]], ids[own], "right")
        return low

    def column(self, hashed: Column, ident: Column) -> Column:
        @F.pandas_udf("int")
        def place(h: pd.Series, i: pd.Series) -> pd.Series:
            return pd.Series(self.of(h.to_numpy(np.int64), i.to_numpy(np.int64)).astype(np.int32))

        return place(hashed, ident)


def _sample(rows: DataFrame, weight: Column, salt: int) -> list:
    """Rows of (h, id, rng, weight) that a hash of their key draws with probability ``weight``."""
    draw = F.pmod(F.xxhash64("h", "id", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    return rows.filter(draw < weight).select("h", "id", "rng", F.greatest(weight, F.lit(1.0)).alias("w")).collect()


def splitters_for(rows: DataFrame, total: int) -> tuple[Splitters, list]:
    """Boundaries whose ranges hold near-equal bytes, and the ranges' totals.

    ``rows`` has h, id and size. Overfull ranges are cut again from samples of their own.
    """
    found = Splitters([])
    share = max(1.0, total / RANGES)
    totals: list = []
    for salt in range(ROUNDS):
        ranged = rows.withColumn("rng", found.column(F.col("h"), F.col("id")))
        totals = ranged.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("rng").collect()
        # a range needs as many pieces as its bytes, or its rows, ask for
        pieces = {
            r["rng"]: max(2, round(r["bytes"] / share), -(-r["n"] // RANGE_ROWS))
            for r in totals
            if r["n"] > 1 and (r["bytes"] > 2 * share or r["n"] > RANGE_ROWS or not salt)
        }
        if not pieces:
            break
        each, held = max(2.0, SAMPLE / sum(pieces.values())), {r["rng"]: r["bytes"] for r in totals}
        rates = rows.sparkSession.createDataFrame([(k, v * each / held[k]) for k, v in pieces.items()], "rng int, rate double")
        rated = ranged.join(F.broadcast(rates), "rng")  # a row for each range to be cut
        drawn: dict[int, list] = {}
        for r in _sample(rated, F.col("rate") * F.col("size"), salt):
            drawn.setdefault(r["rng"], []).append((r["h"], r["id"], r["w"]))
        keys = list(found.keys)
        for k, own in drawn.items():
            own.sort()
            upto = np.cumsum([w for *_, w in own])
            at = np.searchsorted(upto, np.arange(1, pieces[k]) * upto[-1] / pieces[k])
            keys += [own[i][:2] for i in np.unique(at)]
        if len(set(keys)) == len(found.keys):
            break
        found = Splitters(keys)
    else:
        ranged = rows.withColumn("rng", found.column(F.col("h"), F.col("id")))
        totals = ranged.groupBy("rng").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("rng").collect()
    return found, totals


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = materialise(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"),
        ),
        "sizes",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    found, totals = splitters_for(rows, total)
    before_bytes = np.concatenate([[0], np.cumsum([r["bytes"] for r in totals])]).tolist()
    before_rows = np.concatenate([[0], np.cumsum([r["n"] for r in totals])]).tolist()
    start = {r["rng"]: (before_bytes[i], before_rows[i]) for i, r in enumerate(totals)}
    spark = docs.sparkSession
    table = F.broadcast(  # one row per range, so bounded by the splitters above
        spark.createDataFrame([(k, int(b), int(n)) for k, (b, n) in start.items()], "rng int, b long, n long")
    )
    inside = Window.partitionBy("rng").orderBy("h", "id", "size")
    placed = (
        rows.withColumn("rng", found.column(F.col("h"), F.col("id")))
        .withColumns(
            {
                "upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
                "at": F.row_number().over(inside),
            }
        )
        .join(table, "rng")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.col("n") + F.col("at") - 1).alias("rank"),
            # the shard in which the record's middle byte falls
            F.least(
                F.floor((2 * (F.col("b") + F.col("upto")) - F.col("size")) * shards / F.lit(max(1.0, 2.0 * total))),
                F.lit(shards - 1),
            )
            .cast("int")
            .alias("shard"),
        )
    )
    placed = materialise(placed, "placed")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("rank").alias("first")))  # a row per shard
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot")
    )
