"""Exact top-k inner products from a stored impact-ordered index, score at a time.

Every component of a vector is a posting (vector, impact) of its dimension. An index shard holds the
postings of some thousand vectors in segments: impacts are quantised to ``LEVELS`` levels of size, and a
segment has the postings of one level and dimension, the highest level first. Shards are built once and
written to a table (``build_index``); ``search`` reads it for any number of query sets.

Segments are added to the queries' accumulators level by level. What is left of a vector can change its
score by at most the Cauchy-Schwarz product of the query's norm and the norm of its unprocessed
components, so each accumulator has an upper bound. From a fifth of the postings on, the rows that lead their
part of the accumulators are scored exactly; k of them reach the k-th best of these scores, and a vector whose
upper bound is below it is out for good. A query stops, whatever the others do, once these bounds prove that
its possible members cost less to rescore than its remaining postings to read; it skips those segments.
Possible members are rescored exactly, as whole numbers. Bounds include the rounding error of the
accumulators, so they hold for components of any size.

Of equal vectors only the k + 1 smallest ids can be members (ties go to smaller ids, and a query's own id
is none of its candidates), so the others stay out of the index; a vector that a third of all rows hold
costs k + 1 postings a dimension. Shards times query blocks are dealt out as one group each (an equi-join
on the shard number with the blocks repeated for each shard), so no task holds more than one shard and one
block; each returns k rows a query, and the merge keeps the k best of each task before it shuffles.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do
rows with a null id; vectors of different lengths count as padded with zeros; rows with a query's id
are not its candidates; equal scores go to the smaller id; repeated rows are one candidate, rows that
share an id alone are vectors of their own; components and scores beyond a long count as the nearest
long; fewer candidates than k give fewer rows; an empty table gives an empty table; extra columns are not
read.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlark.llm.common import bound_batches, materialise

SHARD_ROWS, BLOCK_QUERIES = 8192, 8192
#: Queries whose accumulators a task holds at once.
AT_ONCE = 128
LEVELS = 16
#: Share of the postings that is read before bounds are tried, and parts of the accumulators whose leaders are scored for it.
FLOOR_FROM, LEADERS = 0.2, 64
_LONG = (1 << 63) - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null where the vector takes no part."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & sound, whole)


def _matrix(values, dim: int) -> np.ndarray:
    out = np.zeros((len(values), dim), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


class Shard:
    """Ids, vectors and their segments by (level, dimension), the highest level first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        self.ids, self.vectors, self.dim = ids, vectors, vectors.shape[1]
        size = np.abs(vectors.astype(np.float64))
        borders = np.unique(np.quantile(size[size > 0], np.linspace(0, 1, levels + 1)[1:-1], method="lower")) if size.any() else np.zeros(0)
        self.levels = len(borders) + 1
        level = len(borders) - np.searchsorted(borders, size, "left")
        rows, dims = np.nonzero(size)
        by = np.lexsort((rows, dims, level[rows, dims]))
        self.rows, dims = rows[by].astype(np.int32), dims[by]
        level = level[self.rows, dims]
        self.impacts = vectors[self.rows, dims].astype(np.float64)
        self.starts = np.searchsorted(level * self.dim + dims, np.arange(self.levels * self.dim + 1))
        squares = np.zeros((self.levels + 1, len(ids)))
        np.add.at(squares, (level, self.rows), self.impacts**2)
        # norm of what is left after each level, rounded up
        self.left = np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1][1:]) * (1 + 1e-9)
        self.norms = np.sqrt(squares.sum(axis=0)) * (1 + 1e-9)
        self.most = float(size.max(initial=0))
        self.whole = None  # the vectors as floats, once they are rescored
        self.read = 0  # postings added to an accumulator, for tests and figures

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, id, score) of the k best of the shard for each query, exactly."""
        found = [self._search(query_ids[a : a + AT_ONCE], queries[a : a + AT_ONCE], k) for a in range(0, len(queries), AT_ONCE)]
        at = np.concatenate([np.zeros(0, np.int64)] + [x[0] + a * AT_ONCE for a, x in enumerate(found)])
        return at, *(np.concatenate([np.zeros(0, np.int64)] + [x[i] for x in found]) for i in (1, 2))

    def _search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        n, out = len(self.ids), []
        # whole numbers of 15 bits have accumulators of 4 bytes, which the bounds allow for
        small = max(self.most, float(np.abs(queries.astype(np.float64)).max(initial=0))) < 1 << 15
        kind, unit = (np.float32, 2.0**-21) if small else (np.float64, 2.0**-50)
        impacts, weight = self.impacts.astype(kind), np.ascontiguousarray(queries.T.astype(kind))
        reach, asking = np.linalg.norm(queries.astype(np.float64), axis=1) * (1 + 1e-9), np.arange(len(queries))
        # rounding error of the sums; it decides nothing where components are small
        error = unit * (self.dim + 8) * self.norms
        total = np.zeros((n, len(queries)), kind)
        own = self._own(query_ids)
        total[own] = -np.inf
        floor = np.full(len(queries), -np.inf)
        for level in range(self.levels):
            for d in range(self.dim):
                a, b = self.starts[level * self.dim + d : level * self.dim + d + 2]
                if a < b:
                    added = np.multiply.outer(impacts[a:b], weight[d])
                    added += total.take(self.rows[a:b], axis=0)
                    total[self.rows[a:b]] = added
            read = self.starts[(level + 1) * self.dim]
            self.read += int(read - self.starts[level * self.dim]) * len(asking)
            rest = len(self.rows) - read
            if rest and read < FLOOR_FROM * len(self.rows):
                continue
            floor = np.maximum(floor, self._floor(total, own, queries[asking], reach[asking], k))
            bound = np.multiply.outer((self.left[level] + error).astype(kind), reach[asking].astype(kind))
            bound += total
            possible = bound >= np.nextafter(floor.astype(kind), kind(-np.inf))
            possible[own] = False
            done = possible.sum(axis=0) * self.dim <= rest if rest else np.ones(len(asking), bool)
            for j in np.flatnonzero(done):
                who = np.flatnonzero(possible[:, j])
                score = self._scores(who, queries[asking[j]])
                if len(who) > k and score.dtype != object:
                    enough = score >= np.partition(score, len(who) - k)[len(who) - k]
                    who, score = who[enough], score[enough]
                best = np.lexsort((self.ids[who], -score if score.dtype != object else [-x for x in score]))[:k]
                out.append((np.full(len(best), asking[j]), self.ids[who[best]], score[best].astype(np.int64)))
            if done.all():
                break
            if done.any():
                asking, floor = asking[~done], floor[~done]
                total, weight = np.ascontiguousarray(total[:, ~done]), np.ascontiguousarray(weight[:, ~done])
                own = self._own(query_ids[asking])
        out.sort(key=lambda x: x[0][0] if len(x[0]) else -1)
        return tuple(np.concatenate([np.zeros(0, np.int64)] + [x[i] for x in out]) for i in range(3))

    def _own(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, query) of the rows that have a query's id."""
        by = np.argsort(self.ids, kind="stable")
        a, b = (np.searchsorted(self.ids[by], query_ids, side) for side in ("left", "right"))
        at = np.repeat(np.arange(len(query_ids)), b - a)
        return by[np.arange(len(at)) - np.repeat(np.cumsum(b - a) - b, b - a)], at

    def _floor(self, total: np.ndarray, own: tuple, queries: np.ndarray, reach: np.ndarray, k: int) -> np.ndarray:
        """A score that k candidates of each query reach for certain: the k-th of rows that lead their part of the accumulators."""
        n, m = total.shape
        parts = min(n, max(LEADERS, 4 * k))
        if parts < k:
            return np.full(m, -np.inf)
        size = n // parts
        lead = total[: parts * size].reshape(parts, size, m).argmax(axis=1) + (np.arange(parts) * size)[:, None]
        sums = np.einsum("pmd,md->pm", self.vectors[lead].astype(np.float64), queries.astype(np.float64))
        sums -= 2.0**-50 * (self.dim + 8) * self.norms[lead] * reach
        sums[np.isneginf(total[lead, np.arange(m)])] = -np.inf
        found = np.partition(sums, parts - k, axis=0)[parts - k]
        # scores beyond a long are equal to the nearest one
        return np.where(found <= -(2.0**63), -np.inf, np.minimum(found, 2.0**63 - 1024))

    def _scores(self, who: np.ndarray, query: np.ndarray) -> np.ndarray:
        most = self.most * float(np.abs(query.astype(np.float64)).max(initial=0)) * self.dim
        if most < 2.0**53:  # sums of whole numbers that are exact
            kind = np.float32 if most < 2.0**24 else np.float64
            if self.whole is None or self.whole.dtype != kind:
                self.whole = self.vectors.astype(kind)
            return (self.whole.take(who, axis=0) @ query.astype(kind)).astype(np.int64)
        own = self.vectors[who].astype(np.int64)
        if most < 2.0**62:
            return own @ query
        exact = [sum(int(x) * int(y) for x, y in zip(v, query)) for v in own]
        return np.array([max(-_LONG - 1, min(_LONG, x)) for x in exact], object)


def _vectors(vectors: DataFrame, ident: str, vector: str, scale: int) -> DataFrame:
    rows = vectors.select(F.col(ident).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("v"))
    return materialise(rows.filter("vec_id is not null and v is not null"), "vectors")


def build_index(rows: DataFrame, k: int, path: str | None = None) -> DataFrame:
    """(shard, index) of the vectors (vec_id, v), for searches of up to ``k``: a table at ``path``, or a scratch one."""
    bound_batches(rows.sparkSession)
    few = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    held = materialise(rows.withColumn("_r", few).filter(F.col("_r") <= k + 1).drop("_r").distinct(), "held")
    facts = held.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim, shards = max(1, facts["dim"] or 0), max(1, math.ceil(facts["n"] / SHARD_ROWS))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        data = _matrix(pdf["v"], dim)
        most = int(np.abs(data.astype(np.float64)).max(initial=0))
        kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
        shard = Shard(pdf["vec_id"].to_numpy(np.int64), data.astype(kind))
        return pd.DataFrame({"shard": [int(key[0])], "dim": [dim], "index": [pickle.dumps(shard, 5)]})

    dealt = held.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int"))
    return materialise(dealt.groupBy("shard").applyInPandas(build, "shard int, dim int, index binary"), "index", path)


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query (vec_id, v) with the index."""
    asked = materialise(queries.distinct(), "queries")
    blocks = math.ceil(max(1, asked.count()) / BLOCK_QUERIES)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    held = index.withColumn("block", every)
    put = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )

    def look(own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(wanted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        shard = pickle.loads(own["index"].iloc[0])
        asking = wanted["vec_id"].to_numpy(np.int64)
        # components beyond the shard's dimensions meet zeros
        weights = _matrix([v[: shard.dim] for v in wanted["v"]], shard.dim)
        at, who, score = shard.search(asking, weights, k)
        return pd.DataFrame({"query_id": asking[at], "vec_id": who, "score": score})

    found = held.groupBy("shard", "block").cogroup(put.groupBy("shard", "block")).applyInPandas(look, "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def top_k(vectors: DataFrame, ident: str, vector: str, queries: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products for each query row.

    ``queries`` is a condition on column ``vec_id``; all other rows are its candidates.
    """
    rows = _vectors(vectors, ident, vector, scale)
    return search(build_index(rows, k), rows.filter(queries), k)


ORACLE_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
