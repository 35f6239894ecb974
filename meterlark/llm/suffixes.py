"""Exact removal of repeated byte strings by suffix arrays of content-defined shards.

A string of ``length`` bytes (a window) is repeated if it also starts earlier: in a document with smaller
id, or in the same document further ahead. Suffix arrays see only their own shard, so windows are sharded
by content: each window is dealt by its anchor, the least of its hashed ``GRAM``-byte grams (the leftmost
of equals). Equal windows have equal anchors at equal offsets, so they always meet. Consecutive windows
with one anchor travel as one snippet.

1. Each task hashes its texts and emits, for each snippet, the hash of its anchor, a hash of the whole
   snippet and where it starts. Of snippets that are equal as a whole (both hashes, 128 bits) only the
   earliest goes on, in the task and again in the shard: all windows of the others are repeated, and a
   passage in a third of all documents is one row for each batch of text.
2. Snippets whose anchor occurs in no other snippet share no window and need no order. The rest are
   fetched as bytes, and each shard's snippets are sorted by external induced sorting (``induced``): in
   suffix order, windows that share ``length`` bytes are neighbours by their common prefixes, and all but
   the earliest of them are repeated.
3. Repeated windows are joined to runs in each document, and what is left is hashed.

Texts are kept compressed beside the shards in the shared folder between the steps, dealt by document.
Tasks hold one shard, or one share of documents; both shrink with the number of shuffle partitions.

Defined results: null text is empty; texts under ``length`` bytes lose nothing; rows with equal ids are
different documents, in the order of their rows; a null id comes first; an empty table gives an empty
table; extra columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.llm.common import bound_batches, gathered, materialise, materialise_dealt, partitions
from meterlark.llm.induced import BREAK, SHIFT, suffix_array

LENGTH, GRAM = 100, 20
#: Bytes of text that are hashed at once; longer texts are cut, overlapping by a window.
BATCH = 2 << 20
#: Shards of snippets to a bucket of anchors.
SPLIT = 4
#: Bytes of text that are packed at once.
GATHERED = 24 << 20
ANCHORS, TEXT, REPEATED, SHARED = 0, 1, 2, 3
PACKED = "kind int, bucket int, data binary"
_NO_ID = -(1 << 63)


class Columns:
    """Equal-length numpy columns as one binary: a table travels in few rows."""

    @staticmethod
    def pack(columns: list[np.ndarray], steps: tuple = ()) -> bytes:
        """``steps``: columns that are stored as differences, as they mostly ascend."""
        out = [struct.pack("<I", len(columns[0]))]
        for k, column in enumerate(columns):
            column = np.ascontiguousarray(column)
            if k in steps:
                column = np.diff(column, prepend=column.dtype.type(0))
            # byte planes compress better
            out.append(column.view(np.uint8).reshape(len(column), column.itemsize).T.tobytes())
        return b"".join(out)

    @staticmethod
    def unpack(data: bytes, types: list, steps: tuple = ()) -> list[np.ndarray]:
        (n,), at, out = struct.unpack_from("<I", data), 4, []
        for k, kind in enumerate(map(np.dtype, types)):
            planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
            column = np.ascontiguousarray(planes.T).view(kind).ravel()
            out.append(np.cumsum(column, dtype=kind) if k in steps else column)
            at += n * kind.itemsize
        return out

    @classmethod
    def all(cls, blobs: list, types: list, steps: tuple = ()) -> list[np.ndarray]:
        parts = [cls.unpack(b, types, steps) for b in blobs]
        return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate(types)]


#: anchor hash, snippet hash, doc id, row, start, places from start to anchor, windows
_SNIPPET = ["<u8", "<u8", "<i8", "<i8", "<u4", "u1", "u1"]
_STEPS = (2, 3)
_RUN = ["<i8", "<u4", "<u4"]  # row, start, end
_WANTED = ["<i8", "<i8", "<u4", "u1", "<u4"]  # row, doc id, start, windows, shard


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


class Hasher:
    """Hashes of any stretch of a batch, from prefix sums of two polynomials modulo 2^64."""

    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, size: int):
        values = np.random.default_rng(20240229).integers(0, 1 << 63, (2, 256), dtype=np.uint64)
        self.tables = values << np.uint64(1) | np.uint64(1)
        inverse = [pow(b, -1, 1 << 64) for b in self.BASES]
        power = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)])
        self.power, self.inverse = [power(b) for b in self.BASES], [power(b) for b in inverse]

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        return np.r_[np.uint64(0), np.cumsum(self.tables[which][data] * self.power[which][: len(data)])]

    def of(self, sums: np.ndarray, which: int, a: np.ndarray | slice, b: np.ndarray | slice) -> np.ndarray:
        return (sums[b] - sums[a]) * self.inverse[which][a if not isinstance(a, slice) else slice(a.start, a.stop)]


def snippets_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: Hasher, length: int, gram: int):
    """(text number, start in data, places to the anchor, windows, anchor hash, snippet hash) of all snippets.

    ``starts`` and ``ends`` are the texts' places in ``data``, ascending and apart.
    """
    own = np.flatnonzero(ends - starts >= length)
    if not len(own):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    first = hasher.sums(data, 0)
    n, span = len(data) - gram + 1, length - gram + 1
    keys = _mix(hasher.of(first, 0, slice(0, n), slice(gram, None)))
    least = keys & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: -(span - size)], least[span - size :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.union1d(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, starts[own])
    text = np.searchsorted(starts[own], begin, "right") - 1
    stop = ends[own][np.maximum(text, 0)] - length + 1
    good = (text >= 0) & (begin < stop)
    upto = np.minimum(np.r_[begin[1:], len(anchor)], stop)
    begin, upto, text = begin[good], upto[good], own[text[good]]
    at = anchor[begin]
    windows = upto - begin
    second = hasher.sums(data, 1)
    whole = _mix(hasher.of(second, 1, begin, upto - 1 + length) ^ (windows.astype(np.uint64) << np.uint64(8) | (at - begin).astype(np.uint64)))
    return [text, begin, at - begin, windows, keys[at], whole]


def _earliest(g: np.ndarray, c: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of (g, c, then ``order``), and whether each is the first of its (g, c)."""
    by = np.lexsort((*order[::-1], c, g))
    new = np.r_[True, (g[by][1:] != g[by][:-1]) | (c[by][1:] != c[by][:-1])][: len(by)]
    return by, new


def _cut(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Batches of (text, from, to): whole texts, or parts of long ones that overlap by a window less one."""
    batch, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), BATCH):
            to = min(len(text), at + BATCH + length - 1)
            if size and size + to - at > BATCH:
                yield batch
                batch, size = [], 0
            batch.append((k, at, to))
            size += to - at
    if batch:
        yield batch


def _deal(kind: int, bucket: np.ndarray, n: int, columns: list[np.ndarray], steps: tuple = ()) -> list:
    """Rows (kind, bucket, packed columns), one for each bucket in use."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    columns = [c[order] for c in columns]
    return [
        (kind, k, Columns.pack([c[edges[k] : edges[k + 1]] for c in columns], steps)) for k in range(n) if edges[k] < edges[k + 1]
    ]


def _frame(rows: list) -> pa.RecordBatch:
    kinds, buckets, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(data, pa.binary())], ["kind", "bucket", "data"])


def _share(row: np.ndarray, n: int) -> np.ndarray:
    return (_mix(row.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _pack_texts(ids: np.ndarray, rows: np.ndarray, texts: list[bytes]) -> bytes:
    import zstandard

    head = Columns.pack([ids, rows, np.fromiter(map(len, texts), np.int64, len(texts))])
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(texts))


def _unpack_texts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    ids, rows, lens = Columns.unpack(data, ["<i8", "<i8", "<i8"])
    body = zstandard.ZstdDecompressor().decompress(data[4 + 24 * len(ids) :], max_output_size=int(lens.sum()) + 1)
    return ids, rows, lens, np.frombuffer(body, np.uint8)


def _hash_texts(n: int, length: int, gram: int):
    """Step 1 in a task: texts to snippets by anchor, repeated runs and compressed texts by document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(BATCH + 4 * LENGTH)
        for batch in gathered(batches, GATHERED):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = batch.column(2).to_pylist()
            share = _share(rows, n)
            for k in np.unique(share).tolist():
                own = np.flatnonzero(share == k)
                yield _frame([(TEXT, k, _pack_texts(ids[own], rows[own], [texts[i] for i in own]))])
            for part in _cut(texts, length):
                sizes = np.array([to - at for _, at, to in part], np.int64)
                data = np.frombuffer(b"".join(texts[k][at:to] for k, at, to in part), np.uint8)
                ends = np.cumsum(sizes)
                text, begin, ahead, windows, g, c = snippets_of(data, ends - sizes, ends, hasher, length, gram)
                if not len(text):
                    continue
                which = np.array([k for k, *_ in part], np.int64)[text]
                start = begin - (ends - sizes)[text] + np.array([at for _, at, _ in part], np.int64)[text]
                by, new = _earliest(g, c, ids[which], rows[which], start)
                kept, gone = by[new], by[~new]
                kept = kept[np.lexsort((start[kept], which[kept]))]
                out = _deal(ANCHORS, (g[kept] % np.uint64(n)).astype(np.int64), n, [
                    g[kept], c[kept], ids[which[kept]], rows[which[kept]], start[kept].astype(np.uint32),
                    ahead[kept].astype(np.uint8), (windows[kept] - 1).astype(np.uint8)], _STEPS)
                if len(gone):
                    out += _deal(REPEATED, share[which[gone]], n, [rows[which[gone]], start[gone].astype(np.uint32), (start + windows + length - 1)[gone].astype(np.uint32)])
                yield _frame(out)

    return work


def _meet(n: int, length: int):
    """Step 1 in a shard: the earliest of equal snippets stay; those with a shared anchor are asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            other = []
            for kind, bucket, data in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == ANCHORS:
                    held.setdefault(bucket, []).append(data)
                else:
                    other.append((kind, bucket, data))
            if other:
                yield _frame(other)
        for bucket in list(held):
            g, c, ids, rows, start, _, windows = Columns.all(held.pop(bucket), _SNIPPET, _STEPS)
            # only anchors that occur again matter
            order = np.sort(g)
            again = np.unique(order[1:][order[1:] == order[:-1]])
            at = np.minimum(np.searchsorted(again, g), max(0, len(again) - 1))
            some = np.flatnonzero(again[at] == g) if len(again) else np.zeros(0, np.int64)
            if not len(some):
                continue
            g, c, ids, rows, start, windows = (x[some] for x in (g, c, ids, rows, start, windows))
            by, new = _earliest(g, c, ids, rows, start)
            gone, kept = by[~new], by[new]
            out = []
            if len(gone):
                end = start[gone] + windows[gone].astype(np.uint32) + np.uint32(length)
                out += _deal(REPEATED, _share(rows[gone], n), n, [rows[gone], start[gone], end])
            several = np.flatnonzero(np.r_[False, g[kept][1:] == g[kept][:-1]] | np.r_[g[kept][1:] == g[kept][:-1], False]) if len(kept) > 1 else []
            if len(several):
                own = kept[several]
                out += _deal(SHARED, _share(rows[own], n), n, [rows[own], ids[own], start[own], windows[own], (bucket + n * (g[own] // np.uint64(n) % np.uint64(SPLIT))).astype(np.uint32)])
            if out:
                yield _frame(out)

    return work


def _texts(blobs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, rows, lengths, all bytes) of a share's documents."""
    parts = [_unpack_texts(b) for b in blobs]
    if not parts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint8),)
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))


def _blobs(side: pd.DataFrame) -> list:
    """A side of a cogroup; an empty one may come without its columns."""
    return side["data"].tolist() if len(side) else []


def _stretches(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places of all stretches, one after the other."""
    upto = np.cumsum(lens)
    return np.repeat(starts - upto + lens, lens) + np.arange(int(upto[-1]) if len(upto) else 0)


def _fetch(n: int, length: int):
    """Step 2, by document: the bytes of the snippets asked for, by shard."""

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows, ids, start, windows, shard = Columns.all(_blobs(right), _WANTED)
        if not len(rows):
            return pd.DataFrame({"bucket": [], "data": []})
        _, own, lens, data = _texts(_blobs(left))
        by = np.argsort(own, kind="stable")
        at = by[np.searchsorted(own[by], rows)]
        size = windows.astype(np.int64) + length
        out = []
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1], True])
        begin = (np.cumsum(lens) - lens)[at] + start
        for a, b in zip(edges[:-1], edges[1:]):
            some = order[a:b]
            head = Columns.pack([ids[some], rows[some], start[some], windows[some]])
            out.append((int(shard[some[0]]), head + data[_stretches(begin[some], size[some])].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "data"])

    return work


def repeated_windows(ids: np.ndarray, rows: np.ndarray, start: np.ndarray, windows: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of each window of the snippets that is equal to an earlier one, by their suffix array.

    Snippet k has ``windows[k]`` windows, and its windows[k] + length - 1 bytes stand in ``data`` in order.
    """
    size = windows + length - 1
    text = np.full(int((size + 1).sum()), BREAK, np.uint8)
    places = _stretches(np.cumsum(size + 1) - size - 1, size)
    text[places] = data + np.uint8(SHIFT)
    suffixes, common = suffix_array(text, length)
    # suffixes with another beside them; of those, starts of windows in groups of two and more
    group = np.cumsum(common < length, dtype=np.int32)
    some = np.flatnonzero(np.bincount(group)[group] > 1)
    suffixes, group = suffixes[some], group[some]
    begin = np.cumsum(size + 1) - size - 1
    snippet = np.searchsorted(begin, suffixes, "right") - 1
    offset = suffixes - begin[snippet]
    real = np.flatnonzero(offset < windows[snippet])
    real = real[np.bincount(group[real], minlength=1)[group[real]] > 1] if len(real) else real
    snippet, offset, group = snippet[real], offset[real], group[real]
    place = start[snippet].astype(np.int64) + offset
    by = np.lexsort((place, rows[snippet], ids[snippet], group))
    later = by[~np.r_[True, group[by][1:] != group[by][:-1]][: len(by)]]
    return rows[snippet[later]], place[later]


def _sort_shard(n: int, length: int):
    """Step 2, by shard: suffix order of the snippets; repeated runs, by document."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        heads, bodies = [], []
        for blob in pdf["data"]:
            head = Columns.unpack(blob, ["<i8", "<i8", "<u4", "u1"])
            heads.append(head)
            bodies.append(np.frombuffer(blob, np.uint8, offset=4 + 21 * len(head[0])))
        ids, rows, start, windows = (np.concatenate([h[k] for h in heads]) for k in range(4))
        row, place = repeated_windows(ids, rows, start, windows.astype(np.int64) + 1, np.concatenate(bodies), length)
        if not len(row):
            return pd.DataFrame({"bucket": [], "data": []})
        by = np.lexsort((place, row))
        row, place = row[by], place[by]
        first = np.r_[True, (row[1:] != row[:-1]) | (place[1:] > place[:-1] + length)]
        last = np.r_[first[1:], True]
        out = _deal(REPEATED, _share(row[first], n), n, [row[first], place[first].astype(np.uint32), (place[last] + length).astype(np.uint32)])
        return pd.DataFrame([(b, d) for _, b, d in out], columns=["bucket", "data"])

    return work


def _remove(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Step 3, by document: what is left of each text."""
    row, start, end = Columns.all(_blobs(right), _RUN)
    by = np.argsort(row, kind="stable")
    row, start, end = row[by], start[by].astype(np.int64), end[by].astype(np.int64)
    parts = [pd.DataFrame({"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []})]
    for blob in _blobs(left):  # a batch's documents of this share
        ids, rows, lens, data = _unpack_texts(blob)
        low, high = np.searchsorted(row, rows, "left"), np.searchsorted(row, rows, "right")
        runs = _stretches(low, high - low)
        # texts are kept apart by one place each
        shift = np.cumsum(lens) - lens + np.arange(len(lens))
        at, n = np.repeat(shift, high - low), len(data) + len(lens) + 1
        depth = np.bincount(at + start[runs], minlength=n) - np.bincount(at + end[runs], minlength=n)
        gone = np.cumsum(depth) > 0
        rises = gone & ~np.r_[False, gone[:-1]]
        count = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][np.r_[shift, n - 1]])  # noqa: B023, E731
        removed, spans = count(gone), count(rises)
        kept = data[~np.delete(gone, np.r_[shift[1:] - 1, n - 2, n - 1])]
        stop = np.cumsum(lens - removed)
        digest = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip((stop - lens + removed).tolist(), stop.tolist())]
        parts.append(pd.DataFrame({
            "doc_id": pd.array([None if i == _NO_ID else i for i in ids.tolist()], "Int64"),
            "n_bytes": lens, "n_removed": removed, "n_spans": spans, "kept_sha256": digest}))
    return pd.concat(parts[1:] or parts)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs`` (doc_id, text)."""
    if not gram < length <= 256:
        raise ValueError("windows must be longer than grams and at most 256 bytes")
    spark = docs.sparkSession
    n = partitions(spark)
    bound_batches(spark)
    texts = docs.select(
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    first = materialise_dealt(
        texts.mapInArrow(_hash_texts(n, length, gram), PACKED).repartition(n, "kind", "bucket").mapInArrow(_meet(n, length), PACKED),
        "shards",
        "bucket",
        n,
    )
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of what has been written
    # texts are read where they were dealt, not shuffled again; the other side gets columns of its own
    of = lambda kind: spark.table(first).filter(F.col("kind") == kind).select("bucket", "data")
    renamed = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))
    asked = of(TEXT).groupBy("bucket").cogroup(renamed(of(SHARED)).groupBy("bucket")).applyInPandas(_fetch(n, length), "bucket int, data binary")
    sorted_ = materialise(asked.groupBy("bucket").applyInPandas(_sort_shard(n, length), "bucket int, data binary"), "repeats")
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    runs = renamed(of(REPEATED)).unionByName(sorted_)
    return of(TEXT).groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInPandas(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
