"""Shared helpers: written intermediate tables and small expression builders."""

from __future__ import annotations

import ctypes
import gc
import sys
import threading
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space as the contracts list it: blank and \x09-\x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: What separates alphanumeric words once A-Z is lower-cased.
ALNUM_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def materialise(df: DataFrame, name: str, path: str | None = None, options: dict | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage.

    The files outlive lost executors; the file system removes them when the driver's JVM ends, or never
    if a ``path`` is given.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_dealt(df: DataFrame, name: str, column: str, n: int) -> str:
    """Like ``materialise``, with rows dealt to ``n`` buckets by ``column``: later groupings by it read in place.

    Returns the name of a table in the session's catalog, to be dropped by the caller.
    """
    path = scratch_path(df.sparkSession, name)
    table = f"meterlark_{path.rsplit('/', 1)[-1].replace('-', '_')}"
    df.write.bucketBy(n, column).option("path", path).format("parquet").saveAsTable(table)
    return table


#: Most rows, and most bytes of written files, of a side that is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def stored_bytes(table: DataFrame) -> int:
    """Bytes of the files that a written table is read from."""
    return int(str(table._jdf.queryExecution().analyzed().stats().sizeInBytes()))


def counted_side(table: DataFrame) -> DataFrame:
    """A written table as the side of a join: broadcast if its rows and bytes allow it, else shuffled."""
    return F.broadcast(table) if stored_bytes(table) <= BROADCAST_BYTES and table.count() <= BROADCAST_ROWS else table


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """Join of ``rows``, whose keys may be hot, with a written ``table`` that has a row for each key.

    A table within ``counted_side``'s bounds is broadcast; a larger one is repeated for each salt, so that
    no key's rows meet in one task.
    """
    side = counted_side(table)
    if side is not table:
        return rows.join(side, keys, how)
    (salt,) = fresh_names(rows, "_salt")
    salted = rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    return salted.join(table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).cast("long")), [*keys, salt], how).drop(salt)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` begins with one of them."""
    out = []
    for name in names:
        while any(c.lower().startswith(name.lower()) for c in df.columns):
            name = f"{name}_"
        out.append(name)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/meterlark/" in file:
                target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
                target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Most bytes of a batch that goes to a Python worker: bounds its memory whatever the texts' lengths.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch to ``BATCH_BYTES``."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is not None and not 0 < int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


_worker = {"used": 0.0, "trimmed": True, "thread": None, "forget": []}
#: Seconds without a batch after which a Python worker gives its free memory back.
IDLE_S = 2.0


def used_worker(forget: Callable[[], None] | None = None) -> None:
    """Called in Python workers: gives free memory back once the worker has been idle for ``IDLE_S``.

    Workers outlive their stage, and what they keep is missing in the next. ``forget`` is called first.
    """

    def watch() -> None:
        while True:
            time.sleep(IDLE_S / 2)
            if not _worker["trimmed"] and time.monotonic() - _worker["used"] > IDLE_S:
                _worker["trimmed"] = True
                for f in _worker["forget"]:
                    f()
                gc.collect()
                if "pyarrow" in sys.modules:
                    sys.modules["pyarrow"].default_memory_pool().release_unused()
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
                if trim is not None:
                    trim(0)

    _worker["used"], _worker["trimmed"] = time.monotonic(), False
    if forget is not None and forget not in _worker["forget"]:
        _worker["forget"].append(forget)
    if _worker["thread"] is None:
        _worker["thread"] = threading.Thread(target=watch, daemon=True)
        _worker["thread"].start()


def gathered(batches: Iterator, size: int) -> Iterator:
    """Arrow batches put together until they hold about ``size`` bytes."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            held, n = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would fold other letters too)."""
    return F.translate(text, UPPER, UPPER.lower())


def alnum_words(text: Column) -> Column:
    """Lower-cased alphanumeric words of a text as an array; none for null or empty texts."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), ALNUM_BREAK), "")


def word_count(text: Column) -> Column:
    """Number of runs of characters that are no ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
