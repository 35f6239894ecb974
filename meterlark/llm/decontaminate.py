"""Benchmark decontamination over a stored positional inverted index (DataFrame operations only).

``build_index`` stores a posting (term, document, position) for every token of the training texts, once;
any number of benchmarks is then matched against it. The index is partitioned by document: each file
holds the lists of its own documents, sorted by term, so building it shuffles nothing and a hot term's
list is spread over all files. Beside it are the documents and a dictionary of the lists' lengths.

A test window of ten consecutive words is a list of (term, offset). Its rarest term, by the dictionary,
gives candidate starts (position minus offset); the second rarest list, adjusted by its offset, is
intersected with them on (document, position); the few candidates left must then be found in all
remaining lists. Windows with a term that has no list are dropped before any list is read.

The test set's terms and windows, and the candidates' documents, are broadcast within the bounds of
``common.counted_side``; beyond them the same joins shuffle. A term is its 64-bit hash: a false match
needs as many colliding words side by side as the window has.

Defined results: null and empty texts have no words and are clean; an item shorter than the window
is one window; an item without words, or with null id, names no hit (a null id's words still count
as hit); repeated rows get equal results and ``keep_clean`` keeps all of them or none; empty tables give
clean or empty results; extra columns of any name are kept by ``keep_clean`` and not read otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlark.llm.common import alnum_words, counted_side, discard, fresh_names, materialise

WINDOW = 10


@dataclass(frozen=True)
class Index:
    """Written tables: docs (row, doc_id, d, h, words), postings (tid, row, pos) and dictionary (tid, n)."""

    docs: DataFrame
    postings: DataFrame
    dictionary: DataFrame


def _identity() -> dict[str, Column]:
    """Two longs that name a document by its id and text, or by its text alone where the id is null."""
    return {"d": F.coalesce("doc_id", F.xxhash64(F.lit(7), "text")), "h": F.xxhash64("text")}


def _term(word: Column) -> Column:
    return F.xxhash64(word)


def build_index(docs: DataFrame, path: str | None = None) -> Index:
    """The index of all tokens of ``docs`` (doc_id, text), stored below ``path`` or in scratch tables."""
    at = lambda name: path and f"{path}/{name}"
    # row numbers are data of this table, so they are the same for all that reads it
    words = docs.select("doc_id", *[c.alias(n) for n, c in _identity().items()], alnum_words(F.col("text")).alias("words"))
    rows = materialise(words.withColumn("row", F.monotonically_increasing_id()), "docs", at("docs"))
    tokens = rows.select("row", F.posexplode("words").alias("pos", "term")).select(_term(F.col("term")).alias("tid"), "row", "pos")
    postings = materialise(tokens.sortWithinPartitions("tid"), "postings", at("postings"), {"parquet.writer.version": "v2"})
    dictionary = materialise(postings.groupBy("tid").agg(F.count("*").alias("n")), "dictionary", at("dictionary"))
    return Index(rows, postings, dictionary)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("docs", "postings", "dictionary")))


def windows_of(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win, words) of the items (item_id, text), and which items (item_id, win) have them."""
    words = items.select("item_id", alnum_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1)))
    cut = words.select("item_id", "w", starts.alias("s")).select("item_id", F.slice("w", F.col("s"), window).alias("words"))
    # ids by place in the written table
    windows = materialise(cut.select("words").distinct().withColumn("win", F.monotonically_increasing_id()), "windows")
    return windows, materialise(cut.join(windows, "words").select("item_id", "win").distinct(), "items")


def _lists(index: Index, windows: DataFrame) -> DataFrame:
    """(win, len, off, tid, n): the windows' words and the lengths of their lists, 0 without one."""
    parts = windows.select("win", F.size("words").alias("len"), F.posexplode("words").alias("off", "term"))
    parts = materialise(parts.select("win", "len", "off", _term(F.col("term")).alias("tid")), "lists")
    asked = counted_side(materialise(parts.select("tid").distinct(), "vocabulary"))
    counts = counted_side(materialise(index.dictionary.join(asked, "tid", "left_semi"), "lengths"))
    return parts.join(counts, "tid", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def phrase_matches(index: Index, windows: DataFrame) -> DataFrame:
    """(row, win, start, len) of every place where a window's words stand consecutively."""
    postings, by = index.postings, Window.partitionBy("win")
    rated = materialise(
        _lists(index, windows)
        .withColumns({"rank": F.row_number().over(by.orderBy("n", "off")), "least": F.min("n").over(by)})
        .filter("least > 0")
        .drop("n", "least"),
        "terms",
    )
    second = rated.filter("rank = 2").select("win", F.col("tid").alias("tid2"), F.col("off").alias("off2"))
    first = rated.filter("rank = 1").select("tid", "win", "len", F.col("off").alias("off1")).join(second, "win", "left")
    first = counted_side(materialise(first, "rarest"))
    starts = postings.join(first, "tid").withColumn("start", F.col("pos") - F.col("off1")).filter("start >= 0")
    seconds = counted_side(materialise(second.select(F.col("tid2").alias("tid")).distinct(), "second"))
    lists = postings.join(seconds, "tid", "left_semi").select("row", F.col("pos").alias("at"), F.col("tid").alias("tid2"))
    alone = starts.filter("tid2 is null").select("row", "win", "len", "start")
    both = (
        starts.filter("tid2 is not null")
        .select("row", "win", "len", "start", (F.col("start") + F.col("off2")).alias("at"), "tid2")
        .join(lists, ["row", "at", "tid2"], "left_semi")
    )
    left = materialise(both.select("row", "win", "len", "start").unionByName(alone).distinct(), "starts")
    rest = counted_side(materialise(rated.filter("rank > 2").select("win", "tid", "off"), "rest"))
    asked = left.join(rest, "win").select("row", "win", "len", "start", (F.col("start") + F.col("off")).alias("pos"), "tid")
    some = counted_side(materialise(left.select("row").distinct(), "candidates"))
    near = postings.join(some, "row", "left_semi")
    complete = (
        asked.join(near, ["row", "pos", "tid"], "left_semi")
        .groupBy("row", "win", "start", "len")
        .agg(F.count("*").alias("n"))
        .filter("n = len - 2")
        .drop("n")
    )
    return left.filter("len <= 2").unionByName(complete.select("row", "win", "len", "start"))


def proximity_matches(index: Index, windows: DataFrame, slack: int = 5) -> DataFrame:
    """(row, win, begin): spans of len + slack words that hold all of a window's distinct terms.

    Every such span holds the rarest term, so only spans around its postings are looked into.
    """
    listed = materialise(_lists(index, windows).select("win", (F.col("len") + slack).alias("span"), "tid", "n").distinct(), "lists")
    by = Window.partitionBy("win")
    rated = listed.withColumns({"rank": F.row_number().over(by.orderBy("n", "tid")), "need": F.count("*").over(by)})
    rarest = counted_side(materialise(rated.filter("rank = 1 and n > 0").select("tid", "win", "span", "need"), "rarest"))
    begins = (
        index.postings.join(rarest, "tid")
        .select("row", "win", "span", "need", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - F.col("span") + 1), F.col("pos"))).alias("begin"))
        .distinct()
    )
    asked = begins.join(listed.select("win", "tid"), "win")
    held = asked.join(index.postings, ["row", "tid"]).filter("pos >= begin and pos < begin + span")
    return (
        held.groupBy("row", "win", "begin", "need")
        .agg(F.count_distinct("tid").alias("n"))
        .filter("n = need")
        .select("row", "win", "begin")
    )


def contamination(index: Index, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, n_hit, n_items, items_sha256) of the index's documents with any hit."""
    windows, named = windows_of(items, window)
    found = materialise(phrase_matches(index, windows), "matches")
    hit = (
        found.select("row", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos"))
        .distinct()
        .groupBy("row")
        .agg(F.count("*").alias("n_hit"))
    )
    by_item = (
        found.select("row", "win")
        .distinct()
        .join(named.select("win", F.col("item_id").cast("string").alias("item")), "win")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return hit.join(by_item, "row").select(
        "row", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``."""
    return digest(build_index(docs), items, window)


def digest(index: Index, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``decontaminate`` for the documents of an index."""
    found = counted_side(materialise(contamination(index, items, window), "contaminated"))
    rows = index.docs.select("row", "doc_id", F.size("words").cast("long").alias("n_words"))
    return rows.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no window of any item."""
    index = build_index(docs)
    (name,) = fresh_names(docs, "_clean")
    hit = counted_side(materialise(contamination(index, items, window).select("row"), "rows"))
    found = index.docs.select("row", "d", "h").join(hit, "row", "left_semi")
    found = counted_side(materialise(found.select(*[F.col(c).alias(name + c) for c in _identity()]), "contaminated"))
    discard(index.docs, index.postings, index.dictionary)
    keyed = docs.withColumns({name + n: c for n, c in _identity().items()})
    return keyed.join(found, [name + n for n in _identity()], "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[i:i + 9], ' ') AS p FROM s),
ls AS (SELECT DISTINCT l FROM win),
p AS (SELECT r, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM d, ls WHERE len(w) >= l),
m AS (SELECT r, p.l, i, item_id FROM p JOIN win ON win.l = p.l AND win.p = array_to_string(p.w[i:i + p.l - 1], ' ')),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS q FROM m) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha
    FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
