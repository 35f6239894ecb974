"""Language ID with language-bitmask n-gram filters.

One Bloom filter serves all languages: its table is bit-sliced, row r holding one bit for each
language, so the AND of an n-gram's rows is the mask of all languages whose filter contains it. A
text's n-grams are looked up in one pass; the popcount of each language's bit, corrected for that
language's rate of false positives and for the share of its own text that its filter covers,
decides.

The filters are learned from labelled rows outside the held-out fold (crc32 of the id as text,
modulo 5, is 0). About ``SAMPLE_ROWS`` rows of each language, drawn by a hash of the id, are read
whole; each language keeps its most frequent n-grams up to ``COVER`` of its occurrences, ``MOST``
at most. Every 64 languages share a slice of the table, so the model that is broadcast has a fixed
size for each slice.

Defined results: null text and texts without a letter are ``und`` with score 0; a text with letters
always gets a learned language, by more training rows and then by name if filters tie; without any
learned language everything is ``und``, and ``keep_identified`` drops only texts without a letter; null ids count as the empty text in the fold (held out);
repeated rows agree; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlark.llm.common import bound_batches, used_worker

SAMPLE_ROWS = 2_000
SLICE = 64
COVER, MOST = 0.9, 40_000
ROWS_LOG2, HASHES = 20, 3
GRAM = 4
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
_ASCII_LETTER = re.compile("[A-Za-z]")
#: Everything in ASCII that is no letter becomes a blank; bytes of longer characters stay.
_LETTERS = np.array([b if chr(b).isalpha() or b >= 128 else 32 for b in range(256)], np.uint8)


def grams(text: str) -> np.ndarray:
    """Four-byte grams of the lower-cased text between blanks, at most half of each blank."""
    raw = _LETTERS[np.frombuffer(f"  {text.lower()}  ".encode("utf-8", "surrogatepass"), np.uint8)]
    word = raw.astype(np.uint32)
    out = word[:-3] | word[1:-2] << np.uint32(8) | word[2:-1] << np.uint32(16) | word[3:] << np.uint32(24)
    blank = (raw == 32).astype(np.uint8)
    return out[blank[:-3] + blank[1:-2] + blank[2:-1] + blank[3:] <= 2]


def _slots(values: np.ndarray) -> list[np.ndarray]:
    mixed = values ^ values >> np.uint32(15)
    return [(mixed * np.uint32(m)) >> np.uint32(32 - ROWS_LOG2) for m in _MULTIPLIERS[:HASHES]]


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


@dataclass
class LanguageFilters:
    languages: list[str]  # the most training rows first
    tables: list[np.ndarray]  # of each slice of languages, one mask for each row
    false_rate: np.ndarray
    cover: np.ndarray

    @classmethod
    def learn(cls, found: dict[str, tuple[np.ndarray, float]]) -> LanguageFilters:
        """``found``: each language's n-grams and the share of its occurrences that they cover."""
        kind = np.uint8 if len(found) <= 8 else np.uint64
        tables = [np.zeros(1 << ROWS_LOG2, kind) for _ in range(0, max(1, len(found)), SLICE)]
        for k, (values, _) in enumerate(found.values()):
            for slot in _slots(values):
                tables[k // SLICE][slot] |= kind(1 << k % SLICE)
        fill = np.array([float((tables[k // SLICE] >> kind(k % SLICE) & kind(1)).mean()) for k in range(len(found))])
        return cls(list(found), tables, fill**HASHES, np.array([max(c, 1e-9) for _, c in found.values()]))

    @property
    def table(self) -> np.ndarray:
        """The first slice."""
        return self.tables[0]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        values = grams(text)
        if not len(values):
            return self.languages[0], 0.0
        slots = _slots(values)
        masks = [np.bitwise_and.reduce([table[s] for s in slots]) for table in self.tables]
        if self.table.dtype == np.uint8:
            every = np.bincount(masks[0], minlength=256)
            hits = np.array([every[np.arange(256) >> b & 1 == 1].sum() for b in range(len(self.languages))])
        else:
            hits = np.array([int((masks[b // SLICE] >> np.uint64(b % SLICE) & np.uint64(1)).sum()) for b in range(len(self.languages))])
        share = (hits / len(values) - self.false_rate) / (1 - self.false_rate)
        share = np.clip(share / self.cover, 0.0, 1.0)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best])


def held_out(doc_id: Column) -> Column:
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % 5 == 0


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageFilters:
    """Filters from the labelled rows of ``docs`` (doc_id, text, lang) outside the held-out fold."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageFilters.learn({})
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_rows / n)))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.filter(F.col("text").isNotNull() & (draw < rate[F.col("lang")])).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                values, n = np.unique(np.concatenate([grams(x) for x in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": values.astype(np.int64), "n": n})

    counted = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counted.select(
        "lang", "gram", F.row_number().over(by).alias("rank"), before.alias("before"), "n",
        F.sum("n").over(Window.partitionBy("lang")).alias("every"),
    )
    kept = ranked.filter((F.col("rank") <= MOST) & (F.col("before") < COVER * F.col("every"))).toPandas()
    found = {}
    for lang in sorted(sizes, key=lambda k: (-sizes[k], k)):
        own = kept[kept["lang"] == lang]
        cover = float(own["n"].sum() / own["every"].iloc[0]) if len(own) else 1.0
        found[lang] = own["gram"].to_numpy(np.int64).astype(np.uint32), cover
    return LanguageFilters.learn(found)


def predicted(docs: DataFrame, model: LanguageFilters) -> Column:
    """struct(lang_pred, score) of column ``text``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        used_worker()
        return pd.DataFrame([held.value.predict(x) for x in texts], columns=["lang_pred", "score"])

    return of(F.col("text"))


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``, learned from ``docs``."""
    model = learn(docs, sample_rows)
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(docs, model).alias("_p")
    ).select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def keep_identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a language, or a letter if none was learned."""
    model = learn(docs, sample_rows)
    if not model.languages:
        return docs.filter(F.udf(has_letter, "boolean")("text"))
    found = predicted(docs, model)
    return docs.filter(found["lang_pred"] != "und")
