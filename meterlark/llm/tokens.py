"""Token ids in binary files: range-partitioned shards, a wavelet matrix each.

Documents are range-partitioned and sorted by doc_id; each partition's ids make one shard, or several of
about ``SHARD_IDS`` ids cut at document ends (a longer document has a shard to itself), so a task holds one
shard. A shard is one wavelet matrix with its directories in the file, and its documents' ids and
lengths. ``read_token_files`` gives each document's ids back; ``token_count``, ``token_places`` and
``tokens_at`` answer from rank, select and access and inflate just the blocks they meet.

Where the tokenizer never joins text across white space (``PieceEncoder.by_words`` finds out), words are
tokenized once per worker and looked up after that; with any other tokenizer whole texts are encoded.

Defined results: null text is empty (its ids are the end id alone); null doc_id sorts first; repeated
rows each get ids of their own, ties in doc_id are ordered by a hash of the text; an empty table
gives no files and an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlark.llm.common import bound_batches, gathered, partitions, used_worker
from meterlark.llm.wavelet import WaveletMatrix
from meterlark.session import scratch_path

SHARD_IDS = 1 << 22
#: Pieces, and parts of pieces, that a worker remembers; longer pieces than this many characters are not remembered.
CACHE_PIECES, CACHE_CHARS = 300_000, 64
#: Bytes of text that are split at once.
BATCH_BYTES = 16 << 20

FILE_SCHEMA = "part int, base long, n_docs int, n_ids long, docs binary, ids binary"
FILE_NAMES = ["part", "base", "n_docs", "n_ids", "docs", "ids"]
FILE_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


class PieceEncoder:
    """Token ids of whole texts, by the tokenizer at ``path``, with each piece encoded once.

    Texts are cut at ASCII white space and the cuts numbered by Arrow; Python sees distinct pieces.
    A new ASCII piece is put together from its own parts: the tokenizer's splitting pattern cuts ASCII
    into contractions, letters, single digits and runs of other characters. A run of Latin letters
    goes to the tokenizer's model directly, as normalizing changes nothing but its case; whatever
    else there is, special tokens included, passes all of its steps.
    """

    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
    #: A Latin word, any case, and the marks that may follow it.
    LATIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str, end_id: int, pieces: int = CACHE_PIECES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.end_id, self.most = self.tokenizer.model, end_id, pieces
        # What the tokenizer makes of each Latin letter; letters that it doesn't map one by one aren't listed.
        letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
        self.letters = {ord(c): self._steps(c)[0] for c in letters}
        self.plain = all(
            self._steps(x) == [x.translate(self.letters)] for x in ("".join(letters), "".join(letters[::-1]))
        ) and self._steps("don't stop, 42!") == ["don", "'t", "stop", ",", "4", "2", "!"]
        self.by_words = self._splits_at_space()
        self.parts: dict[str, bytes] = {}
        self._forget()

    def _steps(self, piece: str) -> list[str]:
        if self.tokenizer.normalizer is not None:
            piece = self.tokenizer.normalizer.normalize_str(piece)
        if self.tokenizer.pre_tokenizer is None:
            return [piece]
        return [word for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)]

    def _splits_at_space(self) -> bool:
        """Whether a text's ids are its words' ids in a row, whatever white space is between them."""
        config = json.loads(self.tokenizer.to_str())
        for token in config.get("added_tokens") or ():
            if token.get("lstrip") or token.get("rstrip") or re.search(r"\s", token["content"]):
                return False
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        words = ["a", "Word", "42", "!?", "don't", "\u0301e", "\u00e9t\u00e9", "\u4e2d\u6587", "\u0627\u0644", "\ud55c", "\U0001f600", "x_y", "..", "'s", "</w>", "\u2581"]
        alone = {w: ids(w) for w in words}
        if any(ids(f"{space}{w}{space}") != alone[w] for w in words for space in (" ", "\n", "\t", "\x0b", "\x0c", "\r\n", "  ")):
            return False
        return all(ids(f"{a}{space}{b}") == alone[a] + alone[b] for a in words for b in words for space in (" ", "\n", "\t", "   ", "\r\n", "\x0b\x0c"))

    def _forget(self) -> None:
        self.place = {"": 0}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.lens = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.size, self.known = 0, 1

    @staticmethod
    def _room(values: np.ndarray, n: int) -> np.ndarray:
        return values if n <= len(values) else np.concatenate([values, np.zeros(n, values.dtype)])

    def _part(self, piece: str) -> bytes:
        """Ids of what the splitting pattern leaves whole, or of a piece that isn't cut here."""
        found = self.parts.get(piece)
        if found is None:
            if piece.isalpha() and self.LATIN.fullmatch(piece):
                ids = [t.id for t in self.model.tokenize(piece.translate(self.letters))]
            else:
                ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
            found = array("I", ids).tobytes()
            if len(piece) <= CACHE_CHARS:
                self.parts[piece] = found
        return found

    def _code(self, piece: str) -> bytes:
        if self.plain and "<|" not in piece:
            if piece.isascii():
                return b"".join(map(self._part, self.ASCII.findall(piece.lower())))
            if latin := self.LATIN.fullmatch(piece):
                return self._part(latin[1].lower()) + (self._part(latin[2]) if latin[2] else b"")
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _places(self, pieces: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Where the ids of each piece are; new ones that occur again are remembered."""
        if self.known > self.most:
            self._forget()
        if len(self.parts) > self.most:
            self.parts.clear()
        out = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int32, len(pieces))
        lack = np.flatnonzero(out < 0)
        # what occurs once here goes behind the rest, where the next batch overwrites it
        lack = lack[np.argsort(counts[lack] < 2, kind="stable")]
        often = int((counts[lack] >= 2).sum())
        new = pieces[lack].tolist()
        codes = list(map(self._code, new))
        lens = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        ids, end = np.frombuffer(b"".join(codes), np.uint32), self.known + len(new)
        self.flat = self._room(self.flat, self.size + len(ids))
        self.flat[self.size : self.size + len(ids)] = ids
        self.starts, self.lens = self._room(self.starts, end), self._room(self.lens, end)
        self.lens[self.known : end] = lens
        self.starts[self.known : end] = self.size + np.cumsum(lens) - lens
        out[lack] = np.arange(self.known, end)
        self.place.update((p, self.known + k) for k, p in enumerate(new[:often]) if len(p) <= CACHE_CHARS)
        self.size, self.known = self.size + int(lens[:often].sum()), self.known + often
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the number of ids of each text."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.by_words:
            each = [np.array([*self.tokenizer.encode(x.as_py(), add_special_tokens=False).ids, self.end_id], np.uint32) for x in texts]
            return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
        cut = pc.ascii_split_whitespace(texts)
        named = cut.flatten().dictionary_encode()
        ends = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        codes = named.indices.to_numpy()
        pieces = named.dictionary.to_numpy(zero_copy_only=False)
        at = self._places(pieces, np.bincount(codes, minlength=len(pieces)))[codes]
        lens = self.lens[at]
        upto = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        kind = np.int32 if upto[-1] + self.size < 1 << 31 else np.int64
        place = np.repeat((self.starts[at] - upto[:-1]).astype(kind), lens)
        place += np.arange(len(place), dtype=kind)
        ids, stops = self.flat[place], upto[ends]
        return np.insert(ids, stops[1:], np.uint32(self.end_id)), np.diff(stops) + 1


_encoders: dict = {}


def _encoder(path: str, end_id: int, pieces: int) -> PieceEncoder:
    """This worker's encoder; it serves all tasks that follow closely on one another."""
    key = path, end_id, pieces
    if key not in _encoders:
        _encoders[key] = PieceEncoder(path, end_id, pieces)
    return _encoders[key]


def _pack_docs(ids: list, lens: np.ndarray) -> bytes:
    known = np.array([x is not None for x in ids], bool)
    return (
        struct.pack("<I", len(ids))
        + np.packbits(known, bitorder="little").tobytes()
        + np.array([x or 0 for x in ids], "<i8").tobytes()
        + np.asarray(lens, "<i8").tobytes()
    )


def _unpack_docs(data: bytes) -> tuple[list, np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    at = 4 + (n + 7) // 8
    known = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, 4), count=n, bitorder="little")
    ids = np.frombuffer(data, "<i8", n, at).tolist()
    return [i if k else None for i, k in zip(ids, known.tolist())], np.frombuffer(data, "<i8", n, at + 8 * n)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, pieces: int = CACHE_PIECES, batch: int = BATCH_BYTES, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all texts of ``docs`` (doc_id, text), in ascending doc_id order, to ``path``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, base = TaskContext.get().partitionId(), _encoder(tokenizer, end_id, pieces), 0
        docs_in, lens_in, ids_in, held = [], [], [], 0

        def take(of: list, lens: np.ndarray, ids: np.ndarray) -> None:
            docs_in.extend(of)
            lens_in.extend(lens.tolist())
            ids_in.append(ids)

        def block() -> pa.RecordBatch:
            nonlocal docs_in, lens_in, ids_in, held, base
            ids = np.concatenate(ids_in)
            row = [part, base, len(docs_in), len(ids), _pack_docs(docs_in, np.array(lens_in)), WaveletMatrix.build(ids).to_bytes()]
            base += len(ids)
            docs_in, lens_in, ids_in, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, FILE_TYPES)], FILE_NAMES)

        for arrow in gathered(batches, batch):
            doc_ids = arrow.column(0).to_pylist()
            # texts of up to about BATCH_BYTES at once
            sizes = np.cumsum(pc.binary_length(arrow.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)) // batch
            cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(sizes)) + 1, len(doc_ids)])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                ids, lens = encoder.encode(arrow.column(1).slice(a, b - a))
                upto, first = np.concatenate([[0], np.cumsum(lens)]), 0
                for k in range(b - a):
                    if held and held + lens[k] > shard_ids:
                        take(doc_ids[a + first : a + k], lens[first:k], ids[upto[first] : upto[k]])
                        yield block()
                        first = k
                    held += int(lens[k])
                take(doc_ids[a + first : b], lens[first:], ids[upto[first] :])
        if docs_in:
            yield block()
        del encoder
        used_worker(_encoders.clear)

    n = partitions(docs.sparkSession)
    bound_batches(docs.sparkSession)
    (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        # the last key only lets a range end between rows that are equal in all else
        .withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
        .repartitionByRange(n, "doc_id", "tie", "place")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(write, FILE_SCHEMA)
        .write.option("compression", "uncompressed")
        .parquet(path)
    )


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``offset``, the ids of all shards before."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One row per file: bounded by the number of partitions written.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return files.join(F.broadcast(offsets), "part").withColumn("offset", F.col("before") + F.col("base")).drop("before")


def read_token_files(spark: SparkSession, path: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_end_ids) of every document in the files at ``path``.

    ``n_end_ids``, by rank, is 1 unless the text's own ids hold the end id.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                doc_ids, lens = _unpack_docs(row.docs)
                matrix = WaveletMatrix.from_bytes(row.ids)
                ids = matrix.decode().astype("<u4")
                upto = np.concatenate([[0], np.cumsum(lens)])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(doc_ids, "Int64"),
                        "start": row.offset + upto[:-1],
                        "n_tokens": lens,
                        "ids_crc32": crc,
                        "n_end_ids": np.diff(matrix.ranks(end_id, upto)),
                    }
                )
        used_worker()

    rows = _shards(spark, path).select("offset", "docs", "ids")
    return rows.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, n_end_ids long")


def token_count(spark: SparkSession, path: str, token: int) -> int:
    """How often the files hold a token, by rank."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"n": [WaveletMatrix.from_bytes(x).count(token) for x in pdf["ids"]]})

    return _shards(spark, path).select("ids").mapInPandas(count, "n long").agg(F.sum("n")).first()[0] or 0


def token_places(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, at, position): every occurrence of a token, in its document and in all ids, by select."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                doc_ids, lens = _unpack_docs(row.docs)
                upto = np.concatenate([[0], np.cumsum(lens)])
                at = np.array(WaveletMatrix.from_bytes(row.ids).occurrences(token), np.int64)
                doc = np.searchsorted(upto, at, "right") - 1
                yield pd.DataFrame({"doc_id": pd.array([doc_ids[k] for k in doc], "Int64"), "at": at - upto[doc], "position": row.offset + at})

    return _shards(spark, path).select("offset", "docs", "ids").mapInPandas(find, "doc_id long, at long, position long")


def tokens_at(positions: DataFrame, path: str) -> DataFrame:
    """(position, token) for the rows of ``positions`` (position), by access; places out of range have no row."""
    shards = _shards(positions.sparkSession, path)
    spans = F.broadcast(shards.select("part", "base", "offset", "n_ids"))  # a row per shard
    inside = (F.col("position") >= F.col("offset")) & (F.col("position") < F.col("offset") + F.col("n_ids"))
    asked = positions.select("position").distinct().join(spans, inside).groupBy("part", "base").agg(F.collect_list("position").alias("p"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                matrix = WaveletMatrix.from_bytes(row.ids)
                yield pd.DataFrame({"position": row.p, "token": [matrix.access(int(x - row.offset)) for x in row.p]})

    return shards.join(asked, ["part", "base"]).select("offset", "ids", "p").mapInPandas(look, "position long, token long")


def token_digest(
    docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, pieces: int = CACHE_PIECES, batch: int = BATCH_BYTES, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Write the token files (below the shared folder unless ``path`` is given) and read them back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id, pieces, batch, shard_ids)
    return read_token_files(spark, path, end_id)
