"""Token ids in Parquet: a list column, with counts and places beside it, in ascending order of the documents.

The file format: one row per document with ``doc_id``, ``part`` (the number of its file in order), ``row_start`` (ids of the
earlier documents of that file), ``n_tokens`` (with the end id) and ``tokens`` (array<int>). Ids are dictionary-encoded and
so bit-packed; the other columns are delta-encoded (format version 2). Row groups and pages are kept small enough for the
page index to skip: a few documents, or the metadata of all, can be read without the rest.

Every distinct piece of a block is encoded by the model of the tokenizers library, many in one call; texts are put together from
these, as byte-level BPE never merges across pieces (``pretoken``). Texts that hold an added token's content, which may
reach over pieces, are encoded by the library whole.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import pretoken, wordhash
from .common import scratch, slices

#: Distinct pieces whose ids a worker keeps, their characters, and slots to find them; then those not found again since go. Bounds memory only, never results.
CACHE_PIECES, CACHE_CHARS, SLOT_BITS = 500_000, 16_000_000, 21
BLOCK_CHARS = 500_000
SCHEMA = "doc_id long, part int, row_start long, n_tokens int, tokens array<int>"
WRITE = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#row_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _written(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` from place n on, in a larger array if there is no room."""
    if n + len(more) > len(held):
        held = np.concatenate((held[:n], np.zeros(max(n, len(more)), held.dtype)))
    held[n : n + len(more)] = more
    return held


class Pieces:
    """Pieces and their ids in arrays, found by a 64-bit hash with open addressing; a piece found is compared character by character."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.slot, self.n, self.n_chars, self.n_ids = np.full(1 << SLOT_BITS, -1, np.int32), 0, 0, 0
        self.hash, self.used = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.chars, self.char_start, self.char_size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.id_start, self.id_size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return self.n

    def _first(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray, code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entry of each piece (a span of ``code``): -1 if its hash is not there, -2 if the hash is that of another piece."""
        out = np.full(len(hashes), -1, np.int64)
        at, left = self._first(hashes), np.arange(len(hashes) if len(self) else 0)
        while left.size:
            entry = self.slot[at[left]]
            hit = (entry >= 0) & (self.hash[entry] == hashes[left])
            out[left[hit]] = entry[hit]
            left = left[(entry >= 0) & ~hit]
            at[left] = (at[left] + 1) & ((1 << SLOT_BITS) - 1)
        held = np.flatnonzero(out >= 0)
        same = self.char_size[out[held]] == sizes[held]
        out[held[~same]] = -2
        held = held[same]
        if held.size:
            n = sizes[held]
            other = self.chars[_spans(self.char_start[out[held]], n)] != code[_spans(starts[held], n)]
            if other.any():
                out[held[np.logical_or.reduceat(other, np.cumsum(n) - n)]] = -2
        return out

    def add(self, hashes: np.ndarray, code: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """New entries, after all others; the hash of each finds one of those that have it."""
        base = self.n
        self.char_start = _written(self.char_start, base, self.n_chars + np.cumsum(sizes) - sizes)
        self.id_start = _written(self.id_start, base, self.n_ids + np.cumsum(counts) - counts)
        self.char_size, self.id_size = _written(self.char_size, base, sizes), _written(self.id_size, base, counts)
        self.chars, self.ids = _written(self.chars, self.n_chars, code[_spans(starts, sizes)]), _written(self.ids, self.n_ids, ids)
        self.hash, self.used = _written(self.hash, base, hashes), _written(self.used, base, np.zeros(len(hashes), bool))
        self.n, self.n_chars, self.n_ids = base + len(hashes), self.n_chars + int(sizes.sum()), self.n_ids + len(ids)
        self._settle(base)
        return np.arange(base, self.n)

    def _settle(self, base: int) -> None:
        at, left = self._first(self.hash[base : self.n]), np.arange(self.n - base)
        while left.size:
            free = left[self.slot[at[left]] < 0]
            self.slot[at[free]] = base + free  # of several, one gets it
            left = left[self.slot[at[left]] != base + left]
            at[left] = (at[left] + 1) & ((1 << SLOT_BITS) - 1)

    def trim(self) -> None:
        """Beyond the bounds, what was found since the last time is kept, or nothing if that is more than half."""
        if self.n <= CACHE_PIECES and self.n_chars <= CACHE_CHARS:
            return
        kept = np.flatnonzero(self.used[: self.n])
        if 2 * len(kept) > CACHE_PIECES or 2 * self.char_size[kept].sum() > CACHE_CHARS:
            return self.clear()
        held = self.hash[kept], self.chars, self.char_start[kept], self.char_size[kept], self.ids[_spans(self.id_start[kept], self.id_size[kept])], self.id_size[kept]
        self.clear()
        self.add(*held)
        self.used[:] = False


class LibraryEncoder:
    """Encodes texts by a tokenizers file, adding no special tokens; keeps the ids of pieces it has seen."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        own = self.tokenizer.pre_tokenizer
        self.by_piece = isinstance(own, ByteLevel) and not own.add_prefix_space and own.use_regex and self.tokenizer.normalizer is None
        if self.by_piece:
            alphabet = ByteLevel.alphabet()
            names = self.tokenizer.get_vocab()
            if not set(alphabet) <= set(names) or any(not t.special and " " in t.content for t in added):
                self.by_piece = False
            self.width = np.ones(max(names.values()) + 1, np.int64)
            for name, i in names.items():
                self.width[i] = len(name)  # one character of a name stands for one byte
            #: The library's model alone, for pieces that are written in the alphabet already, with blanks between.
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = CharDelimiterSplit(" ")
            self.letters = byte_letters()
        self.pieces = Pieces()

    def learn(self, code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces (spans of ``code``) one after the other, and how many each has; one call of the library takes all."""
        chars = code[_spans(starts, sizes)]
        raw = np.frombuffer(chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace"), np.uint8)
        width = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        width[(chars >= 0xD800) & (chars < 0xE000)] = 1  # half of a pair: a question mark
        ends = np.cumsum(np.add.reduceat(width, np.cumsum(sizes) - sizes))
        letters = np.full(len(raw) + len(ends), 32, "<u2")
        letters[np.arange(len(raw)) + np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))] = self.letters[raw]
        written = letters.tobytes().decode("utf-16-le")
        stops = ends + np.arange(len(ends))  # of each piece, the blank after it
        cuts = [*stops[:-1][np.diff(stops // 20_000) > 0].tolist(), int(stops[-1])]
        found = self.model.encode_batch_fast([written[a:b] for a, b in zip([0, *[c + 1 for c in cuts]], cuts)], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, "<u4") for x in found])
        at = np.cumsum(self.width[ids])
        cuts = np.searchsorted(at, ends) + 1
        if cuts[-1] != len(ids) or not np.array_equal(at[cuts - 1], ends):
            raise ValueError("the ids of a piece do not spell it: this vocabulary is not a byte-level one")
        return ids, np.diff(cuts, prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        if not self.by_piece:
            return self.whole(texts)
        held = [i for i, t in enumerate(texts) if any(c in t for c in self.added)]
        if held:
            rest = list(texts)
            for i in held:
                rest[i] = ""
            out = self.encode_plain(rest)
            for i, raw in zip(held, self.whole([texts[i] for i in held])):
                out[i] = raw
            return out
        return self.encode_plain(texts)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Of texts without added tokens: each distinct piece of a block is looked up once, and ids are put together by array operations."""
        out: list[bytes] = []
        held = self.pieces
        for a, b in slices([len(t) for t in texts], BLOCK_CHARS):
            joined, bounds, index = pretoken.piece_bounds(texts[a:b])
            if len(bounds) < 2:
                out += [b""] * (b - a)
                continue
            first, place, hashes, code = distinct_pieces(joined, bounds)
            starts, size = bounds[first], np.diff(bounds)[first]
            entry = held.find(hashes, code, starts, size)
            held.used[entry[entry >= 0]] = True
            new = np.flatnonzero(entry < 0)
            if new.size:
                entry[new] = held.add(hashes[new], code, starts[new], size[new], *self.learn(code, starts[new], size[new]))
            size = held.id_size[entry]
            ids = held.ids[_spans(held.id_start[entry], size)]
            held.trim()
            sizes = size[place]
            ends = np.cumsum(sizes)
            every = ids[_spans((np.cumsum(size) - size)[place], sizes)]
            cuts = np.concatenate(([0], ends))[index].tolist()
            out += [every[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]
        return out


def byte_letters() -> np.ndarray:
    """The letter of each byte in the byte-level alphabet: visible ones of Latin-1 stand for themselves, the others come from 256 on."""
    visible = np.isin(np.arange(256), [*range(33, 127), *range(161, 173), *range(174, 256)])
    return np.where(visible, np.arange(256), 255 + np.cumsum(~visible)).astype("<u2")


def distinct_pieces(joined: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of the first piece of each kind, for each piece which kind it is, the hash of each kind, and the code points. Pieces of one 64-bit hash are compared character by character."""
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    powers, inverse = wordhash._powers(max(18, (len(code) + 1).bit_length()))
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * powers[: len(code)], out=total[1:])
    starts, size = bounds[:-1], np.diff(bounds)
    hashes = wordhash.mix((total[bounds[1:]] - total[starts]) * inverse[starts])
    _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    kind = first[place]
    same = (size == size[kind]).all()
    if same:
        moved = np.repeat(starts[kind] - starts, size)
        same = np.array_equal(code, code[np.arange(len(code)) + moved])
    if not same:  # two kinds of one hash
        held: dict[str, int] = {}
        at = bounds.tolist()
        place = np.array([held.setdefault(joined[i:j], len(held)) for i, j in zip(at, at[1:])])
        first = np.unique(place, return_index=True)[1]
    return first, place, hashes[first], code


@functools.cache
def encoder(path: str | None) -> LibraryEncoder:
    import public_tokenizers

    return LibraryEncoder(path or public_tokenizers.path("byte_bpe_50k.json"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Encode all documents and write them below ``path`` in ascending order of their ids.

    A null text counts as the empty text: its only id is the end id. A null id comes first. Rows of the same id stay
    and follow each other in the order in which the table gives them. Further columns are not carried; an empty table
    gives files without rows. One shuffle, by ranges of the id and a running number, so that rows of one id, or without
    any, go to as many tasks as they need; the texts are read once.
    """
    spark = docs.sparkSession
    schema = "doc_id long, part int, row_start long, n_tokens int, tokens array<int>"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        enc, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], 4 * BLOCK_CHARS):
                raw = [x + end for x in enc.encode(texts[a:b])]
                counts = np.array([len(x) // 4 for x in raw], np.int64)
                ends = np.cumsum(counts)
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                tokens = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.full(b - a, part, np.int32)), pa.array(start + ends - counts), pa.array(counts.astype(np.int32)), tokens], ["doc_id", "part", "row_start", "n_tokens", "tokens"])
                start += int(ends[-1])

    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    rows.select("doc_id", "text").mapInArrow(run, schema).write.options(**WRITE).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written; filters on doc_id reach the page index, and columns that are not selected are not read."""
    return spark.read.schema(SCHEMA).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, start, n_tokens: the place of each document's ids in the sequence of all; the ids are not read.

    Totals of the parts are summed up, one row for each file, so the one window without a key stays small.
    """
    rows = read_tokens(spark, path).drop("tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    return rows.join(sums, "part").select("doc_id", "part", (F.col("part_start") + F.col("row_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit integers), read from the files."""
    rows = read_tokens(spark, path)

    def run(batches):
        for batch in batches:
            tokens = batch.column(3)
            values = tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            cuts = tokens.offsets.to_numpy().tolist()
            view = memoryview(np.ascontiguousarray(values)).cast("B")
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(cuts).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "part", "row_start", "n_tokens", "ids_crc32"])

    sums = rows.select("doc_id", "part", "row_start", "tokens").mapInArrow(run, "doc_id long, part int, row_start long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    return sums.join(F.broadcast(totals), "part").select("doc_id", (F.col("part_start") + F.col("row_start")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to the shared folder and return ``checksums`` of the files."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return checksums(spark, path)
