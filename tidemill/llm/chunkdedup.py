"""Substring dedup by content-defined chunks: every passage of ``min_words`` words or more that two documents share byte by byte.

Words are runs of bytes without white space; a passage goes from the first letter or digit of its first word to the last
one of its last word, so that signs around it do not matter. A gear hash rolls over the bytes: shifted by one bit a byte,
its 32 bits know the last 32 bytes and nothing else. Cuts are the word ends at which the gear hash is least within reach:
the cut of a window of ``min_words`` words is the least of its word ends whose 32 bytes lie in the window, so it depends
on nothing outside, and an insertion moves no other cut. A cut is named by the hash of the half of a window before it,
or after it for windows that hold no half before it. Windows that follow each other mostly share a cut and its name;
together they are a chunk, which varies in size, overlaps its neighbours by a window less a word, and has the hash of all
its bytes as digest. So every window lies whole in one chunk, and a repeated window has the same cut wherever it stands.

Chunks are counted by cut and digest. Where all chunks of a cut in two documents have one digest, all their windows are
repeated; where digests differ, an exact check compares their windows one by one. Repeated windows that follow each other
are a passage, whose length is exact. Nothing is missed and, but for collisions of 64-bit hashes, nothing is added.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from . import wordhash
from .common import join_counted, slices, spill_table

MIN_WORDS = 50
BLOCK_CHARS = 500_000
#: A row ends after so many windows, or before a word of so many bytes; bounds the packed places only, never results.
ROW_WINDOWS, ROW_STEP = 32, 1_000
#: Power of two of the 64-bit slots of ``bits`` (16 MB); bounds what is broadcast, and only spares the join rows it would drop.
SLOTS = 21


#: Bytes that the gear hash knows.
REACH = 32


@functools.cache
def gears() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, h = (h << 1) + gear[byte] in 32 bits, of all bytes at once by doubling."""
    out, held = gears()[data], 1
    while held < REACH:
        out[held:] += out[:-held].copy() << np.uint32(held)
        held *= 2
    return out


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low[i] : high[i] + 1]`` for each i, from the least of all stretches of a power of two."""
    length = high - low + 1
    power = np.frexp(length)[1] - 1
    out, held = np.empty(len(low), values.dtype), values
    for k in range(int(power.max(initial=0)) + 1):
        own = np.flatnonzero(power == k)
        out[own] = np.minimum(held[low[own]], held[high[own] - (1 << k) + 1])
        if len(held) > 1 << k:
            held = np.minimum(held[: -(1 << k)], held[1 << k :])
    return out


@functools.cache
def _blanks() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[[9, 10, 11, 12, 13]] = 32
    return out


def _flat(text: str) -> np.ndarray:
    """The UTF-8 bytes of a text, with one blank for each run of white space."""
    data = _blanks()[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    return data[np.concatenate(([True], (data[1:] != 32) | (data[:-1] != 32)))] if len(data) else data


def _copy(data: np.ndarray) -> int:
    """A hash of a whole text, that tells texts of one id apart."""
    return int(np.array(xxhash.xxh3_64_intdigest(data.tobytes()) & 0xFFFFFFFF, np.uint32).view(np.int32))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin, and where their first letter or digit is and their last one ends (the whole word, if it has none)."""
    edge = np.flatnonzero(np.diff(data != 32, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    signs = np.flatnonzero(wordhash.word_bytes()[data])
    a, z = np.searchsorted(signs, starts), np.searchsorted(signs, ends)
    some = a < z
    first, last = starts.copy(), ends.copy()
    first[some], last[some] = signs[a[some]], signs[z[some] - 1] + 1
    return starts, first, last


def bits(marks: DataFrame) -> np.ndarray:
    """A bit for each mark, by its lower bits; of bounded size, so marks that share a bit are not told apart: this spares rows, and decides nothing."""
    slot, bit = F.col("mark").bitwiseAND((1 << SLOTS) - 1).cast("int"), F.shiftright("mark", SLOTS).bitwiseAND(63).cast("int")
    found = marks.select(slot.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << SLOTS, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.view(np.uint64)


def among(held: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether ``bits`` has a bit for each mark."""
    return (held[marks & np.uint64((1 << SLOTS) - 1)] >> (marks >> np.uint64(SLOTS) & np.uint64(63)) & np.uint64(1)).astype(bool)


def marked(docs: DataFrame, min_words: int = MIN_WORDS, wanted=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark, span: the chunks; ``mark`` names the cut by the words at it, ``span`` is the digest of the chunk.

    A chunk of more than ``ROW_WINDOWS`` windows is several rows. With ``wanted``, a broadcast pair of ``bits``, only
    rows whose mark may be in the first, as doc_id, mark, copy, word, n,
    start, end, reach, hashes, steps: ``copy`` is a hash of the whole text, ``word`` the number of the first word, ``n``
    the number of windows; the first window stands from ``start`` to ``end``, the last one ends at ``reach``, in UTF-8
    bytes of the text in which any run of white space counts as one blank. Where the mark may be in the second, each
    window has its hash in ``hashes`` and in ``steps`` how far it begins and ends after the first. Null texts, and rows
    without an id, have none.
    """
    if 2 * min_words - 1 < REACH:
        raise ValueError("windows have to be as long as the gear hash's reach")

    def block(ids, texts):
        raw = [_flat(text) for text in texts]
        begin = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
        data = np.concatenate([x for r in raw for x in (r, _blanks()[32:33])])
        starts, first, last = _words(data)
        n = len(starts) - min_words + 1
        if n <= 0:
            return None
        powers, inverse = wordhash._powers(max(16, (len(data) + 1).bit_length()))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(wordhash.byte_values()[data] * powers[: len(data)], out=total[1:])
        stretch = lambda a, z: wordhash.mix((total[z] - total[a]) * inverse[a])
        text_of = np.searchsorted(begin, starts, side="right") - 1
        whole = text_of[:n] == text_of[min_words - 1 :]
        # of word ends of one gear hash the first is the cut; what names it is the half of a window before or after it
        place = np.arange(len(starts))
        ends = gear_hashes(data)[last - 1].astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)
        high = place[:n] + min_words - 1
        cut = (least_between(ends, np.minimum(np.searchsorted(last, first[:n] + REACH), high), high) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        half = min_words // 2
        before = cut - place[:n] >= half - 1
        low, high = np.where(before, cut - half + 1, cut), np.where(before, cut, cut + half - 1)
        mark = stretch(first[low], last[high]) ^ np.where(before, np.uint64(0), np.uint64(0x9FB21C651E98DF25))
        a, z = first[:n], last[min_words - 1 :]
        ahead = np.ones(n, bool)  # begins a row
        ahead[1:] = (mark[1:] != mark[:-1]) | (text_of[1:n] != text_of[: n - 1]) | (np.diff(a) > ROW_STEP) | (np.diff(z) > ROW_STEP)
        ahead = ahead[whole]
        at = np.flatnonzero(whole)
        if not len(at):
            return None
        head = np.flatnonzero(ahead)
        since = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
        head = np.flatnonzero(since % ROW_WINDOWS == 0)
        cuts = np.append(head, len(at))
        i, j = at[head], at[cuts[1:] - 1]
        ids = np.asarray(ids, np.int64)
        if wanted is None:
            return pa.RecordBatch.from_arrays([pa.array(ids[text_of[i]]), pa.array(mark[i].view(np.int64)), pa.array(stretch(a[i], z[j]).view(np.int64))], ["doc_id", "mark", "span"])
        some, apart = wanted.value
        keep = among(some, mark[i])
        counts = np.diff(cuts)
        at = at[np.repeat(keep, counts)]
        i, j, counts = i[keep], j[keep], counts[keep]
        each = among(apart, mark[i])
        of, base = at[np.repeat(each, counts)], np.repeat(i[each], counts[each])
        steps = (a[of] - a[base]) << 16 | (z[of] - z[base])
        offsets = pa.array(np.concatenate(([0], np.cumsum(np.where(each, counts, 0)))).astype(np.int32))
        copies = np.array([_copy(r) for r in raw], np.int32)
        doc = text_of[i]
        places = (i - np.searchsorted(starts, begin)[doc], counts, a[i] - begin[doc], z[i] - begin[doc], z[j] - begin[doc])
        columns = [pa.array(ids[doc]), pa.array(mark[i].view(np.int64)), pa.array(copies[doc]), *(pa.array(x.astype(np.int32)) for x in places)]
        columns += [pa.ListArray.from_arrays(offsets, pa.array(stretch(a[of], z[of]).view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(steps.astype(np.int32)))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "copy", "word", "n", "start", "end", "reach", "hashes", "steps"])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(list(map(len, texts)), BLOCK_CHARS):
                if (found := block(ids[a:b], texts[a:b])) is not None:
                    yield found

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    more = "copy int, word int, n int, start int, end int, reach int, hashes array<long>, steps array<int>"
    return rows.mapInArrow(run, "doc_id long, mark long, " + ("span long" if wanted is None else more))


def _repeated(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, copy, word, n, start, end, low, other_id: runs of windows that another document holds too, ``low`` being the least id that does."""
    low, high, count = F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("rows_of")
    marks = marked(docs, min_words, None, id_col, text_col).groupBy("mark").agg(low, high, count, (F.min("span") == F.max("span")).alias("same")).where("low < high")
    marks = spill_table(marks, "marks")
    wanted = docs.sparkSession.sparkContext.broadcast((bits(marks), bits(marks.where("not same"))))
    other = F.when(F.col("low") == F.col("doc_id"), F.col("high")).otherwise(F.col("low")).alias("other_id")
    again = marked(docs, min_words, wanted, id_col, text_col)
    shared = spill_table(join_counted(again, marks, ["mark"], "rows_of", F.col("doc_id")).select("doc_id", "copy", "word", "n", "start", "end", "reach", "hashes", "steps", "same", "low", other), "marked")
    alike = shared.where("same").select("doc_id", "copy", "word", "n", "start", F.col("reach").alias("end"), "low", "other_id")
    every = shared.where("not same").select("doc_id", "copy", "word", "start", "end", F.posexplode(F.arrays_zip("hashes", "steps")).alias("k", "w"))
    every = every.select("doc_id", "copy", (F.col("word") + F.col("k")).alias("word"), (F.col("start") + F.shiftright("w.steps", 16)).alias("start"), (F.col("end") + F.col("w.steps").bitwiseAND(0xFFFF)).alias("end"), F.col("w.hashes").alias("hash"))
    repeated = every.groupBy("hash").agg(low, high, count).where("low < high")
    single = join_counted(every, repeated, ["hash"], "rows_of", F.col("doc_id")).select("doc_id", "copy", "word", F.lit(1).alias("n"), "start", "end", "low", other)
    return alike.unionByName(single)


def _runs(held: DataFrame, min_words: int) -> DataFrame:
    """Stretches of repeated windows that follow each other, within each document."""
    held = held.repartition("doc_id").dropDuplicates(["doc_id", "copy", "word"])  # one shuffle serves this and the windows
    before = F.sum("n").over(Window.partitionBy("doc_id", "copy").orderBy("word").rowsBetween(Window.unboundedPreceding, -1))
    runs = held.withColumn("run", F.col("word") - F.coalesce(before, F.lit(0)))  # the same for windows that follow each other
    found = runs.groupBy("doc_id", "copy", "run").agg(F.min(F.struct("word", "start", "other_id")).alias("a"), F.max("end").alias("end"), F.sum("n").alias("n"))
    words = (F.col("n") + (min_words - 1)).cast("int")
    return found.select("doc_id", "copy", F.col("a.start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), words.alias("n_words"), F.col("a.other_id").alias("other_id"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, n_words, most_words, other_id: one row for each repeated passage of each document.

    ``start`` and ``end`` are places in the text as in ``marked``; ``n_words`` is the passage's length, and so is
    ``most_words``; ``other_id`` is a document that holds its first ``min_words`` words too, the least of them or, in that
    one, the greatest. Documents without repeated passages have no row: null and empty texts, texts of fewer words, and
    passages that only repeat within one document. Rows without an id are not looked at, as nothing could be said of
    them. Rows that repeat a doc_id count as one document; each of its distinct texts is reported, once. Texts may be of
    any length; an empty table gives no rows; further columns are not carried, whatever their names.

    Chunks and windows are counted by aggregations that combine before the shuffle, so a very common one is a few rows;
    in the joins back its rows are dealt to several tasks. Passages are put together within each document.
    """
    found = _runs(_repeated(docs, min_words, id_col, text_col), min_words)
    return found.select("doc_id", "start", "end", "n_words", F.col("n_words").alias("most_words"), "other_id")


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every passage cut from the text that a document of a lower id holds too. Other columns stay.

    A word goes if some window around it stands in a document of a lower id, so all that is cut is kept somewhere, and
    of each passage the copy of the least id stays. Where a passage went, a line break is left. Texts without any, null
    texts and rows without an id are unchanged; of others each run of white space becomes one blank.
    """
    held = _repeated(docs, min_words, id_col, text_col).where("low < doc_id")
    cuts = _runs(held, min_words).groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    names, at = [f"c{i}" for i in range(len(docs.columns))], docs.columns.index(text_col)  # by place, as any name may be taken
    keyed = docs.toDF(*names).withColumn("id", F.col(names[docs.columns.index(id_col)]).cast("long"))

    def digests(batches):
        for batch in batches:
            yield batch.append_column("own", pa.array([None if t is None else _copy(_flat(t)) for t in batch.column(at).to_pylist()], pa.int32()))

    def cut(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, ranges in enumerate(batch.column(len(names)).to_pylist()):
                if ranges:
                    data, out, reach = _flat(texts[k]).tobytes(), [], 0
                    for r in ranges:
                        out.append(data[reach : r["start"]])
                        reach = max(reach, r["end"])
                    out.append(data[reach:])
                    texts[k] = b"\n".join(out).decode("utf-8", "replace")
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, docs_names)

    docs_names = docs.columns
    rows = keyed.mapInArrow(digests, T.StructType([*keyed.schema.fields, T.StructField("own", T.IntegerType())]))
    both = rows.join(cuts.select(F.col("doc_id").alias("id"), F.col("copy").alias("own"), "cuts"), ["id", "own"], "left")
    return both.select(*names, "cuts").mapInArrow(cut, docs.schema)
