"""Language of texts by hyperdimensional profiles.

Every letter has a random vector of ``SIZE`` signs, drawn from its code point, so all tasks draw the same. The vector of
three letters in a row is the product of their vectors, the first one rotated by two places, the second by one: bound
that way, it is nearly orthogonal to that of any other three. A text's vector is the sum (the bundle) over all its
trigrams, a language's prototype that over all learnt texts of it, and a text gets the language whose prototype has the
largest cosine with it. Signs other than letters are one blank, which counts as a letter, so words have a beginning and an
end; letters are lower-cased.

Trigrams of a block of texts are counted first and each distinct one is bound once, so bundling is one product of a
matrix of counts with one of signs. Sums are whole numbers: prototypes do not depend on the order or the number of tasks.
Prototypes are added up over all learnt rows by Spark, a row for each language and place, and are as many as languages.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices

#: Places of a vector, characters of a block and of a slice of a long text, languages whose sums a task holds at a time.
SIZE, BLOCK_CHARS, HELD = 1024, 200_000, 256
#: Matrices of counts hold at most so many numbers.
CELLS = 4_000_000
NONE = "und"
BLANK = 32


@functools.cache
def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.lru_cache(4096)
def letter_vector(point: int) -> np.ndarray:
    """The signs of a letter, drawn from its code point."""
    return (np.random.Generator(np.random.PCG64([20240229, point])).integers(0, 2, SIZE, np.int8) * 2 - 1).astype(np.int8)


def trigram_vector(a: int, b: int, c: int) -> np.ndarray:
    """Three letters bound: each is rotated by its distance from the last one."""
    return np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)


def spelled(text: str) -> np.ndarray:
    """Code points of the lower-cased text between two blanks, runs of other signs than letters being one blank; empty without a letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    some = letters()[code]
    if not some.any():
        return np.empty(0, np.uint32)
    code = np.concatenate(([BLANK], np.where(some, code, BLANK), [BLANK])).astype(np.uint32)
    return code[(code != BLANK) | np.concatenate(([True], code[:-1] != BLANK))]


def _bound(trigrams: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The vectors of trigrams, which are numbers to the base of the size of the alphabet."""
    own = np.stack([letter_vector(int(c)) for c in alphabet])
    n = len(alphabet)
    return np.roll(own, 2, 1)[trigrams // (n * n)] * np.roll(own, 1, 1)[trigrams // n % n] * own[trigrams % n]


def bundles(codes: list[np.ndarray], rows: list[int], n: int) -> np.ndarray:
    """``n`` vectors: in row ``rows[k]`` the sum over the trigrams of all ``codes[k]``. Each has three letters at least, or none."""
    out = np.zeros((n, SIZE), np.float64)
    sizes = [max(0, len(c) - 2) for c in codes]
    if not sum(sizes):
        return out
    every = np.concatenate([c for c in codes if len(c) > 2])
    seen = np.bincount(every) > 0
    alphabet = np.flatnonzero(seen)
    rank = np.zeros(len(seen), np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    code, k = rank[every], len(alphabet)
    grams = (code[:-2] * k + code[1:-1]) * k + code[2:]
    # the two that reach over the border to the next text are left out
    ends = np.cumsum([s + 2 for s in sizes if s])
    inside = np.ones(len(grams), bool)
    inside[(ends[:-1, None] - np.array([2, 1])).ravel()] = False
    grams = grams[inside]
    if k**3 <= CELLS:
        there = np.bincount(grams, minlength=k**3) > 0
        distinct = np.flatnonzero(there)
        index = np.cumsum(there) - 1
        place = index[grams]
    else:
        distinct, place = np.unique(grams, return_inverse=True)
    at = np.repeat([r for r, s in zip(rows, sizes) if s], [s for s in sizes if s])
    width = max(1, CELLS // max(n, SIZE))
    for a in range(0, len(distinct), width):
        some = distinct[a : a + width]
        if len(distinct) <= width:
            counts = np.bincount(at * len(some) + place, minlength=n * len(some))
        else:
            here = (place >= a) & (place < a + len(some))
            counts = np.bincount(at[here] * len(some) + place[here] - a, minlength=n * len(some))
        # single precision is exact up to 16 million, more than a block has trigrams
        out += counts.reshape(n, len(some)).astype(np.float32) @ _bound(some, alphabet).astype(np.float32)
    return out


def pieces_of(texts: list[str]):
    """(spelled slices, their rows, number of rows) of the vectors of blocks of texts; long texts are cut into slices that overlap by two letters."""
    for a, b in slices([len(t) for t in texts], BLOCK_CHARS):
        codes, rows = [], []
        for r, t in enumerate(texts[a:b]):
            code = spelled(t)
            for k in range(0, max(1, len(code) - 2), BLOCK_CHARS):
                codes.append(code[k : k + BLOCK_CHARS + 2])
                rows.append(r)
        yield codes, rows, b - a


def vectors(texts: list[str]):
    """Blocks of the bundled vectors of texts, in order; a text without a letter has zeros."""
    for codes, rows, n in pieces_of(texts):
        if sum(map(len, codes)) <= 2 * BLOCK_CHARS:
            yield bundles(codes, rows, n)
        else:  # one long text
            out = np.zeros((n, SIZE))
            for c, r in zip(codes, rows):
                out += bundles([c], [r], n)
            yield out


def _not_held(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0, F.lit(True))


def prototypes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, place, value: the bundle over all texts of a language whose crc32(id as text) mod 5 is not 0 (rows without an id are learnt from)."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & _not_held(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def told():
            for lang, v in held.items():
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at].astype(np.int64))], ["lang", "place", "value"])
            held.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            number = {x: k for k, x in enumerate(names)}
            texts, done = batch.column(1).to_pylist(), 0
            for codes, own, n in pieces_of(texts):
                here = sorted({number[langs[done + r]] for r in own})
                row = {x: k for k, x in enumerate(here)}
                for a, b in slices(list(map(len, codes)), 2 * BLOCK_CHARS):
                    got = bundles(codes[a:b], [row[number[langs[done + r]]] for r in own[a:b]], len(here))
                    for x, v in zip(here, got):
                        lang = names[x]
                        held[lang] = held[lang] + v if lang in held else v
                done += n
                if len(held) > HELD:
                    yield from told()
        yield from told()

    return rows.mapInArrow(run, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))


class Profiles:
    """The languages that have letters, in order, and their prototypes at length one."""

    def __init__(self, rows):
        names = sorted({r[0] for r in rows})
        at = {x: k for k, x in enumerate(names)}
        own = np.zeros((len(names), SIZE))
        for lang, place, value in rows:
            own[at[lang], place] = value
        length = np.linalg.norm(own, axis=1)
        self.names = [x for x, n in zip(names, length) if n]
        self.own = own[length > 0] / length[length > 0, None]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of the largest cosine, the first of those that tie, and that cosine, 0 at least."""
        langs, scores = [], []
        for v in vectors(texts):
            length = np.linalg.norm(v, axis=1)
            if not self.names:
                langs += [NONE] * len(v)
                scores.append(np.zeros(len(v)))
                continue
            cosine = np.round(v @ self.own.T / np.maximum(length, 1)[:, None], 9)
            best = cosine.argmax(axis=1)
            langs += [self.names[b] if n else NONE for b, n in zip(best.tolist(), length)]
            scores.append(np.clip(cosine[np.arange(len(v)), best], 0, 1))
        return langs, np.concatenate(scores) if scores else np.zeros(0)


def learn(docs: DataFrame) -> Profiles:
    """``SIZE`` numbers for each language come to the driver."""
    return Profiles([tuple(r) for r in prototypes(docs).collect()])


def judge(docs: DataFrame, profiles: Profiles | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each of ``docs``; no shuffle of texts.

    Null texts and texts without a letter are 'und' with a score of 0; so is everything if no text is learnt from. Of
    languages that tie, the first in order counts. A null id is never held out. Texts may be of any length; repeated
    rows stay and fare alike; an empty table gives no rows. Further columns, whatever their names, are not read. The
    score is the cosine with the prototype, 0 if it is less.
    """
    held = docs.sparkSession.sparkContext.broadcast(learn(docs) if profiles is None else profiles)

    def run(batches):
        for batch in batches:
            langs, scores = held.value.judge([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (~_not_held("doc_id")).alias("held_out"), "lang_pred", "score")
