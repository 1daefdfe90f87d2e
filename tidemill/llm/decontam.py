"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Texts and items are taken as lower-cased words, and as shingles of five words. For each size that items have (sizes are
rounded down to a grid, by an eighth at most, and such an item is looked for by its first and its last window of the size),
every window of a document gets a SimHash of its shingles. The counts of all 64 bits of a window are kept in eight
machine words, a byte for each bit, and come from differences of running sums. Fingerprints within the radius of an
item's agree with it in at least one of four blocks of 16 bits up to that block's share of the radius; for each block an
index leads from each of its values to the items so near, so a window is only compared with these, and none within the
radius is missed. For each hit the window is widened to the item's own size, and the weighted Jaccard similarity of the two bags of shingles, by their counts, is
computed; at 0.8 or more the document holds the item. A text with fewer shingles than an item is compared as a whole, by
the shingles that the two share, and so are all windows of a text with items of more shingles than a byte counts.

Documents are not shuffled. Items are broadcast in blocks of bounded size, with a pass over the documents for each; a
worker builds the index of a block once.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import wordhash
from .common import slices

WORDS, SIMILARITY = 5, 0.8
#: Bits that may differ, as shares of the blocks: the sum of (share + 1) is one more than the radius.
RADIUS, SHARES = 16, (4, 3, 3, 3)
#: Items and characters of items in one pass.
PASS_ITEMS, PASS_CHARS = 4_000, 8_000_000
BLOCK_CHARS = 800_000
LONGEST = 255
ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)


def grid() -> list[int]:
    out = list(range(1, 9))
    while out[-1] < LONGEST:
        out.append(min(LONGEST, max(out[-1] + 1, int(out[-1] * 1.125))))
    return out


def lanes(hashes: np.ndarray) -> list[np.ndarray]:
    """Running sums of the bits of all hashes: in array j, byte k counts bit 8k+j, modulo a carry that differences undo."""
    out = []
    for j in range(8):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum((hashes >> np.uint64(j)) & ONES, out=total[1:])
        out.append(total)
    return out


def window_fingerprints(sums: list[np.ndarray], size: int) -> np.ndarray:
    """SimHash of each run of ``size`` hashes: a bit is set if set in over half of them."""
    n = len(sums[0]) - size
    out, x = np.zeros(max(n, 0), np.uint64), np.empty(max(n, 0), np.uint64)
    if n <= 0:
        return out
    add = np.uint64(127 - size // 2) * ONES
    for j, total in enumerate(sums):
        np.subtract(total[size:], total[:-size], out=x)
        x += add
        x &= HIGH
        x >>= np.uint64(7 - j)
        out |= x
    return out


def near_values(value: int, radius: int) -> np.ndarray:
    """All 16-bit values within ``radius`` of ``value``."""
    masks = [sum(1 << b for b in c) for k in range(radius + 1) for c in itertools.combinations(range(16), k)]
    return np.array(masks, np.int64) ^ value


class Block:
    """For each value of 16 bits, the entries whose own value is within ``radius`` of it."""

    def __init__(self, values: np.ndarray, radius: int):
        masks = near_values(0, radius).astype(np.uint16)
        near = (values[:, None] ^ masks[None, :]).ravel()
        order = np.argsort(near, kind="stable")
        kind = np.uint16 if len(values) < 1 << 16 else np.uint32
        self.entries = (order // len(masks)).astype(kind)
        self.start = np.searchsorted(near[order], np.arange((1 << 16) + 1)).astype(np.int32)

    def near(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a value, entry) for all entries near each of ``values``."""
        low = self.start[values]
        which, place = _spread(low, self.start[values.astype(np.int32) + 1] - low, np.arange(len(values), dtype=np.int32))
        return which, self.entries[place].astype(np.int64)


class Index:
    """Items by the size of their windows."""

    def __init__(self, items: list[tuple[int, str]]):
        words, first = wordhash.word_hashes([t for _, t in items])
        hashes, at = wordhash.shingle_hashes(words, first, WORDS)
        sizes = grid()
        self.items, entries, whole = [], defaultdict(list), []
        for k, (item_id, _) in enumerate(items):
            own = hashes[at[k] : at[k + 1]]
            if not len(own):
                continue
            if len(own) <= LONGEST:
                size = max(s for s in sizes if s <= len(own))
                fps = window_fingerprints(lanes(own), size)
                for offset in {0, len(own) - size}:
                    entries[size].append((fps[offset], len(self.items), offset))
            whole.append(np.unique(own))
            self.items.append((item_id, own, np.sort(own), Counter(own.tolist())))
        self.lengths = np.array([len(x[1]) for x in self.items], np.int64)
        held = np.concatenate(whole) if whole else np.empty(0, np.uint64)
        order = np.argsort(held, kind="stable")
        self.held, self.held_by = held[order], np.repeat(np.arange(len(whole)), [len(x) for x in whole])[order]
        long = self.lengths[self.held_by] > LONGEST
        self.long, self.long_by = self.held[long], self.held_by[long]
        self.sizes = {}
        for size, found in entries.items():
            fps = np.array([x[0] for x in found], np.uint64)
            parts = fps.view("<u2").reshape(-1, 4)
            self.sizes[size] = ([Block(parts[:, b], share) for b, share in enumerate(SHARES)], fps, np.array([x[1] for x in found]), np.array([x[2] for x in found]))

    def matches(self, texts: list[str], similarity: float = SIMILARITY) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words): the best window for each text and item it holds."""
        words, first = wordhash.word_hashes(texts)
        hashes, at = wordhash.shingle_hashes(words, first, WORDS)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        if not len(hashes):
            return []
        sums = lanes(hashes)
        text_of = np.repeat(np.arange(len(texts)), np.diff(at))
        for size, (blocks, fps, item_of, offset_of) in self.sizes.items():
            own = window_fingerprints(sums, size)
            if not len(own):
                continue
            inside = np.flatnonzero(text_of[: len(own)] == text_of[size - 1 :])
            window, hits = own[inside], []
            parts = window.view("<u2").reshape(-1, 4)
            for b, block in enumerate(blocks):
                which, entry = block.near(parts[:, b])
                close = np.bitwise_count(window[which] ^ fps[entry]) <= RADIUS
                hits.append(which[close].astype(np.int64) * len(fps) + entry[close])
            which, entry = np.divmod(np.unique(np.concatenate(hits)), len(fps))
            for e in np.unique(entry).tolist():
                hit = inside[which[entry == e]]
                self._verify(hit - offset_of[e], text_of[hit], int(item_of[e]), hashes, at, similarity, best)
        self._short(hashes, at, similarity, best)
        self._long(hashes, at, text_of, similarity, best)
        return [(t, self.items[i][0], s, a, n) for (t, i), (s, a, n) in sorted(best.items())]

    def _short(self, hashes, at, similarity, best) -> None:
        """Texts with fewer shingles than an item, as a whole: by the shingles that they share, without fingerprints."""
        length = np.diff(at)
        texts = np.flatnonzero((length > 0) & (length < self.lengths.max(initial=0)))
        if not texts.size:
            return
        text, place = _spread(at[texts], length[texts], texts)
        item, which = _holders(self.held, self.held_by, hashes[place])
        text = text[which]
        for t, i in self._often(text, item, length, similarity):
            if length[t] < self.lengths[i]:
                shared = sum((Counter(hashes[at[t] : at[t + 1]].tolist()) & self.items[i][3]).values())
                score = shared / (int(length[t] + self.lengths[i]) - shared)
                if score >= similarity and ((t, i) not in best or score > best[t, i][0]):
                    best[t, i] = (score, 0, int(length[t]) + WORDS - 1)

    def _long(self, hashes, at, text_of, similarity, best) -> None:
        """Items of over LONGEST shingles in texts of no fewer: every window of the item's size that may be as similar, exactly."""
        if not len(self.long):
            return
        item, which = _holders(self.long, self.long_by, hashes)
        length = np.diff(at)
        for t, i in self._often(text_of[which], item, length, similarity):
            size = int(self.lengths[i])
            if length[t] < size:
                continue
            kinds, counts = np.unique(self.items[i][2], return_counts=True)
            text = hashes[at[t] : at[t + 1]]
            kind = np.minimum(np.searchsorted(kinds, text), len(kinds) - 1)
            kind[kinds[kind] != text] = len(kinds)
            total = np.concatenate(([0], np.cumsum(kind < len(kinds))))
            near = np.flatnonzero(total[size:] - total[:-size] >= similarity * 2 * size / (1 + similarity) - 1e-6)
            left, kind, last = [*counts.tolist(), 0], kind.tolist(), None  # of each shingle, those of the item not in the window
            for a in near.tolist():
                if last is None or a != last + 1:
                    left, shared = [*counts.tolist(), 0], 0
                    new = kind[a : a + size]
                else:
                    k = kind[last]
                    left[k] += 1
                    shared -= k < len(kinds) and left[k] > 0
                    new = kind[a + size - 1 : a + size]
                for k in new:
                    shared += k < len(kinds) and left[k] > 0
                    left[k] -= 1
                last = a
                score = shared / (2 * size - shared)
                if score >= similarity and ((t, i) not in best or score > best[t, i][0]):
                    best[t, i] = (score, a, size + WORDS - 1)

    def _often(self, text, item, length, similarity) -> list[tuple[int, int]]:
        """The texts and items that meet in as many places as the similarity asks for, when ``length`` places are compared."""
        pair, count = np.unique(text.astype(np.int64) * len(self.items) + item, return_counts=True)
        text, item = np.divmod(pair, len(self.items))
        least = similarity * (np.minimum(length[text], self.lengths[item]) + self.lengths[item]) / (1 + similarity)
        keep = count >= least - 1e-6
        return list(zip(text[keep].tolist(), item[keep].tolist()))

    def _verify(self, start, text, item, hashes, at, similarity, best) -> None:
        _, own, ordered, bag = self.items[item]
        size = len(own)
        low, high = at[text], at[text + 1]
        start = np.minimum(np.maximum(start, low), np.maximum(high - size, low))
        length = np.minimum(size, high - start)
        needed = math.ceil(similarity * 2 * size / (1 + similarity) * 0.5)
        # a window shares no more shingles with the item than it has shingles of the item
        for a in range(0, len(start), 4096):
            s, n, t = start[a : a + 4096], length[a : a + 4096], text[a : a + 4096]
            place = np.minimum(s[:, None] + np.arange(size), len(hashes) - 1)
            got = hashes[place]
            held = (ordered[np.minimum(np.searchsorted(ordered, got), size - 1)] == got) & (np.arange(size) < n[:, None])
            for k in np.flatnonzero(held.sum(axis=1) >= needed).tolist():
                window = Counter(hashes[s[k] : s[k] + n[k]].tolist())
                shared = sum((window & bag).values())
                score = shared / (int(n[k]) + size - shared)
                key = (int(t[k]), item)
                if score >= similarity and (key not in best or score > best[key][0]):
                    best[key] = (score, int(s[k] - at[t[k]]), int(n[k]) + WORDS - 1)


def _spread(start, count, label) -> tuple[np.ndarray, np.ndarray]:
    """Each label as often as its count says, and the places from its start on."""
    before = np.cumsum(count) - count
    return np.repeat(label, count), np.arange(int(count.sum())) + np.repeat(start - before, count)


def _holders(held, held_by, hashes) -> tuple[np.ndarray, np.ndarray]:
    """The items that hold each shingle, and the place of that shingle."""
    low, high = np.searchsorted(held, hashes), np.searchsorted(held, hashes, side="right")
    which, place = _spread(low, high - low, np.arange(len(hashes)))
    return held_by[place], which


#: Indexes that this worker has built, by a digest of their items; the last two.
_BUILT: dict[str, Index] = {}


def _index(items) -> Index:
    held = items.value
    key = hashlib.sha256(repr(held).encode()).hexdigest()
    if key not in _BUILT:
        while len(_BUILT) > 1:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = Index(held)
    return _BUILT[key]


def _passes(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str) -> list:
    """Broadcasts of the items, in blocks of bounded size. Equal items are in one block."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    count, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    passes = max(1, math.ceil(count / PASS_ITEMS), math.ceil(chars / PASS_CHARS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    return [docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.where(block == k).collect()]) for k in range(passes)]


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: one row for each item that a document holds, none for clean documents.

    Null and empty texts match nothing. Nor do items without an id or a text, and those of fewer than five words: they
    have no shingle, and so short a run of words stands in many a clean text. The place is that of the window of the
    greatest similarity; of windows that tie, the first by size of window and place. Repeated rows of documents are
    reported each, items of the same text too, rows without an id with a null id. Texts may be of any length. Empty
    tables give no rows; further columns are not carried, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for part in _passes(docs, benchmark, item_col, item_text):
        found = rows.mapInArrow(_searcher(part, similarity), "doc_id long, item_id long, similarity double, first_word int, n_words int")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns. Nulls as in ``contaminated``; no shuffle."""
    at = docs.columns.index(text_col)
    for part in _passes(docs, benchmark, "item_id", "text"):
        docs = docs.mapInArrow(_cleaner(part, similarity, at), docs.schema)
    return docs


def _cleaner(part, similarity, at):
    def run(batches):
        index = _index(part)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep = np.ones(len(texts), bool)
            for a, b in slices([len(t) for t in texts], BLOCK_CHARS):
                keep[[a + m[0] for m in index.matches(texts[a:b], similarity)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _searcher(part, similarity):
    def run(batches):
        index = _index(part)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], BLOCK_CHARS):
                found = index.matches(texts[a:b], similarity)
                if found:
                    t, i, s, w, n = zip(*found)
                    yield pa.RecordBatch.from_arrays([ids[a:b].take(pa.array(t)), pa.array(i, pa.int64()), pa.array(s), pa.array(w, pa.int32()), pa.array(n, pa.int32())], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run
