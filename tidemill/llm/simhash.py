"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link when they differ in at most 3. The anchors are the words of a covering code: the 64 bits are
dealt to blocks of odd lengths, and each block has a repetition code, which is perfect. The nearest anchor of a
fingerprint is read from the majorities of its blocks; it is its home. A fingerprint is replicated to every anchor that
is the home of anything within the threshold: turning the majority of a block costs some flips, and all sets of blocks
that cost no more than the threshold lead to such anchors (all lie within the covering radius plus the threshold). So two
linked fingerprints always meet at the home of either, and only fingerprints at one anchor are compared. As pairs meet at
both homes, replicas only go to anchors below their own home.

The number of blocks follows the number of distinct fingerprints at every size. Anchors with many rows are split: their
residents are dealt to slices by a hash, and each replica is sent to all slices, so that no task holds an anchor whole.
Links are contracted within a task before they leave it, and components come from rounds of star contraction.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import wordhash
from .common import HOT_KEYS, join_counted, partitions_for, slices, spill_table
from .components import Forest, Residents, components

SEED = 42
#: Residents of an anchor on average, and of one slice of it at most on average.
RESIDENTS, SLICE = 4096, 16384
#: Pairs compared at a time.
PAIRS = 500_000
SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the word shingles, repeats included; no words: 0."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    k = min(words, len(parts))
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(parts) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], "<u8")
    total = np.zeros(64, np.int64)
    for a in range(0, len(h), 4096):
        total += np.unpackbits(h[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (long): one row per row of ``docs``. Null and empty texts have the fingerprint 0."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_lengths(blocks: int) -> list[int]:
    """64 as a sum of an even number of odd lengths that differ by 2 at most."""
    low = 64 // blocks
    low -= 1 - low % 2
    more = (64 - low * blocks) // 2
    return [low + 2 * (i < more) for i in range(blocks)]


def code_for(distinct: int) -> list[int]:
    """Blocks for so many fingerprints: about RESIDENTS of them to an anchor."""
    return block_lengths(min(32, max(2, 2 * math.ceil(math.log2(max(1, distinct) / RESIDENTS) / 2))) if distinct > RESIDENTS else 2)


def homes(fps: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest anchor of each fingerprint, a bit for each block, and the flips that turn each block."""
    home, costs, at = np.zeros(len(fps), np.int64), np.empty((len(lengths), len(fps)), np.int8), 0
    for b, k in enumerate(lengths):
        weight = np.bitwise_count((fps >> np.uint64(at)) & np.uint64((1 << k) - 1)).astype(np.int16)
        one = weight > k // 2
        home |= one.astype(np.int64) << b
        costs[b] = np.where(one, weight - k // 2, k // 2 + 1 - weight)
        at += k
    return home, costs


def anchors(fps: np.ndarray, lengths: list[int], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of a fingerprint, anchor): its home, and each lower anchor that is home to something within ``threshold``."""
    home, costs = homes(fps, lengths)
    index, anchor = [np.arange(len(fps))], [home]
    for k in range(1, min(threshold, len(lengths)) + 1):
        for chosen in itertools.combinations(range(len(lengths)), k):
            near = costs[chosen[0]].copy()
            for b in chosen[1:]:
                near += costs[b]
            # lower: the highest turned bit is set at home
            hit = np.flatnonzero((near <= threshold) & ((home >> chosen[-1]) & 1 == 1))
            if hit.size:
                index.append(hit)
                anchor.append(home[hit] ^ sum(1 << b for b in chosen))
    return np.concatenate(index), np.concatenate(anchor)


def links(distinct: DataFrame, n_distinct: int, threshold: int = 3, check_bits: int = 0) -> DataFrame:
    """src, dst: links between the rows (node, fp) of distinct fingerprints that leave the same components as all links.

    With columns check_a and check_b, a second fingerprint of 128 bits, rows only link if theirs differ in at most
    ``check_bits`` too.
    """
    spark = distinct.sparkSession
    lengths = code_for(n_distinct)

    def deal(batches):
        for batch in batches:
            fp = batch.column(1).to_numpy().view(np.uint64)
            for a in range(0, len(fp), 4096):
                index, anchor = anchors(fp[a : a + 4096], lengths, threshold)
                resident = np.zeros(len(index), np.int8)
                resident[: len(fp[a : a + 4096])] = 1
                part = batch.slice(a, 4096).take(pa.array(index))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(resident), *part.columns], ["anchor", "resident", *batch.schema.names])

    more = [c for c in ("check_a", "check_b") if c in distinct.columns]
    kinds = "anchor long, resident tinyint, node long, fp long" + "".join(f", {c} long" for c in more)
    dealt = distinct.select("node", "fp", *more).mapInArrow(deal, kinds)

    def home_only(batches):
        for batch in batches:
            home, _ = homes(batch.column(0).to_numpy().view(np.uint64), lengths)
            yield pa.RecordBatch.from_arrays([pa.array(home)], ["anchor"])

    # anchors to be split: of more than SLICE residents and a 65,536th of all, so there are never more than 65,536
    size = max(SLICE, n_distinct // HOT_KEYS)
    counts = distinct.select("fp").mapInArrow(home_only, "anchor long").groupBy("anchor").agg(F.count("*").alias("c"))
    split = counts.where(F.col("c") > size).select("anchor", F.ceil(F.col("c") / size).cast("int").alias("more"))
    rows = dealt.join(F.broadcast(split), "anchor", "left").withColumn("parts", F.coalesce("more", F.lit(1)))
    # residents go to one slice, and to all of them as replicas, since pairs within an anchor may be in different slices
    alone = rows.where("resident = 1").select("anchor", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("slice"), F.lit(0).cast("tinyint").alias("kind"), "node", "fp", *more)
    spread = rows.select("anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"), F.lit(1).cast("tinyint").alias("kind"), "node", "fp", *more)
    parts = partitions_for(spark, n_distinct * 12.0 * len(lengths) * (24 + 8 * len(more)))
    met = alone.unionByName(spread).repartition(parts, "anchor", "slice").sortWithinPartitions("anchor", "slice", "kind")

    def compare(batches):
        forest = Forest()
        key, held, res, residents = None, [], None, None
        for batch in batches:
            anchor, part, kind = (batch.column(i).to_numpy() for i in range(3))
            node = batch.column(3).to_numpy()
            codes = np.stack([batch.column(i).to_numpy().view(np.uint64) for i in range(4, batch.num_columns)])
            change = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            src: list[int] = []
            dst: list[int] = []
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(node)]):
                if a == b:
                    continue
                if key != (anchor[a], part[a]):
                    key, held, residents = (anchor[a], part[a]), [], None
                if kind[a] == 0:
                    held.append((codes[:, a:b], node[a:b]))
                    continue
                if not held:
                    continue
                if residents is None:
                    res, residents = np.concatenate([x for x, _ in held], axis=1), Residents(np.concatenate([y for _, y in held]))
                step = max(1, PAIRS // len(residents.nodes))
                for c in range(a, b, step):
                    some = codes[:, c : min(b, c + step)]
                    near = np.bitwise_count(some[0, :, None] ^ res[0, None, :]) <= threshold
                    if len(some) > 1:
                        i, j = np.nonzero(near)
                        far = sum(np.bitwise_count(some[k, i] ^ res[k, j]).astype(np.int16) for k in range(1, len(some))) > check_bits
                        near[i[far], j[far]] = False
                    for u, v in forest.join(*residents.links(node[c : min(b, c + step)], near)):
                        src.append(u)
                        dst.append(v)
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return met.mapInArrow(compare, "src long, dst long")


def _named(distinct: DataFrame, of: DataFrame) -> DataFrame:
    """``distinct`` (node, least) with the least id of its component, which is found by an aggregation."""
    rooted = distinct.join(of, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    return join_counted(rooted, least, ["root"], "_n", F.col("node"))


def near_duplicates(docs: DataFrame, threshold: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id that links reach): one row per row of ``docs``.

    Documents of one fingerprint are linked at distance 0, those without words among them (fingerprint 0: null and empty
    texts). Whole texts count, however long; a bit that is set in just half of the shingles is 0. Repeated rows stay and
    share a component, rows of one id with different texts are linked by their texts alone. A null id takes part as any
    other but is a component's id only if no row of it has one. An empty table gives an empty result; further columns are not
    carried, whatever their names.
    """
    spark = docs.sparkSession
    fps = spill_table(fingerprints(docs, words, id_col, text_col), "simhash")
    distinct = spill_table(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).withColumn("node", F.col("fp")), "simhash-distinct")
    nodes = _named(distinct, components(links(distinct, distinct.count(), threshold)))
    return join_counted(fps, nodes.select("fp", "n", "component_id"), ["fp"], "n", F.col("doc_id")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- near copies by fingerprints of words

#: Cosine of the counts of shingles from which texts are near copies.
SIMILARITY = 0.8
BLOCK_CHARS = 400_000


def check_bits(similarity: float = SIMILARITY) -> int:
    """Bits by which 128-bit fingerprints of texts of this cosine differ on average (its angle), and a standard deviation more."""
    part = math.acos(similarity) / math.pi
    return math.floor(128 * part + math.sqrt(128 * part * (1 - part)))


def _majorities(hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A bit for each text that is set in over half of its hashes; texts are runs of hashes that begin at ``start``."""
    out = np.zeros(len(start) - 1, np.uint64)
    size = np.diff(start)
    some = np.flatnonzero(size)
    for a, b in slices(size[some].tolist(), 1 << 16):
        t = some[a:b]
        own = hashes[start[t[0]] : start[t[-1] + 1]]
        bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total = np.add.reduceat(bits, start[t] - start[t[0]], axis=0, dtype=np.int32)
        out[t] = np.packbits(2 * total > size[t][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


#: Constants that make further hashes of a hash; the first fingerprints are of the hashes themselves.
OTHER = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))


def word_codes(texts: list[str], words: int = 5) -> np.ndarray:
    """(5, n) for n texts, all with their counts: rows 0, 1 and 4 are fingerprints of the words by three hashes, rows 2 and 3, 128 bits together, of the shingles of ``words`` words.

    Words are lower-cased runs of letters and digits. A text of fewer words is one shingle; one without words has the
    hash of what it holds without white space for its only word, and zeros if that is nothing.
    """
    hashes, first = wordhash.word_hashes(texts)
    out = np.zeros((5, len(texts)), np.uint64)
    shingles, at = wordhash.shingle_hashes(hashes, first, words)
    out[0], out[1] = _majorities(hashes, first), _majorities(wordhash.mix(hashes ^ OTHER[0]), first)
    out[2], out[3] = _majorities(shingles, at), _majorities(wordhash.mix(shingles ^ OTHER[1]), at)
    out[4] = _majorities(wordhash.mix(hashes ^ OTHER[2]), first)
    for i in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < words)).tolist():
        own = xxhash.xxh3_128_intdigest(hashes[first[i] : first[i + 1]].tobytes())
        out[2:4, i] = own >> 64, own & (1 << 64) - 1
    for i in np.flatnonzero(np.diff(first) == 0).tolist():
        if held := "".join(texts[i].split()).encode("utf-8", "replace"):
            own = xxhash.xxh3_128_intdigest(held)
            out[:, i] = xxhash.xxh64_intdigest(held), xxhash.xxh64_intdigest(held, 1), own >> 64, own & (1 << 64) - 1, xxhash.xxh64_intdigest(held, 2)
    return out


def similar_texts(docs: DataFrame, similarity: float = SIMILARITY, threshold: int = 3, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, component_id (the least id of a group) for every row of ``docs`` with an id: texts link if their fingerprints say so.

    Three SimHashes of the words with their counts find candidates, within ``threshold`` bits of any, by the covering
    anchors; a SimHash of 128 bits of the shingles of ``words`` words then has to differ in no more than ``check_bits``. All are compared within an anchor before links are contracted, so a candidate
    that the last fingerprint refuses never joins two groups. Null texts count as empty ones; empty texts are alike;
    repeated rows share a component; an empty table gives no rows; further columns are not carried.
    """

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], BLOCK_CHARS):
                codes = word_codes(texts[a:b], words)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(c.view(np.int64)) for c in codes)], ["doc_id", *names])

    names = ["fp", "fp_b", "check_a", "check_b", "fp_c"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    fps = spill_table(rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, fp long, fp_b long, check_a long, check_b long, fp_c long"), "text-codes")
    distinct = spill_table(fps.groupBy(*names).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).withColumn("node", F.xxhash64(*names)), "text-codes-distinct")
    n, bits = distinct.count(), check_bits(similarity)
    found = [links(distinct.select("node", F.col(name).alias("fp"), "check_a", "check_b"), n, threshold, bits) for name in ("fp", "fp_b", "fp_c")]
    nodes = _named(distinct, components(found[0].unionByName(found[1]).unionByName(found[2])))
    return join_counted(fps, nodes.select(*names, "n", "component_id"), names, "n", F.col("doc_id")).select("doc_id", "component_id")
