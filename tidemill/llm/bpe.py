"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For a byte string s, BPE gives every prefix s[:i] one encoding, and the encoding of the whole is a chain of these: its
last token t is the only one for which (last token of s[:i-len(t)], t) is a *stable pair*, two tokens whose joined bytes
encode to just these two. Storing the last token of each prefix is therefore enough: the encoding is read back from the
end, appending bytes continues the table, and an edit keeps every entry before it. Distinct pieces of a block are sorted,
so that a piece continues the table of the prefix it shares with the one before it.

Texts are split by the public pattern first (``pretoken``); every piece is encoded separately, without special tokens.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import pretoken
from .common import slices

#: Distinct pieces whose ids a worker keeps; then it starts afresh. Bounds memory only, never results.
CACHE_PIECES = 300_000
#: Stable and unstable pairs that a worker keeps.
CACHE_PAIRS = 1_500_000
#: Characters that are split and encoded at once.
BLOCK_CHARS = 250_000


class Vocabulary:
    """Ranks of byte strings, as in a rank file: lower ranks merge first, and a rank is the id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.longest = max(map(len, ranks))
        #: the length of the longest token that ends with these two bytes
        self.reach: dict[bytes, int] = {}
        for piece in ranks:
            if len(piece) > 1:
                self.reach[piece[-2:]] = max(len(piece), self.reach.get(piece[-2:], 0))
        self.stable_pairs: dict[int, bool] = {}
        #: the last merge of each token; tokens that their own bytes do not merge to only ever stand for a whole piece
        self.halves: dict[int, tuple[int, int]] = {}
        self.unreachable = set()
        for piece, rank in ranks.items():
            if len(piece) > 1:
                last = self.merge(piece, 2)
                if len(last) == 2 and ranks.get(self.bytes_of[last[0]] + self.bytes_of[last[1]]) == rank:
                    self.halves[rank] = (last[0], last[1])
                else:
                    self.unreachable.add(rank)
        self.edges: tuple[dict, dict] = ({}, {})

    @classmethod
    def from_rank_file(cls, path: str) -> "Vocabulary":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merge(self, piece: bytes, least: int = 1) -> list[int]:
        """Merges by definition, down to ``least`` parts: the pair of lowest rank first, the leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at the left (0) or right (1) end of a token while it is merged from bytes: (bytes, rank of the merge that ends it)."""
        known = self.edges[side].get(token)
        if known is None:
            chain, at = [(self.bytes_of[token], float("inf"))], token
            while at in self.halves:
                chain.append((self.bytes_of[self.halves[at][side]], at))
                at = self.halves[at][side]
            known = self.edges[side][token] = chain[::-1]
        return known

    def stable(self, a: int, b: int) -> bool:
        """Whether the joined bytes of two tokens encode to just these two: no merge across the border comes first.

        Both tokens are merged from bytes in step, by rank, as the whole would be; a merge across the border comes before
        one inside b of the same rank, as it is further left, and after one inside a.
        """
        key = a << 32 | b
        known = self.stable_pairs.get(key)
        if known is None:
            if len(self.stable_pairs) >= CACHE_PAIRS:
                self.stable_pairs.clear()
            left, right, i, j, known = self.edge(a, 1), self.edge(b, 0), 0, 0, True
            get = self.ranks.get
            while True:
                (x, x_end), (y, y_end) = left[i], right[j]
                across = get(x + y)
                if across is not None and across < x_end and across <= y_end:
                    known = False
                    break
                if x_end == y_end == float("inf"):
                    break
                if x_end <= y_end:
                    i += 1
                else:
                    j += 1
            self.stable_pairs[key] = known
        return known


class PrefixTable:
    """The last token of each prefix of a byte string that can grow, or be cut back and go on differently."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> "PrefixTable":
        v = self.vocabulary
        reach, get, known, stable, unreachable = v.reach.get, v.ranks.get, v.stable_pairs.get, v.stable, v.unreachable
        begin = len(self.data)
        data = self.data = self.data + more
        last = self.last
        for end in range(begin + 1, len(data) + 1):
            for start in range(max(0, end - reach(data[end - 2 : end], 1)) if end > 1 else 0, end):
                token = get(data[start:end])
                if token is None or token in unreachable:
                    continue
                if start == 0:
                    last.append(token)
                    break
                before = last[start]
                ok = known(before << 32 | token)
                if ok is None:
                    ok = stable(before, token)
                if ok:
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}: the vocabulary lacks single bytes")
        return self

    def cut(self, length: int) -> "PrefixTable":
        """Forget all bytes from ``length`` on."""
        self.data = self.data[:length]
        del self.last[length + 1 :]
        return self

    def edit(self, start: int, end: int, new: bytes) -> "PrefixTable":
        """Replace data[start:end]. Entries before ``start`` stay; behind the edit, old entries are taken over once they meet."""
        old, old_last, shift = self.data, self.last[:], len(new) - (end - start)
        tail = old[end:]
        self.cut(start).append(new)
        span = self.vocabulary.longest
        same = 0  # how many entries in a row equal the old ones
        for i in range(len(tail)):
            self.append(tail[i : i + 1])
            at = len(self.data)
            same = same + 1 if self.last[at] == old_last[at - shift] else 0
            if same >= span:
                self.data += tail[i + 1 :]
                self.last += old_last[at - shift + 1 :]
                break
        return self

    def ids(self, end: int | None = None) -> list[int]:
        out, at, of = [], len(self.data) if end is None else end, self.vocabulary.bytes_of
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(of[token])
        return out[::-1]


class Encoder:
    """Encodes texts; keeps the ids of pieces it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.seen: dict[str, bytes] = {}

    def learn(self, new: set[str]) -> None:
        ranks, seen = self.vocabulary.ranks, self.seen
        table, data = PrefixTable(self.vocabulary), b""
        for piece, text in sorted((t.encode("utf-8", "replace"), t) for t in new):
            token = ranks.get(piece)
            if token is not None:
                seen[text] = token.to_bytes(4, "little")
                continue
            shared, most = 0, min(len(piece), len(data))
            while shared < most and piece[shared] == data[shared]:
                shared += 1
            table.cut(shared).append(piece[shared:])
            data = piece
            seen[text] = np.array(table.ids(), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        for a, b in slices([len(t) for t in texts], BLOCK_CHARS):
            split = pretoken.pieces(texts[a:b])
            new = set().union(*split).difference(self.seen)
            if new:
                if len(self.seen) + len(new) > CACHE_PIECES:
                    self.seen.clear()
                    new = set().union(*split)
                self.learn(new)
            get = self.seen.__getitem__
            out += [np.frombuffer(b"".join(map(get, x)), "<u4") for x in split]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


@functools.cache
def encoder(path: str | None) -> Encoder:
    """One for each worker and rank file."""
    import public_tokenizers

    return Encoder(Vocabulary.from_rank_file(path or public_tokenizers.path("byte_bpe_50k.tiktoken")))


def encode_documents(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, ids (array<int>, unless not asked for), n_tokens, ids_sha256, decoded_sha256.

    The ids are decoded again and the digest is that of the decoded bytes. A null text counts as the empty text: no ids,
    and digests of nothing. Repeated rows stay, further columns are not carried. No shuffle.
    """
    schema = f"`{id_col}` long, " + "ids array<int>, " * ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        enc = encoder(ranks)
        decimal = [str(i) for i in range(len(enc.vocabulary.bytes_of))]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], 8 * BLOCK_CHARS):
                counts, hashes, decoded, arrays = [], [], [], []
                for one in enc.encode([t or "" for t in texts[a:b]]):
                    numbers = one.tolist()
                    counts.append(len(numbers))
                    hashes.append(hashlib.sha256(" ".join(map(decimal.__getitem__, numbers)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(enc.decode(numbers)).hexdigest())
                    if ids:
                        arrays.append(one.astype(np.int32))
                columns = [batch.column(0)[a:b], pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded)]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
                    columns.insert(1, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
                    names.insert(1, "ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode_documents(tokens: DataFrame, ranks: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: the decoded bytes as UTF-8, replacing what is none. Null ids give a null text."""

    def run(batches):
        enc = encoder(ranks)
        for batch in batches:
            texts = [None if x is None else enc.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return tokens.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` long, text string")
