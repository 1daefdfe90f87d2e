"""Splitting of many texts at once into the pieces that a byte-level BPE merges separately.

The pieces are those of the public pattern: contractions, runs of letters, digits or other signs with one space before
them, and white space. Classes of code points are looked up in a table and all boundaries of a block of texts are found
with array operations; a regular expression engine is only used to fill the table.
"""

from __future__ import annotations

import functools

import numpy as np

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3


@functools.cache
def class_table() -> np.ndarray:
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    points = np.arange(0x110000)
    every = "".join(map(chr, [c if not 0xD800 <= c < 0xE000 else 0xFFFF for c in points.tolist()]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def piece_bounds(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined text, the start of each piece in it (with the end at last), and the index of each text's first piece.

    The last array has one more entry than there are texts. Empty texts have no pieces.
    """
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    n = len(joined)
    if n == 0:
        return joined, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = class_table()[code]
    first = np.zeros(n + 1, bool)  # the first character of a text
    first[(ends - lengths)[lengths > 0]] = True
    first[n] = True
    space = kind == SPACE
    cut = np.ones(n, bool)
    cut[1:] = kind[1:] != kind[:-1]
    cut |= first[:n]
    # the last character of a run of white space before something else stands apart; a blank joins what follows
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    cut |= before
    joins = before & (code == 32)
    cut[1:][joins[:-1]] = False
    quote = np.flatnonzero((code == 39) & cut)  # starts a piece, with no blank before it
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    if quote.size:
        one = code[quote + 1]
        inside = (quote + 2 < n) & ~first[np.minimum(quote + 2, n)]
        two = np.where(inside, code[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, size in ((quote[short], 2), (quote[long & ~short], 3)):
            cut[at + 1] = False
            end = at + size
            end = end[end < n]
            cut[end] |= (kind[end] == LETTER) | first[end]
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, n)
    index = np.searchsorted(starts, np.concatenate(([0], ends)))
    return joined, bounds, index


def pieces(texts: list[str]) -> list[list[str]]:
    joined, bounds, index = piece_bounds(texts)
    at = bounds.tolist()
    every = [joined[a:b] for a, b in zip(at, at[1:])]
    cuts = index.tolist()
    return [every[a:b] for a, b in zip(cuts, cuts[1:])]
