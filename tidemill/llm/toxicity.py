"""Toxicity of texts after noisy-channel deobfuscation.

A writer's letters pass a channel that swaps them for signs that look alike, repeats them and sets blanks or points
between them. Candidate strings (tokens of letters and such signs, words with a letter three times in a row or twice where
that is rare under the model, short groups with points or the like between them, and signs standing singly) are turned into lattices: each sign may be one of several letters, a run of a letter may be one or two of it, and
what stands between single signs is nothing or the end of a word. Letters other than a to z stand for themselves. The
Viterbi path of a lattice under a character trigram model of the corpus, with the costs of the channel, is the restored
word; of paths that tie, the one whose signs are read by the earlier option. Candidates may have any length: a path is a
chain of steps that the states share, so time and memory grow in proportion. Texts are scored with the restored words
beside their own.

The trigram counts come from all documents and are summed in a table of fixed size. The classifier is a logistic
regression on words and prefixes of words: it is fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by the hash of
their ids, with features that are several times as frequent in toxic documents as in others.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, spill_table

#: The bound of the labelled sample, and of the features that the model keeps.
TRAIN_ROWS, FEATURES = 50_000, 5_000
#: How many times as frequent in toxic documents a feature has to be, and in which part of them it has to stand.
RATIO, SHARE = 12.0, 0.01
LOOKALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "*": "abcdefghijklmnopqrstuvwxyz", "#": "h"}
SWAP_COST, WILD_COST, SINGLE_COST, DOUBLE_COST, KEEP_COST, GAP_COST, LOST_COST = 1.5, 3.0, 0.7, 0.7, 0.05, 1.0, 1.0
SINGLY = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+*])(?:[ ._-](?:[^\W_]|[@$!|+*])){3,}(?![^\W_])")
#: Short groups of signs with something between them, at least two of them.
GROUPS = re.compile(r"[^\W_]{1,3}(?:[._-][^\W_]{1,3}){2,}")
THRICE = re.compile(r"([^\W\d_])\1\1")
GAPS = re.compile("[._-]")
SIGNS = "!#$%&*+@|~^=<>"
EDGES = ".,;:?\"'()[]{}<>«»…-_/\\"
#: From this cost on, a letter that stands twice is rare after what it follows, and its word is decoded.
RARE_COST = 6.0
#: Words whose restored form a worker keeps, and the longest of them; longer ones are decoded each time.
KNOWN, KNOWN_CHARS = 50_000, 64
#: Characters of the texts whose words are held at a time.
BLOCK_CHARS = 200_000


@functools.cache
def letter_codes() -> np.ndarray:
    """0 to 25 for the letters in either case, 26 for all other bytes."""
    out = np.full(256, 26, np.int64)
    out[ord("a") : ord("z") + 1] = out[ord("A") : ord("Z") + 1] = np.arange(26)
    return out


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """code, n: how often three letters (or ends of words) follow each other in all documents. 27^3 rows at most."""

    def run(batches):
        total = np.zeros(27**3, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices([len(t) for t in texts], 1_000_000):
                code = letter_codes()[np.frombuffer(("  ".join(texts[a:b]) + "  ").encode("utf-8", "replace"), np.uint8)]
                total += np.bincount(code[:-2] * 729 + code[1:-1] * 27 + code[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def trigram_costs(rows) -> np.ndarray:
    """-log of the chance of a letter after two others."""
    counts = np.zeros(27**3)
    for code, n in rows:
        counts[code] = n
    counts = counts.reshape(27, 27, 27)
    pairs = counts.sum(axis=2, keepdims=True)
    single = counts.sum(axis=(0, 1)) + 1
    return -np.log((counts + 5 * single / single.sum()) / (pairs + 5))


class Restorer:
    """Viterbi decoding of candidate strings; keeps what it has decoded."""

    def __init__(self, costs: np.ndarray):
        self.table, self.costs = costs, costs.tolist()
        self.known: dict[tuple[str, bool], str] = {}

    def options(self, c: str) -> list[tuple[str, float]]:
        """What a sign may stand for, with the cost of each reading."""
        if "a" <= c <= "z":
            return [(c, KEEP_COST)]
        if c in LOOKALIKE:
            return [(x, WILD_COST if c == "*" else SWAP_COST) for x in LOOKALIKE[c]]
        return [(c, 0.0)] if c.isalpha() else [("", LOST_COST)]

    def lattice(self, seen: str, singly: bool):
        """The readings of each run of a sign in turn; between single signs, nothing or the end of a word."""
        i = 0
        while i < len(seen):
            c, j = seen[i], i + 1
            while not singly and j < len(seen) and seen[j] == c:
                j += 1
            readings = self.options(c)
            if singly:
                if i:
                    yield [("", 0.0), (" ", GAP_COST)]
                yield readings
            elif readings[0][0] == "" or j - i == 1 or (j - i > 2 and c.isalpha() and not "a" <= c <= "z"):
                yield readings  # of letters that the model does not tell apart, a long run is one
            elif j - i == 2:
                yield [(2 * x, w) for x, w in readings] + [(x, w + SINGLE_COST + 1) for x, w in readings]
            else:
                yield [(2 * x, w + DOUBLE_COST) for x, w in readings] + [(x, w + SINGLE_COST) for x, w in readings]
            i = j

    def restore(self, seen: str, singly: bool = False) -> str:
        """The path of least cost; ``singly`` if the signs of ``seen`` stood apart."""
        got = self.known.get((seen, singly))
        if got is not None:
            return got
        cost, done = self.costs, []
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(26, 26): (0.0, None)}
        for readings in self.lattice(seen, singly):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (total, path) in states.items():
                for letters, price in readings:
                    x, y, z = a, b, total + price
                    for c in letters:
                        k = ord(c) - 97 if "a" <= c <= "z" else 26
                        z += cost[x][y][k]
                        x, y = y, k
                    if (x, y) not in after or z < after[x, y][0]:
                        after[x, y] = (z, (path, letters))
            if len(after) == 1:  # all paths go through here, so what lies before is settled
                (state, (total, path)), = after.items()
                done.append(_letters(path))
                after = {state: (total, None)}
            states = after
        path = min(((z + cost[a][b][26], n, path) for n, ((a, b), (z, path)) in enumerate(states.items())), key=lambda x: x[:2])[2]
        best = "".join(done) + _letters(path)
        if len(seen) <= KNOWN_CHARS:
            if len(self.known) > KNOWN:
                self.known.clear()
            self.known[seen, singly] = best
        return best


def _letters(path: tuple | None) -> str:
    out = []
    while path is not None:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


@functools.cache
def _kinds() -> np.ndarray:
    """By code point up to 256, the last for all others: 1 for letters, 2 for digits and signs that stand for letters, 3 for what stands between single signs."""
    out = np.zeros(257, np.uint8)
    out[[c for c in range(256) if chr(c).isalpha()] + [256]] = 1
    out[[ord(c) for c in "0123456789@$!|+*"]] = 2
    out[[ord(c) for c in " ._-"]] = 3
    return out


def _points(low: str) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)
    return code, _kinds()[np.minimum(code, 256)]


def _thrice(code: np.ndarray, kind: np.ndarray) -> bool:
    """Whether a letter stands three times in a row, as a quick test before the pattern."""
    return bool(((kind[:-2] == 1) & (code[:-2] == code[1:-1]) & (code[1:-1] == code[2:])).any())


def _single(kind: np.ndarray) -> bool:
    """Whether four signs stand singly in a row, as a quick test before the pattern."""
    some = (kind == 1) | (kind == 2)
    between = kind == 3
    if len(kind) < 7:
        return False
    near = some[:-6].copy()
    for k in range(1, 7):
        near &= (between if k % 2 else some)[k : len(kind) - 6 + k]
    return bool(near.any())


def _rare_doubles(code: np.ndarray, kind: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Places of letters that stand twice where the model hardly expects them to, within words of ASCII letters or others."""
    at = np.flatnonzero((kind[2:] == 1) & (code[2:] == code[1:-1])) + 2
    if not len(at):
        return at
    letter = lambda i: np.where((code[i] >= 97) & (code[i] <= 122), code[i].astype(np.int64) - 97, 26)
    x = letter(at)
    return at[(x < 26) & (costs[letter(at - 2), x, x] >= RARE_COST)]


def _word_at(low: str, i: int) -> str:
    """The run of letters that holds a place."""
    a = i
    while a and low[a - 1].isalpha():
        a -= 1
    b = i + 1
    while b < len(low) and low[b].isalpha():
        b += 1
    return low[a:b]


def token_sets(texts: list[str], restorer: Restorer) -> list[set[str]]:
    """The distinct words of each text, lower-cased, and beside them the restored ones of those that were disguised."""
    out = []
    for text in texts:
        low = text.lower()
        words = {w.strip(EDGES) for w in low.split()}
        more = {w.strip(SIGNS + EDGES) for w in words if not w.isalpha()}
        for w in words:
            if not w.isalpha() and len(w) >= 3:
                for x in {w, w.rstrip("!+*|")}:
                    if len(x) >= 3 and any(c.isalpha() for c in x) and all(c.isalpha() or c in LOOKALIKE for c in x):
                        more.add(restorer.restore(x))
                if GROUPS.fullmatch(bare := w.strip(EDGES + SIGNS)):
                    more.add(restorer.restore(GAPS.sub("", bare)))
        code, kind = _points(low)
        last = -1
        for i in _rare_doubles(code, kind, restorer.table).tolist():
            if i > last:
                word = _word_at(low, i)
                last = i + len(word)
                more.add(restorer.restore(word))
        if _thrice(code, kind):
            more.update(restorer.restore(w) for w in words if w.isalpha() and THRICE.search(w))
        if _single(kind):
            for m in SINGLY.finditer(low):
                signs = m[0][::2]
                if any(c.isalpha() for c in signs):
                    more.update(restorer.restore(signs, True).split())
        words |= more
        words.discard("")
        out.append(words)
    return out


def features_of(words) -> set[str]:
    out = set(words)
    for n in range(4, 9):
        out.update({f"{w[:n]}~" for w in words if len(w) > n})
    return out


def _train_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, toxic of at most ``most`` labelled rows, those of the least hashes of their ids. Of labels that differ for an id, 1 counts."""
    own = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id").select("text", "toxic")


class Model:
    """What executors need to score texts: the costs of trigrams, and constant and weights of the features."""

    def __init__(self, costs: np.ndarray, constant: float, weights: dict[str, float]):
        self.costs, self.constant, self.weights = costs, constant, weights

    def scores(self, texts: list[str], restorer: Restorer) -> np.ndarray:
        own = self.weights
        held, z = own.keys(), []
        for a, b in slices([len(t) for t in texts], BLOCK_CHARS):  # the words of a few texts at a time
            z += [self.constant + sum(own[f] for f in held & features_of(words)) for words in token_sets(texts[a:b], restorer)]
        return 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Labels are only read where crc32(doc_id) mod 5 is not 0. Without labels of both classes nothing is ever toxic.

    The documents are read once for the trigrams and once for the words of the labelled ones, which are written down;
    everything after reads these.
    """
    costs = trigram_costs([(r.code, r.n) for r in trigram_counts(docs).collect()])

    def restored(batches):
        restorer = Restorer(costs)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices([len(t) for t in texts], BLOCK_CHARS):
                words = [sorted(w) for w in token_sets(texts[a:b], restorer)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), batch.column(1)[a:b].cast(pa.int32())], ["words", "toxic"])

    rows = spill_table(_train_rows(docs, labels, most).mapInArrow(restored, "words array<string>, toxic int"), "labelled-words")

    def count(wanted, only):
        def run(batches):
            found, n = Counter(), 0
            for batch in batches:
                for words, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if y == only:
                        n += 1
                        got = features_of(words)
                        found.update(got if wanted is None else got & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(["", *found], pa.string()), pa.array([n, *found.values()], pa.int64())], ["feature", "n"])

        return rows.mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return Model(costs, 5.0 if n_pos else -5.0, {})
    # a feature stands in a hundredth of the toxic documents, so there are at most a hundred times as many as a document has
    pos = {r.feature: r.n for r in count(None, 1).where(f"feature <> '' and n >= {least_count(n_pos)}").collect()}
    neg = {r.feature: r.n for r in count(frozenset(pos), 0).where("feature <> ''").collect()}
    kept = choose(pos, neg, n_pos, n_neg)
    place = {f: i for i, f in enumerate(kept)}

    def matched(batches):
        held = place.keys()
        for batch in batches:
            found = [sorted(place[f] for f in held & features_of(w)) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["found", "toxic"])

    table = rows.mapInArrow(matched, "found array<int>, toxic int").groupBy("found", "toxic").agg(F.count("*").alias("n")).collect()
    constant, weights = _regress([(r.found, r.toxic, r.n) for r in table], len(kept))
    return Model(costs, constant, {f: w for f, w in zip(kept, weights) if w})


def least_count(n_pos: int, share: float = SHARE) -> int:
    return max(4, math.ceil(share * n_pos))


def choose(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int, ratio: float = RATIO, most: int = FEATURES) -> list[str]:
    """Features that are ``ratio`` times as frequent in toxic documents, those that tell most first; at most ``most``."""
    odds = {f: math.log((n + 0.5) / (n_pos + 1)) - math.log((neg.get(f, 0) + 0.5) / (n_neg + 1)) for f, n in pos.items()}
    return sorted((f for f, o in odds.items() if o >= math.log(ratio)), key=lambda f: (-pos[f] * odds[f], f))[:most]


def _regress(rows, size: int, rounds: int = 300, decay: float = 1e-4) -> tuple[float, list[float]]:
    """Logistic regression by accelerated gradient steps; rows are (features, label, how often)."""
    rows.sort()
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _, _ in rows])
    col = np.array([i for f, _, _ in rows for i in f], np.int64)
    y, n = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    n = n * np.where(y > 0, 0.5 / n[y > 0].sum(), 0.5 / n[y <= 0].sum())
    w, before, b, b_before = np.zeros(size), np.zeros(size), 0.0, 0.0
    scale = max(1, max((len(f) for f, _, _ in rows), default=1))
    rate = 8.0 / min(scale, 60)
    for k in range(rounds):
        m = k / (k + 3)
        at, b_at = w + m * (w - before), b + m * (b - b_before)
        z = b_at + np.bincount(row, at[col], len(rows))
        error = n * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        before, b_before = w, b
        w = np.maximum(at - rate * (np.bincount(col, error[row], size) + decay * at), 0)  # features only speak for the class
        b = b_at - rate * error.sum()
    return float(b), [round(float(x), 6) for x in w]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: one row per row of ``docs``; no shuffle. Null and empty texts get the score of a text without words."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        restorer = Restorer(own.costs)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores([t or "" for t in batch.column(1).to_pylist()], restorer))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``least``, with all their columns; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        own = held.value
        restorer = Restorer(own.costs)
        for batch in batches:
            yield batch.filter(pa.array(own.scores([t or "" for t in batch.column(at).to_pylist()], restorer) < least))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: fits the model and scores every row of ``docs``.

    Null and empty texts are scored like texts without words; a null id is never held out. Repeated rows stay, and equal
    texts have equal scores. Texts and words may be of any length. A score of just 0.5 counts as toxic. Labels of rows
    that are not there are not used; of labels that differ for an id, 1 counts. Empty tables give no rows; further
    columns are neither read nor carried, whatever their names.
    """
    scored = score(docs, fit(docs, labels, most))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
