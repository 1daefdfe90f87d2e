"""Terms of texts counted within their rows: a task matches its texts and passes on each term of a text once, with its count."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx

#: Texts that are held as Python strings at once.
STEP = 512
WORD = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), tx.TOKEN))
#: Both halves of it; few texts hold CJK signs, and the first half alone is faster.
ASCII, CJK = (re.compile(x) for x in WORD.pattern.split("|"))
PARTS = re.compile("[-_./]")
STOP = frozenset(tx.STOPWORDS)


def tokens(low: str | None) -> list[str]:
    """The tokens of ``functions.text.tokenize``, in any order, of a text that is in lower case and compatible form; stop words are not left out."""
    if not low:
        return []
    out = (ASCII if low.isascii() or not CJK.search(low) else WORD).findall(low)
    odd = {t for t in set(out) if not (t.isascii() and t.isalnum())}
    if not odd:
        return out
    more = []
    for t in out:
        if t in odd:
            if t.isascii():
                more += [t, *PARTS.split(t)]
            else:
                more += [t] if len(t) == 1 else [t[i : i + 2] for i in range(len(t) - 1)]
        else:
            more.append(t)
    return more


def of(low: str | None) -> Counter:
    """The tokens of a text with their counts, stop words left out."""
    held = Counter(tokens(low))
    for w in STOP.intersection(held):
        del held[w]
    return held


def _low(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.lower(tx.nfkc(F.col(text_col))).alias("low"))


def _steps(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, STEP):
            yield batch.slice(a, STEP)


def rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, dl, terms, tfs of each row: the number of tokens, the distinct terms with blanks between (null if there are none) and their counts."""
    low = _low(docs, id_col, text_col)
    kind = low.schema["id"].dataType.simpleString()

    def run(batches):
        for part in _steps(batches):
            found = [of(t) for t in part.column(1).to_pylist()]
            counts = [np.fromiter(c.values(), np.int32, len(c)) for c in found]
            cuts = np.concatenate(([0], np.cumsum([len(c) for c in counts]))).astype(np.int32)
            tfs = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([int(c.sum()) for c in counts], pa.int64()), pa.array([" ".join(c) or None for c in found], pa.string()), tfs], ["id", "dl", "terms", "tfs"])

    return low.mapInArrow(run, f"id {kind}, dl long, terms string, tfs array<int>")


def exploded(counted: DataFrame) -> DataFrame:
    """id, term, tf of rows as ``rows`` gives them; a row without terms has one with a null."""
    return counted.select("id", F.explode_outer(F.arrays_zip(F.split("terms", " ").alias("t"), F.col("tfs").alias("n"))).alias("x")).select("id", F.col("x.t").alias("term"), F.col("x.n").alias("tf"))


def totals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, df, tf: in how many documents a term stands and how often. Rows of one id are one document, rows without an id are none."""
    n, ids, apart = docs.agg(F.count("*"), F.count(id_col), F.count_distinct(id_col)).first()
    if not n == ids == apart:
        held = exploded(rows(docs, id_col, text_col)).where("term is not null").groupBy("term", "id").agg(F.sum("tf").alias("n"))
        return held.groupBy("term").agg(F.count("id").alias("df"), F.sum("n").alias("tf"))

    # each row is a document of its own, so a task can add up what it holds
    def run(batches):
        for batch in batches:
            df, tf = Counter(), Counter()
            for part in _steps([batch]):
                for t in part.column(1).to_pylist():
                    held = tokens(t)
                    tf.update(held)
                    df.update(set(held))
            for w in STOP.intersection(df):
                del df[w]
            yield pa.RecordBatch.from_arrays([pa.array(df.keys(), pa.string()), pa.array(df.values(), pa.int64()), pa.array([tf[t] for t in df], pa.int64())], ["term", "df", "tf"])

    return _low(docs, id_col, text_col).mapInArrow(run, "term string, df long, tf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
