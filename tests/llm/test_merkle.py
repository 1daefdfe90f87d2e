"""The manifest against plain Python: ties, nulls, repeated rows, one hot source, groups cut across partitions; and its SQL."""

import hashlib
import zlib

import duckdb
from pyspark.sql import functions as F

from tidemill.llm import merkle, ranking

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The last node of a list, and of each of its nodes (siblings, function that folds a hash)."""
    if len(nodes) == 1:
        return nodes[0], [("", lambda x: x)]
    runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
    top, above = climb([h("".join(r)) for r in runs])
    out = []
    for r, (more, fold) in zip(runs, above):
        for k in range(len(r)):
            left, right = "".join(r[:k]), "".join(r[k + 1 :])
            out.append((left + right + more, lambda x, left=left, right=right, fold=fold: fold(h(left + x + right))))
    return top, out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r))) for s in order}
    trees = {s: climb([leaf_of(*r) for r in held[s]]) for s in order}
    root, tops = climb([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, (more, fold) in zip(order, tops):
        for r, (own, up) in zip(held[s], trees[s][1]):
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                changed = (r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            got = fold(up(leaf_of(*changed)))
            out.append((r[0], leaf_of(*r), trees[s][0], root, h(own + more), got, got == root))
    return sorted(out, key=repr)


def rows_of(n, hot):
    rows = [(i, f"Text {i} Élan ÀB" if i % 7 else None, "en" if i % 3 else None, None if i % 11 == 0 else "hot" if i % 2 else f"s{i % hot}", i * 3 if i % 5 else None) for i in range(n)]
    rows += [(None, "No id", "en", "hot", 1), (None, None, None, None, None), (5, "Other text of one id", "de", "hot", 2), (5, "Other text of one id", "de", "hot", 2), (6, "", "", "", 0)]
    return rows + [(10_000, "LONG " * 50_000, "x", "alone", 9), (7, "Ü" * 3, "fr", "é", 1), (8, "Z", "fr", "z", 1)]


def test_as_plain_python(spark, monkeypatch):
    monkeypatch.setattr(ranking, "partitions_for", lambda spark, size: 7)
    rows = rows_of(600, 20) + [(i, "a", "en", f"of {n}", 1) for n in (16, 17, 256, 257) for i in range(n)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", place int, g string, hash string")
    assert sorted((tuple(r) for r in merkle.verify(df).collect()), key=repr) == brute(rows)


def test_single_rows_and_none(spark):
    df = spark.createDataFrame([(1, "A", "en", "s", 1)], SCHEMA)
    r = merkle.verify(df).collect()[0]
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == h("") and r.verified
    assert merkle.verify(df.limit(0)).count() == 0


def test_sql_as_plain_python(spark):
    rows = rows_of(300, 20)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(merkle.verify_sql()).fetchall(), key=repr) == brute(rows)


def test_places_of_equal_rows_and_groups_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(ranking, "partitions_for", lambda spark, size: 9)
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 60)).alias("g"), (F.col("id") % 2).alias("v"))
    out = {}
    for r in ranking.places(df, "g", ["v"]).collect():
        out.setdefault(r.g, []).append((r.place, r.v))
    assert sum(map(len, out.values())) == 3000 and len(out["hot"]) == 2000
    for held in out.values():
        held.sort()
        assert [p for p, _ in held] == list(range(len(held))) and [v for _, v in held] == sorted(v for _, v in held)
