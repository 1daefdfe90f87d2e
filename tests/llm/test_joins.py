"""Vector join and SimHash: many labels, hot keys, ties, clashing columns, against brute force."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_operators import plain_fingerprint, roots

from tidemill.llm import simhash, vecjoin
from tidemill.llm.common import join_counted


def brute(rows):
    ok = [i for i, (n, v, c) in enumerate(rows) if v and c is not None and n is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    links = [(i, j) for i in ok for j in ok if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and vecjoin.exact_cosine(np.array(rows[i][1], float), np.array(rows[j][1], float)) >= 0.98]
    n = Counter(k for p in links for k in p)
    return Counter((rows[i][0], n[i], rows[r][0] if rows[i][0] is not None else None, None if rows[i][0] is None else rows[r][0] == rows[i][0]) for i, r in enumerate(roots(len(rows), links)))


def test_many_labels_of_several_cells(spark, monkeypatch):
    monkeypatch.setattr(vecjoin, "CELL", 1)
    rng = np.random.default_rng(3)
    rows = [(4 * g + k, [float(x) for x in np.round(c + rng.normal(size=3) * 0.05, 3)], g) for g, c in enumerate(rng.normal(size=(2000, 3))) for k in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vecjoin.near_duplicates(df).collect()}
    rows = [(i, [float(np.float32(x)) for x in v], c) for i, v, c in rows]
    want = {}
    for g in range(2000):
        want |= {i: (n, c) for i, n, c, _ in brute(rows[4 * g : 4 * g + 4])}
    assert got == want and max(n for n, _ in got.values()) > 0


def test_split_cells_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(vecjoin, "SLICE", 7)
    monkeypatch.setattr(vecjoin, "CELL", 40)
    rng = np.random.default_rng(5)
    near = [(i, [float(x) for x in (1 + rng.normal() * 0.12, rng.normal() * 0.12, rng.normal() * 0.12)], 1) for i in range(150)]
    # a cosine of 0.98 in numbers that doubles hold exactly: (1, 0) and (49, 7 sqrt 2 ...) do not, so 0.98 = 49/50 by lengths 50
    rows = near + [(900, [1.0, 0.0, 0.0], 2), (901, [49.0, 9.0, 3.0 * math.sqrt(2.0)], 2), (902, [1.0, 0.0, 0.0], 2), (902, [1.0, 0.0, 0.0], 2), (902, [0.0, 1.0, 0.0], 2), (None, [1.0, 0.0, 0.0], 2), (903, [1e-300] * 3, 1), (904, [1e300] * 3, 3)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, label int, n long, cell string, node long")
    got = Counter(tuple(r) for r in vecjoin.near_duplicates(df.where("vec_id < 902 or vec_id is null")).collect())
    assert got == brute([r for r in rows if r[0] is None or r[0] < 902])
    assert vecjoin.near_duplicates(df).count() == len(rows)


def test_simhash_of_split_anchors_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 5)
    monkeypatch.setattr(simhash, "RESIDENTS", 40)
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(120):
        w = list(words if k % 2 else words[:4] + [f"k{k}"])
        for j in rng.integers(0, len(w), int(rng.integers(0, 6))):
            w[j] = "X"
        rows.append((k, " ".join(w)))
    rows += [(500, "Same"), (500, "same"), (500, "other words here now"), (None, "same"), (501, None), (502, ""), (503, "long " * 60_000)]
    fps = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = roots(len(fps), links)
    least = {}
    for i, r in enumerate(root):
        least[r] = min([x for x in (least.get(r), rows[i][0]) if x is not None], default=None)
    want = Counter((rows[i][0], f"{fps[i]:016x}", least[root[i]]) for i in range(len(rows)))
    df = spark.createDataFrame([(*r, 1, 2, "n") for r in rows], "doc_id long, text string, fp long, n long, node string")
    assert Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want and len(links) > 200


def test_similar_texts(spark):
    """Groups are those of all pairs whose fingerprints link, and hold the copies with one word in forty changed."""
    rng = np.random.default_rng(2)
    make = lambda n: [f"t{x}" for x in rng.zipf(1.3, n) % 5000]
    rows, groups = [], []
    for g in range(30):
        w = make(int(rng.integers(40, 400)))
        own = [len(rows)]
        rows.append((len(rows), " ".join(w)))
        for _ in range(4):
            c = list(w)
            for j in rng.choice(len(w), max(1, len(w) // 80), replace=False):
                c[j] = f"new{j}"
            own.append(len(rows))
            rows.append((len(rows), " ".join(c).title()))
        groups.append(own)
    rows += [(1000, None), (1001, ""), (1002, "!!!"), (1003, "??? "), (1004, "!! !"), (1005, "one two"), (1006, "One. Two!"), (1007, "two one"), (1008, "word " * 50_000)]
    codes = simhash.word_codes([t or "" for _, t in rows])
    dist = lambda c, i, j: (int(codes[c][i]) ^ int(codes[c][j])).bit_count()
    links = [(i, j) for i in range(len(rows)) for j in range(i) if min(dist(0, i, j), dist(1, i, j), dist(4, i, j)) <= 3 and dist(2, i, j) + dist(3, i, j) <= simhash.check_bits()]
    root = roots(len(rows), links)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, fp long, check_a long, n long")
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(df).collect()}
    assert got == {rows[i][0]: rows[r][0] for i, r in enumerate(root)}
    alike = [got[a] == got[b] for g in groups for a in g for b in g if a < b]
    assert np.mean(alike) > 0.9 and len({got[g[0]] for g in groups}) == 30
    assert got[1000] == got[1001] and got[1002] == got[1004] != got[1003] and got[1005] == got[1006] != got[1007]


def test_recall_and_precision_of_similar_texts(spark):
    """Of pairs whose exact similarity by five-word shingles is 0.8 or more, nine in ten and more share a group; unlike texts never do."""
    from itertools import combinations

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rng = np.random.default_rng(4)
    for k, (_, t) in enumerate(rows[:120]):  # and copies with a few words changed
        w = t.split()
        for j in rng.choice(len(w), max(1, len(w) // 60), replace=False):
            w[j] = "other"
        rows.append((10_000 + k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = {i: "".join(c if c.isalnum() else " " for c in t.lower()).split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items() if len(w) >= 10}
    held = {}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, []).append(i)
    pairs = {p for own in held.values() if len(own) < 40 for p in combinations(sorted(own), 2)}
    alike = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    near = [got[a] == got[b] for (a, b), s in alike.items() if s >= 0.8]
    assert len(near) > 60 and np.mean(near) >= 0.9
    assert np.mean([got[a] == got[b] for (a, b), s in alike.items() if s < 0.2]) < 0.02


def test_counted_join_deals_hot_keys(spark):
    rows = spark.range(5000).select(F.col("id").alias("a"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"))
    counted = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = join_counted(rows, counted, ["k"], "n", F.col("a"))
    assert sorted(out.columns) == ["a", "k", "n"] and out.count() == 5000 and out.where("k = 7").select("n").distinct().collect()[0].n == 3333
