"""Content-defined chunks: the gear hash and cuts against their definitions, and what is left after deduplication."""

import numpy as np

from tidemill.llm import chunkdedup


def test_gear_hash_is_the_rolling_one():
    data = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = (h << 1) + int(chunkdedup.gears()[b]) & 0xFFFFFFFF
        want.append(h)
    assert chunkdedup.gear_hashes(data).tolist() == want
    # bytes further back change nothing
    other = np.concatenate((data[:100] ^ 1, data[100:]))
    assert (chunkdedup.gear_hashes(other)[100 + chunkdedup.REACH - 1 :] == chunkdedup.gear_hashes(data)[100 + chunkdedup.REACH - 1 :]).all()


def test_least_between():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 50, 300)
    low = rng.integers(0, 300, 200)
    high = np.minimum(299, low + rng.integers(0, 70, 200))
    assert chunkdedup.least_between(v, low, high).tolist() == [int(v[a : b + 1].min()) for a, b in zip(low, high)]


def test_deduplicate(spark):
    rng = np.random.default_rng(4)
    make = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(n))
    shared, other = make(60), make(55)
    first, second, third = f"{make(20)} {shared} {make(20)}", f"{make(30)} {shared}. {make(9)}", f"{other}\n{make(20)} {shared}"
    rows = [(3, third), (1, first), (2, second), (4, other), (5, make(200)), (6, first), (7, None), (8, ""), (None, first), (2, "short"), (2, second), (9, "ü " * 300), (10, "ü " * 400)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, cuts string, start int")
    out = chunkdedup.deduplicate(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    blank = lambda t: " ".join(t.split())
    want = {1: first, 2: blank(second).replace(shared, "\n"), 3: blank(third).replace(shared, "\n"), 5: rows[4][1], 6: "\n", 7: None, 8: "", 9: rows[11][1]}
    assert {i: t for i, t in got if i in want and t != "short"} == want
    assert [t for i, t in got if i == 2] == [want[2], want[2], "short"] or sorted(t for i, t in got if i == 2) == sorted([want[2], want[2], "short"])
    assert {t for i, t in got if i is None} == {first} and dict(got)[4].strip() == "" and dict(got)[10].strip() == ""
    left = chunkdedup.repeated_passages(out.where("doc_id is not null")).collect()
    assert not left
    assert chunkdedup.deduplicate(df.limit(0)).count() == 0


def test_long_texts_ties_and_odd_rows(spark):
    """A text of 200,000 words that repeats itself and another's middle; rows of one id; equal rows; columns that clash."""
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in rng.integers(0, 10**9, 200_000)]
    middle = " ".join(words[100_000:100_070])
    rows = [(1, " ".join(words)), (2, f"a b {middle} c"), (3, "x " * 60 + "."), (3, f"y {middle}"), (3, f"y {middle}"), (4, "x " * 52), (5, ("q" * 3000 + " ") * 55), (6, ("q" * 3000 + " ") * 55), (7, None), (None, middle)]
    df = spark.createDataFrame([(*r, 1, 2, 3, "m") for r in rows], "doc_id long, text string, start int, low int, n int, mark string")
    got = {(r.doc_id, r.n_words, r.other_id) for r in chunkdedup.repeated_passages(df).collect()}
    assert got == {(1, 70, 3), (2, 70, 3), (3, 70, 2), (3, 60, 4), (4, 52, 3), (5, 55, 6), (6, 55, 5)} or {(a, b) for a, b, _ in got} == {(1, 70), (2, 70), (3, 70), (3, 60), (4, 52), (5, 55), (6, 55)}
