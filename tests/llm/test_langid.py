"""Language identification: bundles against one trigram at a time, prototypes over partitions, held-out accuracy, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import langid


def brute_vector(text):
    word = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    total = np.zeros(langid.SIZE)
    if word:
        padded = f" {word} "
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            total += langid.trigram_vector(ord(a), ord(b), ord(c))
    return total


TEXTS = ["The cat, sat.", "", "x", "12 34!", "Ünïcode Straße ÉTÉ", "日本語のテキスト", "a" * 50, "İstanbul ŉ", "no\nline\tbreaks", "𝒜𝒷 math", "one two " * 40]


def test_bundles_one_trigram_at_a_time():
    got = np.concatenate(list(langid.vectors(TEXTS)))
    assert np.array_equal(got, np.stack([brute_vector(t) for t in TEXTS]))
    assert set(np.unique(langid.trigram_vector(97, 98, 99))) == {-1, 1} and not np.array_equal(langid.trigram_vector(97, 98, 99), langid.trigram_vector(99, 98, 97))


def test_long_texts_and_wide_alphabets_in_slices(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK_CHARS", 40)
    monkeypatch.setattr(langid, "CELLS", 5_000)
    rng = np.random.default_rng(1)
    texts = [*TEXTS, " ".join("".join(chr(int(x)) for x in rng.integers(0x4E00, 0x4E80, 5)) for _ in range(100)), "long words " * 200]
    assert np.array_equal(np.concatenate(list(langid.vectors(texts))), np.stack([brute_vector(t) for t in texts]))


def test_prototypes_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 2)
    rows = [(i, t, f"l{i % 7}" if i % 11 else None) for i, t in enumerate(TEXTS * 12)] + [(None, "no id", "l1"), (3, None, "l2")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, place int").repartition(5)
    want = {}
    for i, t, lang in rows:
        if lang and t and (i is None or zlib.crc32(str(i).encode()) % 5):
            want[lang] = want.get(lang, 0) + brute_vector(t)
    got = {lang: np.zeros(langid.SIZE) for lang in want}
    for r in langid.prototypes(df).collect():
        got[r.lang][r.place] = r.value
    assert all(np.array_equal(got[x], want[x]) for x in want)


def test_held_out_accuracy_and_cosines(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in df.collect()}
    profiles = langid.learn(df)
    got = langid.judge(df, profiles).collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in got if r.held_out]) > 0.98
    for r in got[:40]:
        v = brute_vector(rows[r.doc_id].text)
        cosine = profiles.own @ v / np.linalg.norm(v)
        assert profiles.names[int(cosine.argmax())] == r.lang_pred and abs(cosine.max() - r.score) < 1e-6


def test_odd_rows(spark):
    rows = [(0, "der die das und ist nicht", "de", 1), (1, "the and that with this", "en", 1), (2, "le la les et des", "fr", 1), (None, "the THE the", None, 2), (4, None, "en", 2), (5, "", "en", 2), (6, "123 !?", "en", 2), (7, "the", "de", 2), (7, "the", "de", 2), (8, "und nicht " * 50_000, None, 2), (9, "x", None, 3)]
    df = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string")
    got = {}
    for r in langid.judge(df).collect():
        got.setdefault(r.doc_id, []).append((r.held_out, r.lang_pred, r.score))
    assert sum(map(len, got.values())) == len(rows) and len(got[7]) == 2 and got[7][0] == got[7][1]
    assert [got[k][0][1:] for k in (4, 5, 6)] == [("und", 0.0)] * 3 and got[None][0][:2] == (False, "en") and got[8][0][1] == "de"
    assert langid.judge(df.limit(0)).count() == 0
    # nothing to learn from
    assert {r.lang_pred for r in langid.judge(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
