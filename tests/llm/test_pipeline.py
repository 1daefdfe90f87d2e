"""Every stage of the pipeline against plain Python, on a table with odd rows."""

from collections import Counter

import pytest
from test_operators import brute_contaminated, roots
from test_secrets import blanked, spans_of

from tidemill.llm import bpe, simhash, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    first = docs.collect()[0]
    more = [(900_000, None), (900_001, ""), (900_002, " \n"), (900_003, first.text), (900_003, first.text), (900_003, "another text of one id that nothing is like, not even in part"), (None, "a row without an id, token = abcdefgh12345678"), (900_004, "long " * 60_000), (900_005, f"lead in {items[0][1]} and out"), (900_006, "key: secret=abcdefgh1234 é end"), (900_007, "idiot scum loser moron stupid trash pathetic worthless")]
    extra = spark.createDataFrame([(i, t, "en", "x", None if t is None else len(t)) for i, t in more], docs.schema)
    held = [docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra)]
    for name, stage in p.STAGES:
        held.append(p.spill_table(stage(spark, held[-1], sf), name))
    return held, items


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_all_but_the_last_keep_the_columns(stages):
    held, _ = stages
    assert all(df.columns == held[0].columns and [f.dataType for f in df.schema] == [f.dataType for f in held[0].schema] for df in held[:-1])


def test_toxic_documents_go(spark, sf, stages):
    held, _ = stages
    model = toxicity.fit(held[0], spark.read.parquet(f"{sf}/labels.parquet"))
    restorer = toxicity.Restorer(model.costs)
    want = Counter({k: n for k, n in pairs(held[0]).items() if model.scores([k[1] or ""], restorer)[0] < 0.5})
    assert pairs(held[1]) == want and (900_007, "idiot scum loser moron stupid trash pathetic worthless") not in want or not model.weights


def test_one_of_each_group_stays(stages):
    held, _ = stages
    rows = sorted(((i, t) for i, t in pairs(held[1]) if i is not None), key=lambda x: (x[0], x[1] or ""))
    codes = simhash.word_codes([t or "" for _, t in rows])
    far = lambda c, i, j: (int(codes[c][i]) ^ int(codes[c][j])).bit_count()
    links = [(i, j) for i in range(len(rows)) for j in range(i) if min(far(0, i, j), far(1, i, j), far(4, i, j)) <= 3 and far(2, i, j) + far(3, i, j) <= simhash.check_bits()]
    root = roots(len(rows), links)
    got, groups = pairs(held[2]), {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(rows[i])
    for own in groups.values():
        kept = [x for x in own if x in got]
        assert len(kept) == 1 and got[kept[0]] == 1 and kept[0][0] == min(i for i, _ in own)
    assert sum(got.values()) == len(groups) + sum(n for (i, _), n in pairs(held[1]).items() if i is None)


def test_documents_with_items_go(stages):
    held, items = stages
    rows = pairs(held[2])
    bad = {k for k in rows if brute_contaminated([(0, k[1])], items)}
    assert pairs(held[3]) == Counter({k: n for k, n in rows.items() if k not in bad}) and any(i == 900_005 for i, _ in bad)


def test_secrets_are_blanked(stages):
    held, _ = stages
    want = Counter()
    for (i, t), n in pairs(held[3]).items():
        want[i, t and blanked(t, spans_of(t)[1])] += n
    assert pairs(held[4]) == want
    assert all(r.n_chars == len(r.text) for r in held[4].where("text is not null").collect())


def test_the_rest_is_encoded(stages):
    import public_tokenizers
    import tiktoken

    held, _ = stages
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder(None).vocabulary.ranks, special_tokens={})
    want = Counter((i, tuple(library.encode_ordinary(t or ""))) for (i, t), n in pairs(held[4]).items() for _ in range(n))
    assert Counter((r.doc_id, tuple(r.ids)) for r in held[5].collect()) == want


def test_clashing_names(spark, sf):
    import corpus_pipeline as p

    text = "one two three four five six seven eight nine ten " * 3
    docs = spark.createDataFrame([(1, text, 5, "x", "y"), (2, text + "!", 6, None, "y"), (3, "unlike the others in all its words", 7, "z", None), (None, text, 8, "k", "y")], "doc_id long, text string, _key long, `__KEY` string, component_id string")
    held = docs
    for _, stage in p.STAGES[:4]:
        held = stage(spark, held, sf)
        assert held.columns == docs.columns
    assert sorted((r.doc_id or 0, r._key, r["__KEY"], r.component_id) for r in held.collect()) == [(0, 8, "k", "y"), (1, 5, "x", "y"), (3, 7, "z", None)]
    assert p.STAGES[4][1](spark, held, sf).count() == 3


def test_empty_table(spark, sf, stages):
    import corpus_pipeline as p

    docs = stages[0][0].limit(0)
    for _, stage in p.STAGES:
        docs = p.spill_table(stage(spark, docs, sf), "empty")
    assert docs.count() == 0
