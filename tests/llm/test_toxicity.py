"""Restoring against an exhaustive search of small lattices, long disguises, other alphabets, and recomputed scores."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import toxicity


@pytest.fixture(scope="module")
def restorer():
    text = "the idiot and the moron lost the stupid trash in the worthless pathetic clown show you blöd fool " * 50
    code = toxicity.letter_codes()[np.frombuffer(text.encode(), np.uint8)]
    counts = np.bincount(code[:-2] * 729 + code[1:-1] * 27 + code[2:], minlength=27**3)
    return toxicity.Restorer(toxicity.trigram_costs(enumerate(counts.tolist())))


def path_cost(costs, letters, price):
    a = b = 26
    for c in [*letters, None]:
        k = 26 if c is None or not "a" <= c <= "z" else ord(c) - 97
        price += costs[a][b][k]
        a, b = b, k
    return price


def test_viterbi_is_the_least_of_all_paths(restorer):
    rng = random.Random(5)
    for _ in range(300):
        singly = rng.random() < 0.4
        seen = "".join(rng.choice("aidot10@$!3456öß2") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(1, 5)))[: 6 if singly else 9]
        best = min(path_cost(restorer.costs, "".join(x for x, _ in p), sum(w for _, w in p)) for p in itertools.product(*restorer.lattice(seen, singly)))
        got = restorer.restore(seen, singly)
        own = min(path_cost(restorer.costs, "".join(x for x, _ in p), sum(w for _, w in p)) for p in itertools.product(*restorer.lattice(seen, singly)) if "".join(x for x, _ in p) == got)
        assert math.isclose(best, own, abs_tol=1e-9), (seen, got)


def test_disguises_of_any_length_and_alphabet(restorer):
    words = lambda t: toxicity.token_sets([t], restorer)[0]
    assert "stupid" in words("st" + "u" * 5000 + "pid") and any(len(w) == 30 and w.startswith("idiot") and w.isalpha() for w in words("1d10t" * 6))
    assert "blöd" in words("b1öd") and "blöd" in words("blööööööd")
    assert {"idiot", "stupid"} <= words("i d i o t, s.t.u.p.i.d!") and "worthless" in words(" ".join("worthless"))
    long = toxicity.token_sets(["x1" * 200_000 + " " + " ".join("idiot" * 20_000)], restorer)[0]
    assert max(map(len, long)) >= 200_000
    assert words("1 2 3 4 5 6 7") == set("1234567") and words("") == set() and words("plain words only") == {"plain", "words", "only"}


def test_mixed_separators_groups_and_rare_doubles(restorer, monkeypatch):
    monkeypatch.setattr(toxicity, "RARE_COST", 4.0)  # the fixture's few words leave chances that a corpus does not
    words = lambda t: toxicity.token_sets([t], restorer)[0]
    assert "idiot" in words("you i d-i o.t") and "stupid" in words("so st.up.id!") and "stupid" in words("s_t-u.p_i-d")
    assert "stupid" in words("a stuupid one") and "idiot" in words("the idioot, again") and "moron" in words("mo-r-on")
    # what the model expects stays as it is, and long parts are names, not disguises
    assert words("the foolish pathetic") == {"the", "foolish", "pathetic"} and words("clown-show.text") == {"clown-show.text"}
    costs, low = restorer.table, "idioot lost moron stuupid"
    code, kind = toxicity._points(low)
    want = [i for i in range(2, len(low)) if low[i] == low[i - 1] and low[i].isalpha() and costs[ord(low[i - 2]) - 97 if low[i - 2] != " " else 26][ord(low[i]) - 97][ord(low[i]) - 97] >= toxicity.RARE_COST]
    assert toxicity._rare_doubles(code, kind, costs).tolist() == want and want


def test_scores_are_the_models(spark):
    """Fitted twice on labels that differ in rows held out only; scores are recomputed from the weights; odd rows have scores."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    extra = spark.createDataFrame([(900_001, None), (900_002, ""), (900_003, "idiot " * 50_000), (900_004, "1d10t " + "x" * 300_000), (900_005, "same text"), (900_005, "same text"), (None, "idiot loser")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra).withColumn("score", F.lit("s")).withColumn("words", F.lit(1)).withColumn("toxic", F.lit(1)).withColumn("predicted", F.lit(7))
    model = toxicity.fit(both, labels)
    restorer = toxicity.Restorer(model.costs)
    rows = toxicity.score(both, model).collect()
    texts = {(r.doc_id, zlib.crc32((r.text or "").encode())): r.text for r in both.collect()}
    assert len(rows) == both.count()
    want = sorted((i if i is not None else -1, round(1 / (1 + math.exp(-model.constant - sum(w for f, w in model.weights.items() if f in toxicity.features_of(toxicity.token_sets([t or ""], restorer)[0])))), 9)) for (i, _), t in texts.items())
    got = sorted((r.doc_id if r.doc_id is not None else -1, round(r.score, 9)) for r in rows if r.doc_id != 900_005)
    assert got == [w for w in want if w[0] != 900_005] and len({r.score for r in rows if r.doc_id == 900_005}) == 1
    assert all(w >= 0 for w in model.weights.values()) and len(model.weights) <= toxicity.FEATURES
    kept = toxicity.keep(both, model)
    assert kept.columns == both.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score < 0.5}
    # two labels for one id: 1 counts, whatever the order
    twice = labels.unionByName(labels.withColumn("toxic", F.lit(0).cast(labels.schema["toxic"].dataType)))
    again = toxicity.fit(both, twice.orderBy(F.rand(1)))
    assert again.weights == model.weights and again.constant == model.constant
