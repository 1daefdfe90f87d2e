"""Search of whole query tables: block-max postings and the clustered vector store against comparing everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.operators import neighbours, postings, retrieval


@pytest.fixture(scope="module")
def index(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "words")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    postings.build(docs, path, block_docs=10)
    return path, docs


def test_every_query_as_scored_over_all_documents(spark, sf, index):
    path, docs = index
    texts = {1: "the erer that ingthe ed thore with re onthe", 2: "zzz unknown words", 3: "", 4: "worthless pathetic erer", 5: "thion und der the les"}
    queries = spark.createDataFrame(list(texts.items()), "query_id long, text string")
    for k, msm in ((3, 0.0), (7, 0.5)):
        found = postings.search(spark, path, queries, k, msm)
        got = {}
        for r in found.ranked.collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score, 9), r.matched))
        for q, text in texts.items():
            want = [(r["rank"], r.doc_id, round(r.score, 9), r.matched) for r in retrieval.top(retrieval.bm25(docs, text, "doc_id", "text", msm), "doc_id", k).collect()] if retrieval.query_tokens(text) else []
            assert sorted(got.get(q, [])) == sorted(want), q


def test_blocks_that_cannot_matter_are_not_read(spark, index):
    path, docs = index
    # each document's own beginning, so that one of them scores far above the others
    queries = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 150).alias("text"))
    found = postings.search(spark, path, queries, 1, first=1)
    read, all_ = found.read.count(), found.near.count()
    assert read < 0.5 * all_ and found.read.distinct().count() == read
    every = postings.search(spark, path, queries, 1, first=10**6)
    rows = lambda x: sorted((r.query_id, r.id, r.score) for r in x.ranked.collect())
    assert rows(found) == rows(every) and every.read.count() == all_


def test_restricted_ids_and_odd_documents(spark, tmp_path):
    path = str(tmp_path / "odd")
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "gamma"), (2, None), (3, ""), (None, "alpha"), (4, "alpha alpha"), (5, "ALPHA-7 beta")], "term long, text string")
    postings.build(docs, path, "term", "text", block_docs=1)
    queries = spark.createDataFrame([(1, "alpha"), (2, "alpha-7 beta gamma")], "query_id long, text string")
    got = postings.search(spark, path, queries, 5).ranked.collect()
    want = {(q, r.term, r["rank"], round(r.score, 9)) for q, t in ((1, "alpha"), (2, "alpha-7 beta gamma")) for r in retrieval.top(retrieval.bm25(docs.where("term is not null"), t, "term", "text"), "term", 5).collect()}
    assert {(r.query_id, r.id, r["rank"], round(r.score, 9)) for r in got} == want and len(got) == 6
    only = spark.createDataFrame([(4,)], "id long")
    assert sorted((r.query_id, r.id) for r in postings.search(spark, path, queries, 5, only=only).ranked.collect()) == [(1, 4), (2, 4)]


def test_nearest_of_every_vector(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbours, "SLICE", 15)
    monkeypatch.setattr(neighbours, "PART", 20)
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(12, 8))
    own = {i: middle[i % 12] + rng.normal(size=8) * 0.15 for i in range(240)}
    own |= {300 + i: own[i] for i in range(5)} | {400: np.zeros(8), 401: own[3] * 7}
    rows = [(i, [float(x) for x in v]) for i, v in own.items()] + [(402, None), (403, [float("nan")] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    neighbours.build(df, str(tmp_path / "v"))
    found, visits = neighbours.search(spark, str(tmp_path / "v"), df, 6, "vec_id", "embedding")
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    ok = [i for i, v in own.items() if np.linalg.norm(v)]
    unit = {i: own[i] / np.linalg.norm(own[i]) for i in ok}
    assert set(got) == set(ok)
    for q in ok:
        want = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in ok)[:6]
        own_rows = sorted(got[q])
        assert [r for r, _, _ in own_rows] == list(range(1, len(want) + 1)) and [i for _, i, _ in own_rows] == [i for _, i in want]
        assert np.allclose([s for _, _, s in own_rows], [-s for s, _ in want], atol=1e-8)
    cells = spark.read.parquet(str(tmp_path / "v") + "/cells").count()
    assert {r.id for r in found.where("query_id = 401").collect()} >= {3, 401}
    assert visits.distinct().count() == visits.count() < 0.7 * cells * len(ok)


def test_no_row_for_each_document_that_holds_a_term(spark, index):
    path, docs = index
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 150).alias("text"))
    any_, half = postings.search_shares(spark, path, queries, 3, (0.0, 0.5))
    rows = lambda x: sorted(tuple(r) for r in x.select("query_id", "id", "score", "matched", "rank").collect())
    assert rows(any_) == rows(postings.search(spark, path, queries, 3).ranked) and rows(half) == rows(postings.search(spark, path, queries, 3, 0.5, first=1).ranked)
    asked = postings._asked(spark, path, queries, (0.0,))
    blocks = spark.read.parquet(path + "/stats").first()["blocks"]
    passed = postings._scored(spark, path, postings._everywhere(spark, path, asked), 3, None)
    assert passed.count() <= 3 * blocks * asked.count() and passed.groupBy("query_id").count().count() == asked.count()
    # only the documents and the queries of each block are dealt
    assert passed._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_visits_are_told_by_numbers(spark, tmp_path, monkeypatch):
    held, own = {}, neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df, name: held.setdefault(name, own(df, name)))
    monkeypatch.setattr(neighbours, "STEP", 7)
    rng = np.random.default_rng(3)
    v = {i: rng.normal(size=6) for i in range(60)}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "vec_id long, embedding array<double>")
    neighbours.build(df, str(tmp_path / "v"))
    # a query that is asked twice with different vectors has the nearest of both
    asked = df.where("vec_id < 9").unionByName(spark.createDataFrame([(1, v[50].tolist())], "vec_id long, embedding array<double>"))
    got = {(r.query_id, r.id) for r in neighbours.search(spark, str(tmp_path / "v"), asked, 2, "vec_id", "embedding")[0].collect()}
    assert {(i, i) for i in range(9)} | {(1, 50)} <= got and len({q for q, _ in got}) == 9
    assert "vector" not in held["first-cells"].columns + held["other-cells"].columns


def test_best_partner_within_a_group(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP_SLICE", 8)
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], rng.normal(size=4).round(2).tolist()) for i in range(60)] + [(60, "a", [1.0, 2.0]), (61, "a", None), (62, "a", [1.0, None, 0.0, 0.0]), (63, "c", [1.0]), (64, "d", None), (65, "d", [1.0]), (66, None, [1.0]), (67, "e", [1.0, None]), (68, "e", [1.0, 2.0])]
    rows += [(70 + i, *rows[i][1:]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    # as each pair by itself
    a = df.select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    pairs = df.join(a, "label").where("vec_id <> query_id").select("query_id", "vec_id", F.round(tx.cosine(F.col("embedding"), F.col("q")), 6).alias("sim"))
    want = {tuple(r) for r in pairs.groupBy("query_id").agg(F.max(F.struct("sim", (-F.col("vec_id")).alias("neg"))).alias("b")).select("query_id", -F.col("b.neg"), "b.sim").collect()}
    best = neighbours.best_within(df, F.lit(True), "vec_id", "label", "embedding")
    assert {tuple(r) for r in best.collect()} == want and len(want) == 71
    assert "hashpartitioning(g" in (plan := best._jdf.queryExecution().executedPlan().toString()) and "slice" in plan
