"""Terms counted within rows against the columns of ``functions.text``."""

from collections import Counter

from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.operators import terms

TEXTS = [(1, "The ETCH-RF-DRIFT 告警 and a.b/c the-end"), (1, "etch drift"), (2, "湿法清洁ABC湿 １２ ﬁne"), (3, None), (4, ""), (None, "drift"), (5, "İstanbul x_y-z. ünder e.g."), (6, "the and")]


def test_rows_hold_the_tokens_of_a_text(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(TEXTS)], "doc_id long, text string")
    want = {r.doc_id: Counter(r.t or []) for r in docs.select("doc_id", tx.tokenize(F.col("text")).alias("t")).collect()}
    got = terms.rows(docs, "doc_id", "text").collect()
    assert {r.id: Counter(dict(zip((r.terms or "").split(), r.tfs))) for r in got} == want and {r.id: r.dl for r in got} == {i: c.total() for i, c in want.items()}


def test_totals_of_rows_of_one_id(spark):
    for texts in (TEXTS, [(10 + i, t) for i, (_, t) in enumerate(TEXTS)]):
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        each = docs.select("doc_id", F.explode(tx.tokenize(F.col("text"))).alias("term"))
        want = {tuple(r) for r in each.groupBy("term").agg(F.count_distinct("doc_id"), F.count("*")).collect()}
        assert {tuple(r) for r in terms.totals(docs, "doc_id", "text").select("term", "df", "tf").collect()} == want
    # the terms of a task are added up before they are dealt
    plan = terms.totals(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "hashpartitioning(term" in plan
