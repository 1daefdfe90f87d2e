"""Keyword and vector retrieval, fusion and cuts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..scratch import written

K1, B, RRF_K = 1.2, 0.75, 60
#: How many rows each step of the cascade keeps: chunks, sections, candidates for reranking, results.
CHUNKS, SECTIONS, RERANKED, RESULTS = 30, 10, 8, 3


def query_tokens(query: str) -> list[str]:
    """Distinct tokens of a query, in order; the same rule as ``functions.text.tokenize``, for a driver-side literal."""
    import re
    import unicodedata

    out: list[str] = []
    for token in re.findall(r"[a-z0-9]+(?:[-_./][a-z0-9]+)*|[㐀-鿿豈-﫿]+", unicodedata.normalize("NFKC", query).lower()):
        if re.match("[a-z0-9]", token):
            parts = [token, *(re.split("[-_./]", token) if re.search("[-_./]", token) else [])]
            out += [p for p in parts if p and p not in tx.STOPWORDS]
        else:
            out += [token] if len(token) == 1 else [token[i : i + 2] for i in range(len(token) - 1)]
    return list(dict.fromkeys(out))


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """An inverted index below ``path``: ``postings`` (term, _id, tf) in order of the terms, and ``lengths`` (_id, dl).

    A search reads the row groups of its terms and the lengths, not the texts. Texts are matched once. Rows of one id
    count as one document.
    """
    counted = tx.token_rows(docs, id_col, text_col).groupBy("_id", "term").agg(F.count("term").alias("tf"))
    spark = docs.sparkSession
    counted.write.parquet(f"{path}/counts")
    held = spark.read.parquet(f"{path}/counts")
    held.where("term is not null").repartitionByRange("term").sortWithinPartitions("term", "_id").write.parquet(f"{path}/postings")
    held.groupBy("_id").agg(F.sum("tf").alias("dl")).write.parquet(f"{path}/lengths")


def search_index(spark: SparkSession, path: str, query: str, id_col: str = "doc_id", min_should_match: float = 0.0, where: Column | None = None) -> DataFrame:
    """id, score, matched from an index that ``build_index`` wrote; ``where`` is a filter on the id."""
    terms = query_tokens(query)
    lengths = spark.read.parquet(f"{path}/lengths")
    found = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(terms))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    held = [F.count_if(F.col("term") == t).alias(f"df{i}") for i, t in enumerate(terms)]
    by_doc = found.groupBy("_id").agg(*[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)])
    rows = by_doc.join(lengths, "_id")
    return _scored(rows, stats.crossJoin(found.agg(F.count("*").alias("_n"), *held)), terms, id_col, min_should_match, where)


def term_counts(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """_id, dl, tf0, tf1, ...: one narrow row for each document. One matching of each text, counted within its row; rows of one id are added up."""
    rows = docs.select(F.col(id_col).alias("_id"), tx.token_counts(F.col(text_col), terms).alias("_c"))
    return rows.groupBy("_id").agg(F.sum("_c.dl").alias("dl"), *[F.sum(F.get("_c.tf", F.lit(i))).alias(f"tf{i}") for i in range(len(terms))])


def _scored(rows: DataFrame, stats: DataFrame, terms: list[str], id_col: str, min_should_match: float, where: Column | None) -> DataFrame:
    """Scores of rows (_id, dl, tf0, ...) by one row of statistics (n, avgdl, df0, ...), of ids that pass ``where``."""
    rows = rows.crossJoin(F.broadcast(stats))
    norm = F.lit(K1) * (1 - B + F.lit(B) * F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(F.lit(1.0)))
    score, matched = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.when(tf > 0, F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + norm)).otherwise(F.lit(0.0))
        matched = matched + F.when(tf > 0, 1).otherwise(0)
    need = max(1, math.ceil(min_should_match * len(terms)))
    out = rows.select(F.col("_id").alias(id_col), score.alias("score"), matched.alias("matched")).where((F.col("matched") >= need) & (F.col("score") > 0))
    return out if where is None else out.where(where)


def bm25(docs: DataFrame, query: str, id_col: str, text_col: str, min_should_match: float = 0.0, where: Column | None = None) -> DataFrame:
    """id, score, matched of all documents that match; statistics are of all ``docs``, only scoring is filtered by ``where``, on the id.

    Each document becomes one narrow row with its length and a count for each query term, which is written once; then
    statistics are one aggregate to a single row and scores a projection. Rows of one id count as one document. For many
    queries over one corpus, ``build_index`` spares reading the texts.
    """
    terms = query_tokens(query)
    narrow = written(term_counts(docs, terms, id_col, text_col), "terms")
    stats = narrow.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    return _scored(narrow, stats, terms, id_col, min_should_match, where)


def nearest(vectors: DataFrame, query: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, score: cosine of each unit vector with the one row of ``query`` (column q)."""
    return vectors.crossJoin(F.broadcast(query.select("q").limit(1))).select(F.col(id_col), tx.cosine(F.col(vector_col), F.col("q")).alias("score"))


def top(scored: DataFrame, id_col: str, k: int) -> DataFrame:
    """The k best with their rank; ties by id. The window only sees k rows."""
    best = scored.orderBy(F.desc("score"), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def pool(ranked: DataFrame, group_col: str, k: int = SECTIONS) -> DataFrame:
    """The best row of each group, in rank order."""
    first = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(group_col).orderBy("rank"))).where("_n = 1").drop("_n")
    return first.orderBy("rank").limit(k).withColumn("rank", F.row_number().over(Window.orderBy("rank")))


def fuse(keyword: DataFrame, vector: DataFrame, id_col: str) -> DataFrame:
    """Reciprocal rank fusion; ties by the keyword list, then the vector list."""
    a = keyword.select(id_col, F.col("rank").alias("keyword_rank"))
    b = vector.select(id_col, F.col("rank").alias("vector_rank"))
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    return a.join(b, id_col, "full_outer").withColumn("score", part("keyword_rank") + part("vector_rank"))


def fused_order() -> list[Column]:
    return [F.desc("score"), F.coalesce("keyword_rank", F.col("vector_rank") + 1_000_000)]


def relevance_cut(fused: DataFrame, cosine_col: str | None = None, floor: float | None = None, relevance_col: str | None = None, least: int = 2, k: int = RESULTS) -> DataFrame:
    """By given relevance if there is any; else rows of the keyword list or with a cosine of at least the floor."""
    if relevance_col is not None:
        return fused.where(F.col(relevance_col) >= least).orderBy(F.desc(relevance_col), *fused_order()).limit(k)
    if floor is not None and cosine_col is not None:
        fused = fused.where(F.col("keyword_rank").isNotNull() | (F.coalesce(cosine_col, F.lit(0.0)) >= floor))
    return fused.orderBy(*fused_order()).limit(k)


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, query_vector: DataFrame, id_col: str = "doc_id", text_col: str = "text", vector_id: str = "vec_id", vector_col: str = "embedding", k: int = SECTIONS, min_should_match: float = 0.3) -> DataFrame:
    """id, keyword_rank, vector_rank, score: the best of both lists."""
    words = top(bm25(docs, query, id_col, text_col, min_should_match), id_col, CHUNKS)
    near = top(nearest(vectors.withColumnRenamed(vector_id, id_col), query_vector, id_col, vector_col), id_col, CHUNKS)
    return fuse(words, near, id_col).orderBy(*fused_order()).limit(k)


def matches_filter(doc_type: str | None = None, code: str | None = None, tool: str | None = None) -> Column | None:
    """All that is asked for, on columns type, codes and tools; none if nothing is."""
    parts = [F.col("type") == doc_type if doc_type else None, F.array_contains("codes", code) if code else None, F.array_contains("tools", tool) if tool else None]
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out & p
    return out


def relaxed(rows: DataFrame, test: Column | None) -> DataFrame:
    """The rows that pass the test, or all of them if none does, with ``relaxed`` telling which. One aggregate to a single row."""
    if test is None:
        return rows.withColumn("relaxed", F.lit(False))
    held = rows.withColumn("_hit", F.coalesce(test, F.lit(False)))
    any_ = held.agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("_any"))
    return held.crossJoin(F.broadcast(any_)).where(F.col("_hit") | ~F.col("_any")).withColumn("relaxed", ~F.col("_any")).drop("_hit", "_any")


def retrieve(sections: DataFrame, chunks: DataFrame, query: str, query_vector: DataFrame | None = None, relevance: DataFrame | None = None, test: Column | None = None, floor: float | None = None, mode: str = "hybrid", k: int = RESULTS) -> DataFrame:
    """section_id, rank, score, keyword_rank, vector_rank, fused_rank, matched_by, relevance, relaxed: the whole cascade.

    ``sections``: section_id and what ``test`` reads; ``chunks``: chunk_id, section_id, text, vector. The 30 best chunks of
    either list make the 10 best sections, whose ranks are fused; the first 8 are put in the order of their ``relevance``
    (section_id, relevance), of which 2 is the least, or else cut by the keyword list or a cosine of ``floor``; k remain.
    Without a vector of the query the keyword list is all.
    """
    allowed = relaxed(sections, test).select("section_id", "relaxed")
    home = chunks.select("chunk_id", "section_id")
    inside = lambda scored: scored.join(home, "chunk_id").join(allowed, "section_id")
    words = pool(top(inside(bm25(chunks, query, "chunk_id", "text", 0.3)), "chunk_id", CHUNKS), "section_id")
    empty = words.limit(0)
    if query_vector is None or mode == "bm25":
        mode, near = "bm25", empty
    else:
        near = pool(top(inside(nearest(chunks, query_vector, "chunk_id", "vector")), "chunk_id", CHUNKS), "section_id")
    shown = lambda rows, name: rows.select("section_id", F.col("rank").alias(f"{name}_rank"), F.col("score").alias(f"{name}_score"))
    both = written(shown(words, "keyword").join(shown(near, "vector"), "section_id", "full_outer"), "ranks")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    if mode == "hybrid":
        listed = both.withColumn("score", part("keyword_rank") + part("vector_rank"))
        order = fused_order()
    else:
        own = "keyword" if mode == "bm25" else "vector"
        listed, order = both.where(F.col(f"{own}_rank").isNotNull()).withColumn("score", F.col(f"{own}_score")), [F.col(f"{own}_rank")]
    fused = listed.orderBy(*order).limit(SECTIONS).withColumn("fused_rank", F.row_number().over(Window.orderBy(*order)))
    fused = fused.withColumn("matched_by", F.array_compact(F.array(F.when(F.col("keyword_rank").isNotNull(), "bm25"), F.when(F.col("vector_rank").isNotNull(), "vector"))))
    if relevance is not None:
        judged = fused.where(F.col("fused_rank") <= RERANKED).join(relevance, "section_id", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))
        kept, last = judged.where("relevance >= 2"), [F.desc("relevance"), F.col("fused_rank")]
    else:
        kept, last = fused.withColumn("relevance", F.lit(None).cast("int")), [F.col("fused_rank")]
        if floor is not None and mode != "bm25":
            kept = kept.where(F.col("keyword_rank").isNotNull() | (F.coalesce("vector_score", F.lit(0.0)) >= floor))
    best = kept.orderBy(*last).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*last)))
    return best.join(F.broadcast(allowed.select("relaxed").limit(1)), F.lit(True)).select("section_id", "rank", "score", "keyword_rank", "vector_rank", "fused_rank", "matched_by", "relevance", "relaxed")


def score_rankings(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, hit1, recall3, recall5, recall8, mrr, ndcg5 of each query that has relevant rows.

    ``ranked``: query_id, id, rank; ``relevant``: query_id, id, each once. A query without a ranking has zeros.
    """
    rows = relevant.select("query_id", "id").join(ranked.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    at = lambda n: F.count_if(F.col("rank") <= n)
    gain = F.coalesce(F.sum(F.when(F.col("rank") <= 5, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(5), F.count("*").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return rows.groupBy("query_id").agg(
        F.when(at(1) > 0, 1).otherwise(0).alias("hit1"),
        *[(at(n) / F.count("*")).alias(f"recall{n}") for n in (3, 5, 8)],
        F.coalesce(1.0 / F.min(F.when(F.col("rank") <= 10, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        (gain / best).alias("ndcg5"),
    )


MEASURES = ("hit1", "recall3", "recall5", "recall8", "mrr", "ndcg5")


def mean_scores(scored: DataFrame, *by: str) -> DataFrame:
    """The means of the measures, over all queries or by a column; 0 over none."""
    means = [F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in MEASURES]
    return scored.groupBy(*by).agg(*means) if by else scored.agg(*means)


def evaluate_stages(stages: dict[str, DataFrame], relevant: DataFrame, negatives: DataFrame) -> DataFrame:
    """stage, the mean measures and ``abstain``, the share of the queries without relevant rows (``negatives``: query_id) that a stage answers with nothing."""
    out = None
    for name, ranked in stages.items():
        empty = negatives.join(ranked.select("query_id").distinct(), "query_id", "left_anti").agg(F.count("*").alias("e"))
        share = negatives.agg(F.count("*").alias("n")).crossJoin(empty).select(F.coalesce(F.try_divide("e", "n"), F.lit(0.0)).alias("abstain"))
        one = mean_scores(score_rankings(ranked, relevant)).crossJoin(share).select(F.lit(name).alias("stage"), *MEASURES, "abstain")
        out = one if out is None else out.unionByName(one)
    return out
