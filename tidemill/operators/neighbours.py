"""Exact nearest neighbours of a whole table of queries in a clustered store of vectors.

The store keeps vectors by the cell of their nearest centre, with the radius of each cell. A vector of a cell is no nearer
to a query than the centre's distance less the radius. A search first looks at the cells of the least such bounds that
hold enough vectors; the k-th distance found there closes every cell whose bound is beyond it. So each query reads few
cells and finds what comparing it with every vector would.

Centres are a bounded sample, so they are sent to all tasks. Cells are dealt to slices, and the queries of a cell to parts,
so no task holds a cell, or all its queries, whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from ..scratch import written
from .postings import first_of

#: Centres at most, vectors of a slice and queries of a part on average.
CENTRES, SLICE, PART = 2048, 4096, 4096
#: Vectors that are compared with all centres at once.
STEP = 256
#: Decimals of a cosine, below which it is a tie, and what that and rounding may add to a distance.
DIGITS, SLACK = 9, 1e-4


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(column: str) -> F.Column:
    """The vector at length one; null if it has none."""
    total = F.aggregate(F.col(column), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when((total > 0) & (total < float("inf")), F.transform(F.col(column), lambda x: x.cast("double") / F.sqrt(total)))


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str, name: str) -> DataFrame:
    """name, vector: unit vectors; those that are null, zero, or hold null or non-finite numbers are left out, as are null ids."""
    rows = vectors.select(F.col(id_col).cast("long").alias(name), _unit(vector_col).alias("vector"))
    return rows.where(F.col(name).isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", centres: int | None = None) -> None:
    """A store below ``path``: ``vectors`` (cell, slice, id, vector) and ``cells`` (cell, centre, radius, n). All vectors have one length."""
    spark = vectors.sparkSession
    rows = written(unit_rows(vectors, id_col, vector_col, "id"), "unit-vectors")
    n = rows.count()
    most = min(CENTRES, centres or max(1, math.isqrt(n)))
    middle = _matrix(pa.array([r.vector for r in rows.orderBy(F.xxhash64("id"), "id").limit(most).collect()], pa.list_(pa.float64())))
    held = spark.sparkContext.broadcast(middle)
    slices = max(1, math.ceil(n / SLICE))  # of a cell that held all vectors

    def deal(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                v = _matrix(part.column(1))
                gap = np.maximum((v * v).sum(1)[:, None] + (held.value**2).sum(1)[None, :] - 2 * v @ held.value.T, 0)
                cell = gap.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *part.columns, pa.array(np.sqrt(gap[np.arange(len(v)), cell]))], ["cell", "id", "vector", "gap"])

    dealt = written(rows.mapInArrow(deal, "cell int, id long, vector array<double>, gap double"), "dealt-vectors")
    sizes = {r.cell: (r.n, r.radius) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()}  # a row for each centre at most
    parts = spark.createDataFrame([(c, max(1, math.ceil(n / SLICE))) for c, (n, _) in sizes.items()], "cell int, slices int")
    sliced = dealt.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), "id", "vector")
    sliced.repartitionByRange(max(1, min(slices, 10_000)), "cell", "slice").sortWithinPartitions("cell", "slice").write.parquet(f"{path}/vectors")
    spark.createDataFrame([(c, middle[c].tolist(), r, n, max(1, math.ceil(n / SLICE))) for c, (n, r) in sorted(sizes.items())], "cell int, centre array<double>, radius double, n long, slices int").write.parquet(f"{path}/cells")


def _compared(pairs: DataFrame, asked: DataFrame, vectors: DataFrame, cells: dict, k: int) -> DataFrame:
    """query_id, id, score: of each query and slice of a cell it visits, the k nearest. ``pairs``: row, query_id, cell; ``asked``: row, vector."""
    spark = pairs.sparkSession
    visits = {r.cell: r["count"] for r in pairs.groupBy("cell").count().collect()}
    plan = spark.createDataFrame([(c, cells[c][3], max(1, math.ceil(n / PART))) for c, n in visits.items()], "cell int, slices int, parts int")
    asked = pairs.join(F.broadcast(plan), "cell").join(asked.select("row", "vector"), "row").select("cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), "query_id", "vector")
    there = vectors.join(F.broadcast(plan), "cell").select("cell", "slice", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "vector")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        q, v, ids = np.stack(left["vector"]), np.stack(right["vector"]), right["id"].to_numpy()
        asked_by, out = left["query_id"].to_numpy(), []
        for a in range(0, len(q), 512):
            score = np.round(np.einsum("id,jd->ij", q[a : a + 512], v), DIGITS)
            least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -2.0)
            for i, row in enumerate(score):
                near = np.flatnonzero(row >= least[i])
                best = near[np.lexsort((ids[near], -row[near]))][:k]
                out.append((np.full(len(best), asked_by[a + i]), ids[best], row[best]))
        return pd.DataFrame(dict(zip(("query_id", "id", "score"), map(np.concatenate, zip(*out)))))

    keys = ["cell", "slice", "part"]
    schema = StructType().add("query_id", LongType()).add("id", LongType()).add("score", DoubleType())
    return asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(nearest, schema)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, id_col: str = "query_id", vector_col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(query_id, id, score, rank of the k nearest of every query; query_id, cell of all visits). ``score`` is the cosine, rounded to ``DIGITS``; ties by id.

    Queries whose vector has no direction have no rows. A query that is in the store finds itself.
    """
    cells = {r.cell: (np.array(r.centre), r.radius, r.n, r.slices) for r in spark.read.parquet(f"{path}/cells").collect()}  # a row for each centre
    vectors = spark.read.parquet(f"{path}/vectors")
    asked = written(unit_rows(queries, id_col, vector_col, "query_id").withColumn("row", F.monotonically_increasing_id()), "unit-queries")
    names = np.array(sorted(cells), np.int32)
    held = spark.sparkContext.broadcast((names, np.stack([cells[c][0] for c in names]) if cells else np.zeros((0, 1)), np.array([cells[c][1] for c in names]), np.array([cells[c][2] for c in names])))

    def bounds(v: np.ndarray) -> np.ndarray:
        _, middle, radius, _ = held.value
        return np.maximum(np.sqrt(np.maximum((v * v).sum(1)[:, None] + (middle**2).sum(1)[None, :] - 2 * v @ middle.T, 0)) - radius - SLACK, 0)

    def first_cells(v: np.ndarray) -> np.ndarray:
        """Those of the least bounds that hold k vectors together."""
        order = np.argsort(bounds(v), axis=1, kind="stable")
        sizes = held.value[3][order]
        before = np.cumsum(sizes, axis=1) - sizes
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out

    def visits(batches, later: bool):
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                v = _matrix(part.column(1))
                some = first_cells(v)
                if later:
                    some = (bounds(v) <= part.column(2).to_numpy(zero_copy_only=False)[:, None]) & ~some
                i, j = np.nonzero(some)
                # numbers alone: a query can visit all cells, and its vector would be in each row
                yield pa.RecordBatch.from_arrays([*part.select(["row", "query_id"]).take(pa.array(i)).columns, pa.array(held.value[0][j])], ["row", "query_id", "cell"])

    kinds, order = "row long, query_id long, cell int", (F.desc("score"), "id")
    near = written(asked.mapInArrow(lambda b: visits(b, False), kinds), "first-cells")
    best = written(first_of(_compared(near, asked, vectors, cells, k), k, *order).drop("rank"), "first-near")
    closed = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.sqrt(F.greatest(2 - 2 * F.min("score"), F.lit(0.0))) + SLACK).otherwise(F.lit(float("inf"))).alias("most"))
    far = written(asked.join(closed, "query_id", "left").select("query_id", "vector", F.coalesce("most", F.lit(float("inf"))).alias("most"), "row").mapInArrow(lambda b: visits(b, True), kinds), "other-cells")
    found = first_of(best.unionByName(_compared(far, asked, vectors, cells, k)), k, *order)
    return found.select("query_id", "id", "score", "rank"), near.select("query_id", "cell").unionByName(far.select("query_id", "cell"))


#: Decimals of the cosine of ``best_within``, and rows of a slice of a group on average.
SIM_DIGITS, GROUP_SLICE = 6, 4096


def best_within(vectors: DataFrame, asks, id_col: str, group_col: str, vector_col: str) -> DataFrame:
    """query_id, the id column, sim: of each row that ``asks``, the other row of its group with the greatest dot product (rounded to ``SIM_DIGITS``), ties by the least id.

    Vectors of other lengths, or none, have -1 with each other; null numbers give null, which comes last. Rows of a group
    are dealt to slices, and each slice is compared with the group's queries as they stream by, so a task holds one slice
    of any group; every pair is compared, as no bound closes a group.
    """
    rows = vectors.where(F.col(group_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(group_col).alias("g"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / GROUP_SLICE).cast("int").alias("slices"))
    held = rows.join(sizes, "g")
    there = held.select("g", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), F.lit(0).alias("kind"), "id", "vector")
    asked = held.where("asks").select("g", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(1).alias("kind"), "id", "vector")

    def run(batches):
        at, parts, own = None, [], None
        for batch in batches:
            keys = pc.binary_join_element_wise(batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string()), batch.column(2).cast(pa.string()), "|").to_pylist()
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                name, kind = keys[a].rsplit("|", 1)
                if name != at:
                    at, parts, own = name, [], None
                some = batch.slice(a, b - a).select(["id", "vector"])
                if kind == "0":
                    parts.append(some)
                elif parts or own:
                    if own is None:
                        own, parts = _by_length(pa.Table.from_batches(parts).combine_chunks().to_batches()[0]), []
                    for c in range(0, b - a, STEP):
                        yield _best_of(some.slice(c, STEP), own)

    dealt = there.unionByName(asked).repartition("g", "slice").sortWithinPartitions("g", "slice", "kind")
    found = dealt.select(F.col("g").cast("string").alias("g"), "slice", "kind", "id", "vector").mapInArrow(run, "query_id long, other long, sim double")
    best = found.groupBy("query_id").agg(F.max(F.struct("sim", (-F.col("other")).alias("neg"))).alias("b"))
    return best.select("query_id", (-F.col("b.neg")).alias(id_col), F.col("b.sim").alias("sim"))


def _by_length(rows: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the vectors of each length (-1: none): places, ids in order, a matrix, and which of them hold a null number."""
    ids, column = rows.column("id").to_numpy(), rows.column("vector")
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    out = {}
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        at = at[np.argsort(ids[at], kind="stable")]
        flat = column.take(pa.array(at)).flatten()
        numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), max(n, 0))
        lacks = np.asarray(flat.is_null()).reshape(len(at), max(n, 0)).any(1)
        out[n] = at, ids[at], numbers, lacks
    return out


def _best_of(queries: pa.RecordBatch, own: dict) -> pa.RecordBatch:
    who, other, sim = [], [], []

    def add(q, i, s):
        who.append(q)
        other.append(i)
        sim.append(s)

    for n, (_, names, q, bad) in _by_length(queries).items():
        same = own.get(n) if n >= 0 else None
        if same is not None:
            _, ids, v, lacks = same
            dots = np.einsum("id,jd->ij", q, v)
            # halves away from zero
            score = np.sign(dots) * np.floor(np.abs(dots) * 10.0**SIM_DIGITS + 0.5) / 10.0**SIM_DIGITS
            rank = np.where(np.isnan(score), np.inf, score)
            rank[:, lacks] = -np.inf
            rank[bad] = -np.inf
            rank[names[:, None] == ids[None, :]] = -np.inf
            best = rank.argmax(1)
            for i, j in enumerate(best.tolist()):
                if names[i] != ids[j]:
                    add(names[i], ids[j], None if bad[i] or lacks[j] else score[i, j])
                elif len(ids) > 1:  # nothing but itself and nulls, of which the least id
                    rest = ids[ids != names[i]]
                    if len(rest):
                        add(names[i], rest[0], None)
        for m, (_, ids, _, _) in own.items():
            if m != n or n < 0:
                for name in names.tolist():
                    rest = ids[ids != name]
                    if len(rest):
                        add(name, rest[0], -1.0)
    return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(other, pa.int64()), pa.array(sim, pa.float64(), from_pandas=False)], ["query_id", "other", "sim"])
