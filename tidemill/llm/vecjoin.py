"""Embedding near-duplicates by an exact metric range join.

Vectors of one label whose cosine reaches the threshold link. On the unit sphere this is a distance of at most r. Pivots,
a bounded sample of each label's vectors, partition the vectors into cells: a vector lives in the cell of its nearest
pivot h. By the triangle inequality a vector within r of it that lives with pivot j is at most r further from j than j's
own bound, so the vector is replicated to cell j only if d(x, j) - d(x, h) <= 2 r, and, as the space is Euclidean, if its
distance to the plane between h and j is at most r. Cells are joined independently. As a pair meets at the home of either,
replicas only go to cells of lower number.

Equal vectors are one row with a count, so copies are never paired. Cells with many residents are split: residents are
dealt to slices by a hash, and each replica is sent to all slices; the list of such cells is bounded, so no vector is
joined by its cell. Links are contracted within a task.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import HOT_KEYS, join_counted, partitions_for, spill_table
from .components import Forest, Residents, components

COSINE = 0.98
#: Vectors of a cell on average, residents of one slice of a cell with more than these.
CELL, SLICE = 512, 2048
#: Pivots in all: this many at least, else twice the root of the number of vectors, so that the work to find a vector's
#: cells and that to compare it within them grow alike; and bytes of all pivots, which bound what tasks are sent.
PIVOTS, PIVOT_BYTES = 4096, 256 << 20
#: Cosines so near the threshold are computed again without rounding between the steps.
EDGE = 1e-9


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the home of each row, and then all lower cells whose residents may lie within ``radius``. Rows are of length 1."""
    home, row, cell = np.empty(len(x), np.int64), [], []
    slack, step = 1e-6, max(1, 2_000_000 // len(pivots))
    for a in range(0, len(x), step):
        d = np.sqrt(np.maximum(2 - 2 * (x[a : a + step] @ pivots.T), 0))
        h = home[a : a + step] = d.argmin(axis=1)
        own = d[np.arange(len(h)), h]
        i, j = np.nonzero((d - own[:, None] <= 2 * radius + slack) & (np.arange(len(pivots))[None, :] < h[:, None]))
        for b in range(0, len(i), 20_000):
            k, c = i[b : b + 20_000], j[b : b + 20_000]
            between = np.linalg.norm(pivots[c] - pivots[h[k]], axis=1)
            near = d[k, c] ** 2 - own[k] ** 2 <= 2 * between * (radius + slack)
            row.append(a + k[near])
            cell.append(c[near])
    return np.concatenate((np.arange(len(x)), *row)), np.concatenate((home, *cell))


def vector_classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, dim, digest, vector: vectors that can link; equal vectors of a label have one digest."""

    def run(batches):
        for batch in batches:
            ids, labels, column = batch.column(0), batch.column(1), batch.column(2)
            keep, dims, digests, rows = [], [], [], []
            for k, v in enumerate(column.to_pylist()):
                if v is None or None in v:
                    continue
                x = np.array(v, np.float64)
                if not len(x) or not np.isfinite(x).all() or not x.any():
                    continue
                keep.append(k)
                dims.append(len(x))
                rows.append(x)
                digests.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), labels.take(at), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(rows, pa.list_(pa.float64()))], ["vec_id", "label", "dim", "digest", "vector"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector")).where("label is not null and vec_id is not null")
    return rows.mapInArrow(run, "vec_id long, label string, dim int, digest binary, vector array<double>")


def range_join(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Joins rows (node, label, dim, vector, n) with all others of their label and dimension.

    Returns rows (src, dst, links): with dst set, a link, of which enough are returned to leave all components whole;
    else a part of the number of vectors that src links to, beyond its own class.
    """
    spark = classes.sparkSession
    radius = math.sqrt(2 - 2 * cosine)
    groups = classes.groupBy("label", "dim").agg(F.count("*").alias("c"))
    total, width = groups.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("dim"), F.lit(1))).first()
    most = max(2, min(max(PIVOTS, 2 * math.isqrt(total)), PIVOT_BYTES // (8 * width)))
    # one pivot for a small group is the same as none, so only groups of several cells send theirs: at most ``most`` groups
    wanted = F.greatest(F.lit(1), F.least(F.ceil(F.col("c") / CELL), F.floor(F.lit(most) * F.col("c") / max(1, total)))).cast("int")
    several = groups.withColumn("wanted", wanted).where("wanted > 1")
    # a part of each group by the hash of its rows, a little over the number wanted
    share = (F.lit(1.5) * F.col("wanted") + 8) / F.col("c")
    drawn = classes.join(F.broadcast(several), ["label", "dim"]).withColumn("u", F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)).where(F.col("u") < share)
    pivots: dict[tuple[str, int], np.ndarray] = {}
    for r in drawn.select("label", "dim", "node", "vector", "u", "wanted").orderBy("u", "node").limit(2 * most).collect():
        own = pivots.setdefault((r.label, r.dim), [])
        if len(own) < r.wanted:
            own.append(r.vector)
    pivots = {k: unit(np.array(v, np.float64)) for k, v in pivots.items()}
    sent = spark.sparkContext.broadcast(pivots)

    def deal(batches):
        pivots = sent.value
        for batch in batches:
            label, dim = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            groups: dict[tuple[str, int], list[int]] = {}
            for k, key in enumerate(zip(label, dim)):
                groups.setdefault(key, []).append(k)
            for key, at in groups.items():
                part = batch.take(pa.array(at))
                if key in pivots:
                    row, cell = cells(unit(matrix(part.column(3), key[1])), pivots[key], radius)
                else:
                    row, cell = np.arange(len(at)), np.zeros(len(at), np.int64)
                out = part.take(pa.array(row))
                resident = np.arange(len(row)) < len(at)
                home = cell[: len(at)][row]
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int32)), pa.array(resident), pa.array(home.astype(np.int32))], ["node", "label", "dim", "vector", "n", "cell", "resident", "home"])

    dealt = classes.select("node", "label", "dim", "vector", "n").mapInArrow(deal, "node long, label string, dim int, vector array<double>, n long, cell int, resident boolean, home int")
    key = ["label", "dim", "cell"]
    # cells to be split: of more than SLICE residents and a 65,536th of all vectors, so there are never more than 65,536
    counts = dealt.where("resident").groupBy(*key).agg(F.count("*").alias("c"))
    size = max(SLICE, total // HOT_KEYS)
    split = counts.where(F.col("c") > size).select(*key, F.ceil(F.col("c") / size).cast("int").alias("more"))
    rows = dealt.join(F.broadcast(split), key, "left").withColumn("parts", F.coalesce("more", F.lit(1)))
    columns = [*key, "slice", "kind", "node", "n", "home", "vector"]
    alone = rows.where("resident").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("kind", F.lit(0)).select(columns)
    spread = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("kind", F.lit(1)).select(columns)
    parts = partitions_for(spark, 3.0 * total * (8 * width + 60))
    met = alone.unionByName(spread).repartition(parts, *key, "slice").sortWithinPartitions(*key, "slice", "kind")

    def compare(batches):
        forest = Forest()
        state: dict = {"key": None}

        def flush():
            add = state.get("add")
            if add is not None and add.any():
                at = np.flatnonzero(add)
                return [pa.RecordBatch.from_arrays([pa.array(state["residents"].nodes[at]), pa.nulls(len(at), pa.int64()), pa.array(add[at])], ["src", "dst", "links"])]
            return []

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            kinds = batch.column(4).to_numpy()
            node, n, home = (batch.column(i).to_numpy() for i in (5, 6, 7))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or kinds[i] != kinds[i - 1]], len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                x = matrix(batch.column(8).slice(a, b - a), keys[a][1])
                if keys[a] != state["key"]:
                    yield from flush()
                    state = {"key": keys[a], "x": [], "node": [], "n": []}
                if kinds[a] == 0:
                    state["x"].append(x)
                    state["node"].append(node[a:b])
                    state["n"].append(n[a:b])
                    continue
                if "residents" not in state:
                    if not state["node"]:
                        continue
                    state |= {"r": np.concatenate(state["x"]), "residents": Residents(np.concatenate(state["node"])), "count": np.concatenate(state["n"])}
                    state |= {"norm": np.linalg.norm(state["r"], axis=1), "add": np.zeros(len(state["count"]), np.int64)}
                for c in range(0, b - a, 512):
                    y = x[c : c + 512]
                    cos = (y @ state["r"].T) / (np.linalg.norm(y, axis=1)[:, None] * state["norm"][None, :])
                    near = cos >= cosine
                    for i, j in zip(*np.nonzero(np.abs(cos - cosine) < EDGE)):
                        near[i, j] = exact_cosine(y[i], state["r"][j]) >= cosine
                    names = node[a + c : a + c + len(y)]
                    near &= names[:, None] != state["residents"].nodes[None, :]
                    if not near.any():
                        continue
                    mine = near @ state["count"]
                    away = home[a + c : a + c + len(y)] != keys[a][2]
                    state["add"] += n[a + c : a + c + len(y)][away] @ near[away].astype(np.int64)
                    some = np.flatnonzero(mine)
                    yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.nulls(len(some), pa.int64()), pa.array(mine[some].astype(np.int64))], ["src", "dst", "links"])
                    links = forest.join(*state["residents"].links(names, near))
                    if links:
                        src, dst = zip(*links)
                        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.nulls(len(src), pa.int64())], ["src", "dst", "links"])
        yield from flush()

    return met.mapInArrow(compare, "src long, dst long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable), kept: one row per vector.

    Vectors that are null, zero, empty or hold null or non-finite components, and those without a label or an id, link
    with nothing; nor do vectors of different dimensions. A cosine that ties with the threshold links: near it, cosines
    are computed again with exact sums. Repeated rows link with each other, those of one id too. A null id is null in all
    columns but ``n_links``. An empty table gives no rows; further columns are not carried, whatever their names.
    """
    valid = vector_classes(vectors, id_col, vector_col, label_col)
    key = ["label", "dim", "digest"]
    classes = spill_table(valid.groupBy(*key).agg(F.min_by("vector", "vec_id").alias("vector"), F.min("vec_id").alias("node"), F.count("*").alias("n")), "vectors")
    found = spill_table(range_join(classes, cosine), "vector-links")
    of = components(found.where("dst is not null").select("src", "dst"))
    counts = found.where("dst is null").groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    named = classes.select(*key, "node", "n").join(counts, "node", "left").join(of, "node", "left")
    named = named.select(*key, "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    linked = join_counted(valid.select("vec_id", *key), named, key, "n", F.col("vec_id")).select("vec_id", "n_links", F.col("root").alias("component_id"))
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col), F.col(vector_col))
    # rows that cannot link, by the same rule
    spare = every.where(F.col(label_col).isNull() | F.col("vec_id").isNull() | ~F.coalesce(_usable(F.col(vector_col)), F.lit(False)))
    spare = spare.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(spare).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def _usable(v):
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
