"""Trees of any depth and breadth from rows that name their parent, in rounds logarithmic in the depth.

Rows are numbered in order of run and id and cut into blocks of bounded size. A block resolves by itself what lies within it,
by pointer doubling over arrays: its tops (rows whose parent is elsewhere or missing) stand for all below them in the block.
Only tops take part in the rounds over all blocks, and of these only those that another top hangs below: a round lets a
pointer jump to where its pointer's pointer points, so after k rounds it has passed 2^k tops, and what is summed along the way
(depth, places) doubles likewise. Sizes of subtrees go the other way: a round adds to a row what the rows that point at it
have gathered. The place of a row in the walk that visits a parent before its children is then the sum of the sizes of
earlier siblings, its own and its ancestors', and no path is ever built.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from ..scratch import written
from .prefix import running

#: Rows of a block, about: ranges come from a sample. Bounds the memory of a task, never results.
BLOCK_ROWS = 1 << 18


def _block():
    return F.shiftright("no", 33)  # of the numbers that monotonically_increasing_id gives, the partition


def _located(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of their numbers: the numbers, and the place of each row's parent, the number of rows if it is not among them."""
    no, up = rows["no"].to_numpy(), pc.fill_null(rows["up"], -1).to_numpy()
    at = np.minimum(np.searchsorted(no, up), max(len(no) - 1, 0))
    return no, np.where(no[at] == up, at, len(no))


def _climbed(to: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its top, -1 if it is on a circle or below one, and the sum of ``value`` from the row to its top, both included."""
    n = len(to)
    top = to == n
    last, total = np.where(top, np.arange(n), to), np.where(top, 0, value)
    for _ in range(n.bit_length()):
        if top[last].all():
            break
        total, last = total + total[last], last[last]
    return np.where(top[last], last, -1), total + value[last]


def _gathered(to: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each row the sum of ``value`` over itself and all below it."""
    n = len(to)
    total, jump = value.astype(np.int64), np.append(to, n)
    for _ in range(n.bit_length()):
        live = np.flatnonzero(jump[:n] < n)
        if not live.size:
            break
        total = total + np.bincount(jump[live], total[live], n).astype(np.int64)
        jump = jump[jump]
    return total


def _contract(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("no")
    no, to = _located(rows)
    last, steps = _climbed(to, np.ones(len(no), np.int64))
    sizes = np.bincount(last[last >= 0], minlength=len(no))
    return rows.append_column("top", pa.array(np.where(last >= 0, no[last], -1))).append_column("steps", pa.array(steps - 1)).append_column("size", pa.array(sizes))


def _resize(rows: pa.Table) -> pa.Table:
    """Sizes from the rows of a block and what hangs below them elsewhere (``more``; below 0 for tops that are lost)."""
    extra = rows.filter(pc.is_valid(rows["more"]))
    rows = rows.filter(pc.is_null(rows["more"])).sort_by("no").drop_columns(["more"])
    no, to = _located(rows)
    at, more = np.searchsorted(no, extra["no"].to_numpy()), extra["more"].to_numpy()
    last, _ = _climbed(to, np.zeros(len(no), np.int64))
    lost, weight = np.zeros(len(no), bool), np.ones(len(no), np.int64)
    lost[at[more < 0]] = True
    weight[at[more > 0]] += more[more > 0]
    kept = (last >= 0) & ~lost[last]
    if not kept.all():
        rows, weight = rows.filter(pa.array(kept)), weight[kept]
        no, to = _located(rows) if len(rows) else (no[:0], to[:0])
    return rows.append_column("size", pa.array(_gathered(to, weight)))


def _place(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("no")
    no, to = _located(rows)
    last, steps = _climbed(to, np.ones(len(no), np.int64))
    _, places = _climbed(to, rows["earlier"].to_numpy() + 1)
    return rows.drop_columns(["earlier"]).append_column("top", pa.array(no[last])).append_column("steps", pa.array(steps - 1)).append_column("places", pa.array(places))


def _by_block(rows: DataFrame, fn, drop: list[str], add: list[str]) -> DataFrame:
    schema = StructType([f for f in rows.schema.fields if f.name not in drop])
    for name in add:
        schema = schema.add(name, LongType())
    return rows.groupBy(_block()).applyInArrow(fn, schema)


def _numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` with a number for each row (``no``), near for rows that are near by run and id, and the parent's (``up``); ``parent`` is null if it is not there."""
    n = nodes.count()
    own = written(nodes.repartitionByRange(max(1, math.ceil(n / BLOCK_ROWS)), "run", "id").sortWithinPartitions("run", "id").withColumn("no", F.monotonically_increasing_id()), "numbered")
    there = own.select(F.col("run").alias("_run"), F.col("id").alias("_id"), F.col("no").alias("_no"))
    named = own.where("parent is not null").join(there, F.col("run").eqNullSafe(F.col("_run")) & (F.col("parent") == F.col("_id")), "left")
    named = named.select("no", F.col("_no").alias("up"), "run", "id", F.when(F.col("_no").isNotNull(), F.col("parent")).alias("parent"), "at")
    return named.unionByName(own.where("parent is null").select("no", F.lit(None).cast("long").alias("up"), "run", "id", "parent", "at"))


def _jumped(rows: DataFrame, values: list[str]) -> DataFrame:
    """One round: rows that still point at one have each of ``values`` added from it, and ``up`` replaced by that row's; -1 stays."""
    far = rows.select(F.col("no").alias("_no"), F.col("up").alias("_up"), *[F.col(v).alias(f"_{v}") for v in values])
    kept = [c for c in rows.columns if c not in ("up", *values)]
    moved = rows.where("up >= 0").join(far, F.col("up") == F.col("_no")).select(*kept, F.col("_up").alias("up"), *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])
    return rows.where("up is null or up < 0").unionByName(moved)


def _grown(rows: DataFrame, below: DataFrame) -> DataFrame:
    """``rows`` with the sizes of those of ``below`` that point at them added; these are added up before the shuffle, so a row that many point at is one row of each task."""
    more = below.where("up >= 0").groupBy(F.col("up").alias("_up")).agg(F.sum("size").alias("_more"))
    return rows.join(more, F.col("no") == F.col("_up"), "left").withColumn("size", F.col("size") + F.coalesce("_more", F.lit(0))).drop("_up", "_more")


def walk(nodes: DataFrame, order: str) -> DataFrame:
    """run, id, parent, depth, size, pos of each row of ``nodes`` (run, id, parent and ``order``), ids being unique in a run.

    A row whose parent is not there is a root, at depth 0. ``size`` counts a row and all below it; ``pos`` is from 1 in each
    run, parents before children, siblings by ``order`` and id. Rows on a circle of parents, or below one, are left out.
    """
    own = nodes.select(F.col("run_id").alias("run"), F.col("span_id").alias("id"), F.col("parent_id").alias("parent"), F.col(order).alias("at"))
    blocks = written(_by_block(_numbered(own), _contract, [], ["top", "steps", "size"]), "contracted")
    # tops: the row that each hangs below, and that row's top
    tops, far = blocks.where("top = no").select("no", F.col("up").alias("below"), "size"), blocks.select(F.col("no").alias("_no"), F.col("top").alias("up"))
    hung = tops.where("below is not null").join(far, F.col("below") == F.col("_no")).drop("_no")
    tops = written(hung.unionByName(tops.where("below is null").withColumn("up", F.lit(None).cast("long"))), "tops")
    pointed = tops.where("up >= 0").select(F.col("up").alias("_up")).distinct()
    tops = written(tops.join(pointed, F.col("no") == F.col("_up"), "left").select("no", "below", "up", "size", F.col("_up").isNotNull().alias("inner")), "tops")
    inner, leaves = tops.where("inner").drop("inner"), tops.where("not inner").drop("inner")
    rows, rounds = written(_grown(inner, leaves), "sizes"), 0
    n = rows.count()
    while 1 << rounds <= 2 * n and not rows.where("up >= 0").isEmpty():
        jumped = _jumped(rows.drop("size"), [])
        sized = _grown(rows, rows).select(F.col("no").alias("_no"), "size")
        rows, rounds = written(jumped.join(sized, F.col("no") == F.col("_no")).drop("_no"), "sizes"), rounds + 1
    # whatever points at a row by now is on a circle or below one
    lost = rows.where("up is not null").select("no")
    wrong = F.lit(False) if lost.isEmpty() else F.col("_lost").isNotNull()
    ends = leaves if lost.isEmpty() else leaves.join(lost.select(F.col("no").alias("_lost")), F.col("up") == F.col("_lost"), "left")
    ends = ends.select("no", "below", "size", (F.coalesce(F.col("up") < 0, F.lit(False)) | wrong).alias("lost"))
    every = rows.select("no", "below", "size", F.col("up").isNotNull().alias("lost")).unionByName(ends)
    more = every.where("not lost and below is not null").groupBy(F.col("below").alias("no")).agg(F.sum("size").alias("more"))
    more = more.unionByName(every.where("lost").select("no", F.lit(-1).cast("long").alias("more")))
    told = blocks.drop("top", "steps", "size").unionByName(more, allowMissingColumns=True)
    sizes = _by_block(told, _resize, ["more"], ["size"])
    placed = running(sizes, ["run", "parent"], ["at", "id"], "size", "earlier").drop("at")
    placed = written(_by_block(placed, _place, ["earlier"], ["top", "steps", "places"]), "placed")
    # what a top has above it: steps and places
    above = placed.select(F.col("no").alias("_no"), (F.col("steps") + 1).alias("over"), F.col("places").alias("before"))
    hung = tops.where("below is not null").join(above, F.col("below") == F.col("_no")).select("no", "up", "inner", "over", "before")
    free = tops.where("below is null").select("no", "up", "inner", F.lit(0).cast("long").alias("over"), F.lit(0).cast("long").alias("before"))
    hung = written(hung.unionByName(free), "above")
    inner = hung.where("inner").drop("inner")
    for _ in range(rounds):
        inner = written(_jumped(inner, ["over", "before"]), "above")
    # a top that nothing hangs below takes one step more, to its own row in the others
    leaf = hung.where("not inner").drop("inner")
    far = inner.select(F.col("no").alias("_no"), F.col("over").alias("_over"), F.col("before").alias("_before"))
    under = leaf.where("up is not null").join(far, F.col("up") == F.col("_no")).select("no", (F.col("over") + F.col("_over")).alias("over"), (F.col("before") + F.col("_before")).alias("before"))
    total = inner.select("no", "over", "before").unionByName(leaf.where("up is null").select("no", "over", "before")).unionByName(under).withColumnRenamed("no", "_no")
    out = placed.join(total, F.col("top") == F.col("_no"))
    return out.select("run", "id", "parent", (F.col("steps") + F.col("over")).alias("depth"), "size", (F.col("places") + F.col("before")).alias("pos"))
