"""Running numbers over ordered rows of any group, however large: no task holds a group, and no window without bound.

Rows are dealt by range and sorted; each partition adds up from its own start. Only the first group of a partition can
have begun before it, so what a partition has to add is one number, which comes from the sums of the partitions: a row for
each of them goes over the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from ..scratch import written

#: Bytes that a task is to sort.
TASK_BYTES = 64 << 20


def running(rows: DataFrame, group: list[str], order: list[str], value: str | None = None, name: str = "place", row_bytes: int = 200) -> DataFrame:
    """``rows``, written and read back, with ``name``: the sum of ``value`` (whole numbers; 1 if none) over the rows of its group before it.

    Groups are equal in all of ``group``, nulls being equal; rows are in order of ``order``, nulls first, and rows that tie
    stand in the order of the written table. All of ``rows``' columns are kept, whatever their names, but for ``name``.
    """
    spark = rows.sparkSession
    own = written(rows, "unordered")
    n = own.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * row_bytes / TASK_BYTES))
    columns = rows.columns
    free = _unused(columns)
    key, step, tie, part, local, first = (free(x) for x in ("key", "step", "tie", "part", "local", "first"))
    added = F.col(value).cast("long") if value else F.lit(1).cast("long")
    # one text for a group, nulls told apart from texts; its length keeps columns from running into each other
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.length(F.col(g).cast("string")).cast("string"), F.lit(":"), F.col(g).cast("string")), F.lit("-")) for g in group]) if group else F.lit("")
    keyed = own.select("*", text.alias(key), F.coalesce(added, F.lit(0)).alias(step), F.monotonically_increasing_id().alias(tie))
    by = [F.col(key), *[F.col(o) for o in order], F.col(tie)]
    dealt = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(part, F.spark_partition_id())
    at, add_at = dealt.columns.index(key), dealt.columns.index(step)
    schema = StructType([*dealt.schema.fields]).add(local, LongType(), False).add(first, BooleanType(), False)

    def add(batches):
        last, held, begun = None, 0, False
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            k, steps = batch.column(at), batch.column(add_at).to_numpy()
            new = np.zeros(size, bool)
            new[0] = last is not None and k[0].as_py() != last
            if size > 1:
                new[1:] = pc.not_equal(k.slice(1), k.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            before = np.cumsum(steps) - steps + held  # of the whole partition, from the start of the open group
            group_start = before[np.maximum.accumulate(np.where(new, np.arange(size), 0))] if new.any() else np.zeros(size, before.dtype)
            group_start = np.where(np.cumsum(new) > 0, group_start, 0)
            value = before - group_start
            later = (np.cumsum(new) > 0) | begun
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.int64()), pa.array(~later)], [*batch.schema.names, local, first])
            begun = bool(later[-1])
            held, last = int(value[-1] + steps[-1]), k[size - 1].as_py()

    held = written(dealt.mapInArrow(add, schema), "added")
    ends = held.groupBy(part).agg(F.sha2(F.min(key), 256).alias("head"), F.sha2(F.max(key), 256).alias("tail"), F.max_by(F.col(local) + F.col(step), F.struct(key, *order, tie)).alias("total"))
    offsets, open_, total = [], None, 0
    for r in ends.orderBy(part).collect():  # a row for each partition
        start = total if r["head"] == open_ else 0
        offsets.append((r[part], start))
        total = r["total"] + (start if r["head"] == r["tail"] else 0)
        open_ = r["tail"]
    offset = free("offset")
    moved = spark.createDataFrame(offsets, f"`{part}` int, `{offset}` long")
    whole = held.join(F.broadcast(moved), part, "left")  # a row for each partition
    return whole.select(*[F.col(f"`{c}`") for c in columns if c != name], (F.col(local) + F.when(F.col(first), F.coalesce(F.col(offset), F.lit(0))).otherwise(0)).alias(name))


def _unused(columns: list[str]):
    held = {c.lower() for c in columns}

    def free(name: str) -> str:
        while (name := f"_{name}") in held:
            pass
        held.add(name)
        return name

    return free


def percentiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``group`` columns and for each name in ``shares`` the value at place ceil(p n) of the group's values in order, nulls left out.

    Exact, for groups of any size: equal values are counted before they are dealt, and each task adds up the counts of a
    range. Groups without a value have no row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    before = running(counted, group, ["_value"], "_n", "_before")
    # sizes of groups, and of these the places that are asked for
    sizes = before.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(F.sum("_n").alias("_size"))
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    # the size joins as a few numbers: the last row of a group alone knows it, and groups are fewer than their values
    held = before.join(sizes, same) if group else before.crossJoin(F.broadcast(sizes))
    hit = lambda p: F.greatest(F.ceil(F.lit(p) * F.col("_size")), F.lit(1)).between(F.col("_before") + 1, F.col("_before") + F.col("_n"))
    return held.groupBy(*group).agg(*[F.max(F.when(hit(p), F.col("_value"))).alias(name) for name, p in shares.items()])
