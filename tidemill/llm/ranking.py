"""Places of rows within their groups, however large a group is: no group is held in one task.

Rows are dealt by range and sorted; each partition numbers the rows of its groups from 0. Only the first group of a
partition can have begun in an earlier one, so a single number for each partition makes the places whole: these are
summed on the driver, which sees one row for each partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from .common import partitions_for, spill_table


def group_key(value: str) -> Column:
    """A column as text without nulls, in the order of the column if that is a string: null is the empty text, which comes first."""
    return F.when(F.col(value).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(value).cast("string")))


def places(rows: DataFrame, group: str, order: list[str], row_bytes: int = 256) -> DataFrame:
    """``rows``, written and read back, with ``place``: from 0 within each value of ``group`` (text without nulls), by ``order``, nulls first.

    Rows that tie in ``order`` get places of their own, which of them which is open; if they have to be alike whatever
    happens, ``order`` has to tell all different rows apart. A group of any size is dealt to several partitions, even
    where ``order`` does not tell its rows apart, as a running number does.
    """
    spark = rows.sparkSession
    own = spill_table(rows, "unranked")
    # a number for each row that is the same whenever the written table is read
    own = own.withColumn("_tie", F.monotonically_increasing_id())
    keys = [group, *order, "_tie"]
    parts = partitions_for(spark, own.count() * row_bytes)
    dealt = own.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_part", F.spark_partition_id())
    at = dealt.columns.index(group)
    schema = StructType(list(dealt.schema.fields)).add("_local", LongType(), False).add("_first", BooleanType(), False)

    def number(batches):
        last, n, first = None, 0, True
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            key = batch.column(at)
            new = np.ones(size, bool)
            new[0] = last is None or key[0].as_py() != last
            if size > 1:
                new[1:] = pc.not_equal(key.slice(1), key.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            index = np.arange(size)
            start = np.maximum.accumulate(np.where(new, index, -n))  # of each row's group, before 0 if it began in an earlier batch
            local = index - start
            begun = np.cumsum(new) - (1 if last is None else 0)  # groups that began after the partition's first one
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64()), pa.array((begun == 0) & first)], [*batch.schema.names, "_local", "_first"])
            last, n = key[size - 1].as_py(), int(local[-1]) + 1
            first = first and bool(begun[-1] == 0)

    held = spill_table(dealt.mapInArrow(number, schema), "ranked")
    ends = held.groupBy("_part").agg(F.sha2(F.min(group), 256).alias("head"), F.sha2(F.max(group), 256).alias("tail"), F.count("*").alias("rows"), F.max_by("_local", F.struct(group, "_local")).alias("top"))
    begin, open_group, so_far = {}, None, 0
    for r in ends.orderBy("_part").collect():  # a row for each partition
        begin[r["_part"]] = so_far if r["head"] == open_group else 0
        so_far = r["top"] + 1 + (begin[r["_part"]] if r["head"] == r["tail"] else 0)
        open_group = r["tail"]
    later = {p: n for p, n in begin.items() if n}
    place = F.col("_local")
    if later:
        offsets = spark.createDataFrame(sorted(later.items()), "_part int, _offset long")
        held = held.join(F.broadcast(offsets), "_part", "left")  # a row for each partition at most
        place = place + F.when(F.col("_first"), F.coalesce(F.col("_offset"), F.lit(0))).otherwise(0)
    return held.withColumn("place", place).drop("_part", "_local", "_first", "_offset")
