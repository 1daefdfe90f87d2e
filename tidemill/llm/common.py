"""Shared helpers of the operators: reading tables, the shared scratch folder, batching of texts, joins with hot keys."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes that a task of a shuffle is to read, and the least number of rows from which a key can count as hot.
TASK_BYTES, HOT_ROWS = 64 << 20, 1_000
#: A key is hot if it has more than this part of all rows, so there are no more hot keys than this.
HOT_KEYS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where none is set, a session on one machine gets a temporary one; on a cluster, whose machines share no such folder,
    this is an error.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if held.isEmpty():
        if not named and not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster") and not named:
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemill-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return named or held.get()


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what is written there goes when the driver ends, if it was not dropped before."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    system, at = _path(spark, path)
    system.deleteOnExit(at)
    return path


def spill_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives the loss of executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spilled_to = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``spill_table`` wrote and that nothing reads any more."""
    system, at = _path(df.sparkSession, df._spilled_to)
    system.delete(at, True)


def slices(sizes, most: int):
    """(start, end) ranges of consecutive items whose sizes sum to about ``most``; a larger item stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def partitions_for(spark: SparkSession, size: float) -> int:
    """Partitions for a shuffle of ``size`` bytes: the session's number, or more if its tasks would be too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in whatever case."""
    held = {c.lower() for c in df.columns}
    while (name := f"_{name}") in held:
        pass
    return name


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def join_counted(rows: DataFrame, counted: DataFrame, key: list[str], n: str, by: Column) -> DataFrame:
    """Inner join of ``rows`` with ``counted``, which has one row for each ``key`` (no nulls) and in ``n`` how many rows there are of it.

    A hot key's rows are dealt to several tasks by the hash of ``by``. Hot keys are those with more than a 65,536th of all
    rows (and ``HOT_ROWS`` at least), so there are 65,536 of them at most and their list can be broadcast at any size.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    most = max(HOT_ROWS, total // HOT_KEYS)
    parts = F.ceil(F.col(n) / most).cast("int")
    hot = counted.where(F.col(n) > most).select(*key, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    spread = counted.withColumn("_salt", F.explode(F.when(F.col(n) > most, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))))
    return dealt.join(spread, [*key, "_salt"]).drop("_salt")
