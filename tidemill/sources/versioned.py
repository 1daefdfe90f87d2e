"""Versioned tables of Parquet files, written whole or not at all.

A commit first writes its data under names of its own and then adds a manifest, which names all data of the version and
the batch it came from; only that makes it part of the table. A manifest is put in place by a rename that fails if the
version is there, so two writers cannot both win, and a writer that dies leaves files that no manifest names. A batch that
comes again is found in the manifest and changes nothing. Several tables are committed together.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

COMMIT = "_commit"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """version, batches (the last one of each writer), tables (their data, in order): the newest, or one by number."""
    jvm, at, files = _files(spark, f"{path}/manifests")
    if not files.exists(at):
        return {"version": 0, "batches": {}, "tables": {}}
    names = sorted(s.getPath().getName() for s in files.listStatus(at) if s.getPath().getName().endswith(".json"))
    if version is not None:
        names = [n for n in names if n == f"{version:020d}.json"]
        if not names:
            raise ValueError(f"there is no version {version} of {path}")
    if not names:
        return {"version": 0, "batches": {}, "tables": {}}
    stream = files.open(jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{names[-1]}"))
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, held: dict) -> None:
    jvm, at, files = _files(spark, f"{path}/manifests/_{uuid.uuid4().hex}")
    out = files.create(at)
    out.write(bytearray(json.dumps(held).encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{held['version']:020d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(at, files.makeQualified(target), options)  # raises if another writer was first


def commit(path: str, tables: dict[str, DataFrame], writer: str = "batch", batch: int | None = None) -> int:
    """Add rows to tables, all or none, and return the version. A ``batch`` of a ``writer`` that is not newer than its last one changes nothing."""
    spark = next(iter(tables.values())).sparkSession
    held = manifest(spark, path)
    if batch is not None and batch <= held["batches"].get(writer, -1):
        return held["version"]
    version, data = held["version"] + 1, f"data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.withColumn(COMMIT, F.lit(version).cast("long")).write.parquet(f"{path}/{data}/{name}")
    parts = {name: [*held["tables"].get(name, []), *([f"{data}/{name}"] if name in tables else [])] for name in {*held["tables"], *tables}}
    _publish(spark, path, {"version": version, "batches": held["batches"] | ({writer: batch} if batch is not None else {}), "tables": parts})
    return version


def read(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """All rows of a table at a version, with the number of the commit they came by."""
    parts = manifest(spark, path, version)["tables"].get(name)
    if not parts:
        raise ValueError(f"{path} has no table {name}")
    return spark.read.parquet(*[f"{path}/{p}" for p in parts])


def latest(rows: DataFrame, keys: list[str], of: DataFrame | None = None) -> DataFrame:
    """The rows of the last commit of their key; ``of`` are the rows that say which one that is, if others do.

    Spans are the latest of their runs: a run that came again without spans has none.
    """
    newest = (rows if of is None else of).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(COMMIT).alias("_newest"))
    same = F.col(COMMIT) == F.col("_newest")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(newest, same, "left_semi").drop(COMMIT)


def compact(spark: SparkSession, path: str, keys: dict[str, list[str]], by: dict[str, str] | None = None) -> int:
    """Rewrite each table in ``keys`` to its latest rows, as one more version; ``by`` names the table that decides for another."""
    held = manifest(spark, path)
    version, data = held["version"] + 1, f"data/{uuid.uuid4().hex}"
    for name, own in keys.items():
        of = read(spark, path, by[name]) if by and name in by else None
        latest(read(spark, path, name), own, of).withColumn(COMMIT, F.lit(version).cast("long")).write.parquet(f"{path}/{data}/{name}")
    _publish(spark, path, held | {"version": version, "tables": held["tables"] | {name: [f"{data}/{name}"] for name in keys}})
    return version


def sink(path: str, writer: str, split=None):
    """What ``foreachBatch`` takes: every batch of a stream is one commit, once, however often it is tried. ``split`` makes tables of it."""

    def write(rows: DataFrame, batch: int) -> None:
        commit(path, {"rows": rows} if split is None else split(rows), writer, batch)

    return write
