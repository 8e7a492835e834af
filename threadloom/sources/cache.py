"""A table cache keyed by content: what was computed for a text is found again, whatever row it comes in.

The key is a hash of the content columns and of the version of the model or scorer, so a changed text or a new model is computed
again, and equal contents are computed once. Rows lie in one folder per commit. A manifest, one small file per version of the cache,
lists the folders that count; it is written beside and renamed into place, which fails if another writer was first. That writer's keys
are then taken out of the own folder before the next attempt, so each key is there once, however many jobs append. A job that breaks
off leaves a folder that no manifest names. ``compact`` writes all rows to one folder; ``vacuum`` deletes folders that are not listed.

The rename must be atomic and must not overwrite, as on HDFS; on a local file system the writers of one process take turns.

Defined cases: null and empty contents are contents like others, and differ; an empty table commits nothing; extra columns are kept in the
result and do not enter the key; a content for which nothing was computed is tried again by the next call and has nulls until then.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.session import _delete, write_stage

KEY = "content_key"
_turn = threading.Lock()


def content_key(content: Sequence[str], version: str) -> Column:
    """The cache's key: null fields are left out of the text that is hashed, empty ones are not."""
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("_version"), *[F.col(c) for c in content])), 256)


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    target, fs = _files(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []


def manifest(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The cache's version and its folders, in the order of their commits; version 0 is the empty cache."""
    version = max([int(n) for n in _names(spark, f"{path}/manifests") if n.isdigit()], default=0)
    if version == 0:
        return 0, []
    target, fs = _files(spark, f"{path}/manifests/{version:012d}")
    stream = fs.open(target)
    try:
        return version, json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, version: int, folders: list[str]) -> bool:
    """Make ``folders`` the given version of the cache, unless that version is there already."""
    beside, fs = _files(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    target, _ = _files(spark, f"{path}/manifests/{version:012d}")
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(json.dumps(folders).encode()))
    finally:
        stream.close()
    with _turn:
        done = not fs.exists(target) and fs.rename(beside, target)
    if not done:
        fs.delete(beside, False)
    return done


def _read(spark: SparkSession, path: str, folders: Sequence[str], schema: T.StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{name}" for name in folders])


def _write(df: DataFrame, path: str) -> tuple[str, int]:
    """Rows as a new folder: its name, and how many there are."""
    name, seen = uuid.uuid4().hex, Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/data/{name}")
    return name, seen.get["rows"]


def append(rows: DataFrame, path: str, base: int = 0, known: Sequence[str] = ()) -> int:
    """Commit ``rows`` (content_key first), which hold no key of the folders ``known`` of version ``base``; return the version.

    Rows whose key another writer committed meanwhile are left out.
    """
    spark, schema = rows.sparkSession, rows.schema
    name, count = _write(rows.dropDuplicates([KEY]), path)
    while True:
        if count == 0:
            return base
        if _publish(spark, path, base + 1, [*known, name]):
            return base + 1
        base, latest = manifest(spark, path)
        # After a compaction, which lists its folder alone, that is all rows.
        theirs = _read(spark, path, [f for f in latest if f not in known], schema)
        name, count = _write(_read(spark, path, [name], schema).join(theirs.select(KEY), KEY, "left_anti"), path)
        known = latest


def cached(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """All rows of the cache: content_key and the columns of ``schema``, each key once."""
    return _read(spark, path, manifest(spark, path)[1], _with_key(schema))


def _with_key(schema: str | T.StructType) -> T.StructType:
    results = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return T.StructType([T.StructField(KEY, T.StringType()), *results.fields])


def fill(
    df: DataFrame, path: str, content: Sequence[str], compute: Callable[[DataFrame], DataFrame], schema: str | T.StructType, version: str
) -> DataFrame:
    """``df`` with the columns of ``schema`` that ``compute`` gives for the columns ``content``.

    ``compute`` gets one row per content that the cache lacks (content_key and the content) and returns them with their results; it
    runs once for each. ``version`` names the model: its results are those of no other.
    """
    spark, stored = df.sparkSession, _with_key(schema)
    taken = {KEY, *(f.name for f in stored)} & set(df.columns)
    if taken:
        raise ValueError(f"the input already has columns {sorted(taken)}")
    base, known = manifest(spark, path)
    keyed = df.withColumn(KEY, content_key(content, version))
    asked = keyed.select(KEY, *content).dropDuplicates([KEY])
    missing, seen = write_stage(asked.join(_read(spark, path, known, stored).select(KEY), KEY, "left_anti"), "cache-missing")
    if seen["rows"]:
        append(compute(missing).select(*[F.col(f.name).cast(f.dataType) for f in stored]), path, base, known)
    return keyed.join(cached(spark, path, schema), KEY, "left").drop(KEY)


def compact(spark: SparkSession, path: str, schema: str | T.StructType) -> int:
    """Write the rows of all commits to one folder; commits made meanwhile stay beside it. Returns the version."""
    base, known = manifest(spark, path)
    if len(known) < 2:
        return base
    whole, _ = _write(_read(spark, path, known, _with_key(schema)), path)
    while True:
        now, latest = manifest(spark, path)
        if not set(known) <= set(latest):
            # Another compaction was first.
            return now
        if _publish(spark, path, now + 1, [whole, *[f for f in latest if f not in known]]):
            return now + 1


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the folders that the latest manifest does not name, while no other job writes or reads; return how many."""
    _, known = manifest(spark, path)
    gone = [n for n in _names(spark, f"{path}/data") if n not in known]
    for name in gone:
        _delete(spark, f"{path}/data/{name}")
    return len(gone)
