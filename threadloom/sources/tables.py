"""Reading and writing tables, reports, JSON documents and logs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet; partition columns should have few values, such as the intent."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_results_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records as ``write_results_json`` writes them: one per line, so large files are split among tasks."""
    return spark.read.schema(schema).json(path)


def read_json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON documents, each a list of records or a single one, over any number of lines; a file is read by one task."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_results_json(df: DataFrame, path: str) -> None:
    """One record per line."""
    df.write.mode("overwrite").json(path)


def append_event_log(df: DataFrame, path: str) -> None:
    """Add rows to a JSON-lines log; files already there are never rewritten."""
    df.write.mode("append").json(path)


def record_stats(df: DataFrame, path: str, step: str) -> None:
    """Append a one-row statistics frame as (step, metric, value, recorded_at) rows."""
    values = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in df.columns])
    long = df.select(F.explode(values).alias("m")).select(
        F.lit(step).alias("step"), "m.metric", "m.value", F.current_timestamp().alias("recorded_at")
    )
    long.write.mode("append").parquet(path)


def latest_stats(log: DataFrame) -> DataFrame:
    """The rows of each step's latest recording."""
    newest = log.groupBy("step").agg(F.max("recorded_at").alias("recorded_at"))
    return log.join(newest, ["step", "recorded_at"])


def latest_per_key(log: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """The last row per key in ``order``; each map task passes on one row per key."""
    last = Window.partitionBy(*key).orderBy(*order)
    return log.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def open_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The table at ``path``, created without rows if there is none yet."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def fill_missing(
    df: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame], schema: str | T.StructType
) -> DataFrame:
    """A table cache keyed by id: compute and append only the rows that ``path`` does not have yet.

    The rows to compute are found by an anti-join, so an interrupted job resumes where it stopped.
    """
    spark = df.sparkSession
    have = open_table(spark, path, schema)
    compute(df.join(have.select(key), key, "left_anti")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).join(df.select(key), key, "left_semi")
