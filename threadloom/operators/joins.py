"""Joins of messages with threads and between samples. All are plain equi-joins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.values import half_even


class LeakageError(AssertionError):
    """Two tables that must be disjoint share ids."""


def with_replies(messages: DataFrame, replies: DataFrame, key: str = "thread_id") -> DataFrame:
    return messages.join(replies, key, "inner")


def only_in(df: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    return df.join(pool.select(key), key, "left_semi")


def not_in(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is absent from ``done``; NULL keys in ``done`` exclude nothing."""
    return df.join(done.select(key), key, "left_anti")


def enrich(df: DataFrame, other: DataFrame, key: str, defaults: Mapping[str, object]) -> DataFrame:
    """Left join with a default (a value or a column) for each attached column without a match."""
    joined = df.join(other.select(key, *defaults), key, "left")
    filled = [F.coalesce(F.col(name), value if hasattr(value, "alias") else F.lit(value)).alias(name)
              for name, value in defaults.items()]
    return joined.select(*df.columns, *filled)


def overlap(a: DataFrame, b: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """One row: how many distinct ids two tables share, the share of each, and a few of them."""
    both = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
    shared = both.agg(F.count(F.lit(1))).scalar()
    first = both.orderBy(key).limit(examples).agg(F.array_sort(F.collect_list(key))).scalar()
    size_b = b.agg(F.count(F.lit(1))).scalar()
    counted = a.agg(F.count(F.lit(1)).alias("size_a")).withColumn("size_b", size_b).withColumn("shared", shared)
    return counted.select(
        "size_a",
        "size_b",
        "shared",
        half_even(F.col("shared") * 100.0 / F.greatest("size_a", F.lit(1)), 2).alias("pct_of_a"),
        half_even(F.col("shared") * 100.0 / F.greatest("size_b", F.lit(1)), 2).alias("pct_of_b"),
        first.alias("examples"),
    )


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    shared = a.select(key).join(b.select(key), key, "left_semi").distinct().limit(6).collect()
    if shared:
        names = ", ".join(str(r[0]) for r in shared[:5])
        raise LeakageError(f"the tables share {key}s, among them {names}")


def coverage(a: DataFrame, b: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """One row: sizes of two parts, their intersection and union, and whether they split the whole."""
    ids = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    per_id = ids.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    total = whole.select(key).distinct().agg(F.count(F.lit(1))).scalar()
    return per_id.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("in_a"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("in_b"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("in_both"),
        F.count(F.lit(1)).alias("in_either"),
    ).withColumn("complete", (F.col("in_both") == 0) & (F.col("in_either") == total))
