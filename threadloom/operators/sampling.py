"""Reproducible stratified draws, splits and quality checks.

Which rows are drawn is decided by hash order, so a draw is the same in any partitioning. The
per-stratum table is small and all allocation happens on it; the data is filtered, never sorted.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.values import hash_order
from threadloom.operators.bounded import hash_histogram, mark_by_hash, number_rows, take_by_hash
from threadloom.session import literal_table, write_stage


def _slim(df: DataFrame, strata: Sequence[str], id_col: str) -> DataFrame:
    """Strata and ids of a table, written once: everything about a draw but the draw itself reads this."""
    return write_stage(df.select(*dict.fromkeys([*strata, id_col])), "draw-ids")[0]


class QualityError(AssertionError):
    """A data-quality rule has failures."""


def stratum_sizes(hist: DataFrame, strata: Sequence[str]) -> DataFrame:
    return hist.groupBy(*strata).agg(F.sum("_rows").alias("size"))


def _proportional(sizes: DataFrame, n: int, rows: Column) -> DataFrame:
    return sizes.withColumn("_share", F.bround(F.lit(n) * (F.col("size") / rows)).cast("bigint"))


def allocate(sizes: DataFrame, strata: Sequence[str], n: int) -> DataFrame:
    """Proportional quotas (column ``n``): half-even rounding, at least 1, at most the stratum.

    The rounding difference is handed out one by one over the strata by falling size, round after
    round; a stratum that is full (or at 1) passes its turn. Every stratum has the whole rounds; a histogram of the sizes tells down to
    which size one turn more is left, and only strata of that size are put in order, so no task sees all strata.
    """
    strata = list(strata)
    sizes, seen = write_stage(sizes, "stratum-sizes", total=F.sum("size"))
    total = seen["total"] or 0
    if n >= total:
        return sizes.select(*strata, "size", F.col("size").cast("bigint").alias("n"))
    base = _proportional(sizes, n, F.lit(total)).withColumn("_base", F.greatest(F.lit(1), F.least("size", "_share")))
    diff = n - base.agg(F.sum("_base")).first()[0]
    rounds, left = divmod(abs(diff), seen["rows"])
    # As many rows as there are different sizes, at most the square root of twice the number of rows.
    levels = sorted(((r["size"], r["strata"]) for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("strata")).collect()), reverse=True)
    level = 0
    for level, many in levels:
        if many > left:
            break
        left -= many
    further = F.when(F.col("size") > level, 1).otherwise(0)
    if left:
        order = [F.col(f"`{c}`").asc() for c in strata]
        placed = number_rows(base.where(F.col("size") == level), ["size"], order, "_place")
        turns = placed.withColumn("_turns", F.lit(rounds) + (F.col("_place") < left).cast("int")).drop("_place")
        turns = turns.unionByName(base.where(F.col("size") != level).withColumn("_turns", F.lit(rounds) + further))
    else:
        turns = base.withColumn("_turns", F.lit(rounds) + further)
    moved = F.least("size", F.col("_base") + F.col("_turns")) if diff > 0 else F.greatest(F.lit(1), F.col("_base") - F.col("_turns"))
    return turns.select(*strata, "size", moved.cast("bigint").alias("n"))


def allocate_floor(sizes: DataFrame, strata: Sequence[str], n: int) -> DataFrame:
    """Proportional quotas with at least 1 and at most the stratum; they need not add up to n."""
    rows = sizes.agg(F.sum("size")).scalar()
    quota = F.least("size", F.greatest(F.lit(1), F.col("_share")))
    return _proportional(sizes, n, rows).select(*strata, "size", quota.cast("bigint").alias("n"))


def allocate_holdout(sizes: DataFrame, strata: Sequence[str], n: int) -> DataFrame:
    """Proportional quotas with at least 1; the whole rounding difference goes to the largest stratum, the first of them by its keys."""
    sizes, seen = write_stage(sizes, "stratum-sizes", total=F.sum("size"))
    base = _proportional(sizes, n, F.lit(seen["total"] or 0)).withColumn("_base", F.greatest(F.lit(1), F.col("_share")))
    if not seen["rows"]:
        return base.select(*strata, "size", F.col("_base").cast("bigint").alias("n"))
    diff = n - base.agg(F.sum("_base")).first()[0]
    largest = sizes.orderBy(F.desc("size"), *strata).limit(1).withColumn("_first", F.lit(True))
    same = functools.reduce(lambda x, y: x & y, [base[c].eqNullSafe(largest[c]) for c in strata])
    joined = base.join(F.broadcast(largest), same, "left")
    quota = base["_base"] + F.when(largest["_first"], F.lit(diff)).otherwise(F.lit(0))
    return joined.select(*[base[c] for c in strata], base["size"], quota.cast("bigint").alias("n"))


def stratified_sample(df: DataFrame, strata: Sequence[str], n: int, id_col: str, seed: int = 42) -> DataFrame:
    """Proportional sample of n rows; the whole table if it has no more than n."""
    slim = _slim(df, strata, id_col)
    hist = hash_histogram(slim, strata, id_col, seed)
    quotas = allocate(stratum_sizes(hist, strata), strata, n)
    return take_by_hash(df, strata, id_col, seed, quotas, hist, slim)


def exact_sample(df: DataFrame, strata: Sequence[str], n: int, id_col: str, seed: int = 42) -> DataFrame:
    """At least one row per stratum, then trimmed or topped up to exactly n rows.

    Trimming and topping up draw over all strata, in hash orders of their own.
    """
    slim = _slim(df, strata, id_col)
    hist = hash_histogram(slim, strata, id_col, seed)
    quotas, _ = write_stage(allocate_floor(stratum_sizes(hist, strata), strata, n), "quotas")
    marked = mark_by_hash(df, strata, id_col, seed, quotas, hist, slim)
    drawn, rest = marked.where("drawn").drop("drawn"), marked.where("NOT drawn").drop("drawn")
    wanted = quotas.agg(F.sum("n")).first()[0] or 0
    if wanted > n:
        return take_by_hash(drawn, [], id_col, seed + 1, n)
    if wanted < n:
        return drawn.unionByName(take_by_hash(rest, [], id_col, seed + 2, n - wanted))
    return drawn


def holdout_split(df: DataFrame, strata: Sequence[str], n: int, id_col: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(holdout of exactly n rows, the rest), disjoint by ``id_col``; both are filters on the table."""
    slim = _slim(df, strata, id_col)
    hist = hash_histogram(slim, strata, id_col, seed)
    # What must hold of the quotas is observed while they are written.
    bad = (F.col("n") > F.col("size")) | (F.col("n") < 0)
    quotas, seen = write_stage(
        allocate_holdout(stratum_sizes(hist, strata), strata, n), "quotas", total=F.sum("size"), bad=F.count_if(bad),
        example=F.max(F.when(bad, F.to_json(F.struct(*strata, "size", "n")))),
    )
    if n >= (seen["total"] or 0):
        raise ValueError(f"holdout of {n} rows must be smaller than the table of {seen['total'] or 0}")
    if seen["bad"]:
        raise ValueError(f"stratum {seen['example']} cannot supply its share of the holdout")
    marked = mark_by_hash(df, strata, id_col, seed, quotas, hist, slim)
    return marked.where("drawn").drop("drawn"), marked.where("NOT drawn").drop("drawn")


def target_table(df: DataFrame, targets: Mapping[str, int], label: str) -> DataFrame:
    return literal_table(df.sparkSession, list(targets.items()), f"{label} string, target bigint")


def needed_per_label(pool: DataFrame, done: DataFrame, targets: Mapping[str, int], id_col: str, label: str) -> DataFrame:
    """Per label: target, already there, needed, available in the pool, to take, short."""
    have = done.groupBy(label).agg(F.count(F.lit(1)).alias("have"))
    open_pool = pool.join(done.select(id_col), id_col, "left_anti")
    available = open_pool.groupBy(label).agg(F.count(F.lit(1)).alias("available"))
    table = target_table(pool, targets, label).join(have, label, "left").join(available, label, "left")
    needed = F.greatest(F.lit(0), F.col("target") - F.col("have"))
    return (
        table.select(label, "target", F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("available", F.lit(0)).alias("available"))
        .withColumn("needed", needed)
        .withColumn("n", F.least("needed", "available"))
        .withColumn("short", F.col("needed") - F.col("n"))
    )


def quota_topup(
    pool: DataFrame, done: DataFrame, targets: Mapping[str, int], id_col: str, label: str, seed: int = 42
) -> DataFrame:
    """New rows that bring each label up to its target, as far as the pool allows."""
    quotas = needed_per_label(pool, done, targets, id_col, label)
    candidates = pool.join(done.select(id_col), id_col, "left_anti").select(*pool.columns)
    return take_by_hash(candidates, [label], id_col, seed, quotas)


def sample_targets(df: DataFrame, targets: Mapping[str, int], id_col: str, label: str, seed: int = 42) -> DataFrame:
    """A fixed number of rows per label, or all there are."""
    quotas = target_table(df, targets, label).withColumnRenamed("target", "n")
    return take_by_hash(df, [label], id_col, seed, quotas)


def sample_per_group(df: DataFrame, group: str, n: int, id_col: str, seed: int = 42) -> DataFrame:
    return take_by_hash(df, [group], id_col, seed, n)


def hash_shuffle(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Rows in a reproducible random order (a range-partitioned sort)."""
    return df.orderBy(hash_order(F.col(id_col), seed), F.col(id_col))


def quality_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows and failures per rule; a rule is a condition that every row must meet, NULL fails it."""
    failed = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *failed)
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("failures")) for name in rules])
    return counted.select("rows", F.explode(pairs).alias("r")).select("r.rule", "rows", "r.failures")


def assert_quality(df: DataFrame, rules: Mapping[str, Column], size: int | None = None) -> None:
    report = quality_report(df, rules).collect()
    bad = [f"{r['rule']}: {r['failures']} of {r['rows']}" for r in report if r["failures"]]
    if size is not None and report and report[0]["rows"] != size:
        bad.append(f"size: {report[0]['rows']} instead of {size}")
    if bad:
        raise QualityError("; ".join(bad))
