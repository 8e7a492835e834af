"""Distributions, crosstabs, usage, term reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom import presets
from threadloom.functions import text as tx
from threadloom.functions.values import half_even, percent
from threadloom.session import write_stage


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Rows per value and their share, the most frequent first; the total is observed while the counts are written."""
    counted, seen = write_stage(df.groupBy(col).agg(F.count(F.lit(1)).alias("count")), "distribution", total=F.sum("count"))
    total = F.lit(seen["total"])
    return counted.withColumn("pct", percent(F.col("count"), total)).orderBy(F.desc("count"), col)


def crosstab(df: DataFrame, rows: str, cols: str, values: Sequence[str], other: str = "other") -> DataFrame:
    """Counts per pair of values, 0 where a pair is missing.

    Column values are given; what is none of them, or null, counts in the column ``other``, so that rows add up.
    """
    rest = ~F.coalesce(F.col(cols).isin(*values), F.lit(False))
    return df.groupBy(rows).agg(*[F.count_if(F.col(cols) == v).alias(v) for v in values], F.count_if(rest).alias(other))


def split_report(holdout: DataFrame, indexable: DataFrame, label: str) -> DataFrame:
    """Per label and in total: rows, held-out rows, remaining rows, share of the holdout."""
    parts = holdout.select(label, F.lit(1).alias("h")).unionByName(indexable.select(label, F.lit(0).alias("h")))
    counted = parts.groupBy(label).agg(F.count(F.lit(1)).alias("total"), F.sum("h").alias("holdout"))
    whole = counted.agg(F.sum("total").alias("total"), F.sum("holdout").alias("holdout"))
    both = counted.unionByName(whole.select(F.lit("TOTAL").alias(label), "total", "holdout"))
    size = whole.select("holdout").scalar()
    return both.select(
        label,
        "total",
        "holdout",
        (F.col("total") - F.col("holdout")).alias("indexable"),
        percent(F.col("holdout"), size, 1).alias("holdout_pct"),
    )


def usage_report(
    df: DataFrame, rates: Mapping[str, tuple[float, float]] | tuple[float, float], step: str = "step",
    prompt: str = "prompt_tokens", completion: str = "completion_tokens",
) -> DataFrame:
    """Per step: rows, tokens, tokens per row and cost; rates are per million tokens."""
    if isinstance(rates, tuple):
        rate_p, rate_c = F.lit(rates[0]), F.lit(rates[1])
    else:
        pick = lambda i: F.coalesce(*[F.when(F.col(step) == s, F.lit(r[i])) for s, r in rates.items()], F.lit(0.0))
        rate_p, rate_c = pick(0), pick(1)
    summed = df.groupBy(step).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(prompt).alias("prompt_tokens"),
        F.sum(completion).alias("completion_tokens"),
    )
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    cost = (F.col("prompt_tokens") * rate_p + F.col("completion_tokens") * rate_c) / F.lit(1_000_000.0)
    return summed.select(
        "*",
        total.alias("total_tokens"),
        half_even(total / F.col("calls"), 2).alias("avg_tokens"),
        half_even(cost, 4).alias("cost"),
    )


def modal_share(df: DataFrame, key: str, col: str) -> DataFrame:
    """Per key: the count of the most frequent value as a share of the key's rows."""
    counted = df.groupBy(key, col).agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy(key).agg(
        F.sum("c").alias("k"), F.max("c").alias("modal"), (F.max("c") / F.sum("c")).alias("modal_share")
    )


def term_counts(
    df: DataFrame,
    by: Sequence[str],
    text: str = "text",
    stop: Sequence[str] = presets.TERM_STOP_WORDS,
    order: str | None = None,
) -> DataFrame:
    """Count of every lower-case word of four or more letters a-z, by group.

    Counts combine on the map side, so a group with a third of all texts sends each word once per
    task. With ``order`` (the order of the texts) each word also gets its first place.
    """
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"(?<!{tx.WORD})([a-z]{{4,}})(?!{tx.WORD})"), F.lit(1))
    place = [F.col(order).alias("_text")] if order else []
    terms = df.select(*by, *place, F.posexplode(found).alias("_place", "term"))
    if stop:
        terms = terms.where(~F.col("term").isin(*stop))
    first = [F.min(F.struct("_text", "_place")).alias("first")] if order else []
    return terms.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"), *first)


def top_terms(
    df: DataFrame,
    n: int = 2,
    by: Sequence[str] = (),
    text: str = "text",
    stop: Sequence[str] = presets.TERM_STOP_WORDS,
    order: str | None = None,
) -> DataFrame:
    """The n most frequent terms per group (or overall); ties by first place if known, then by term."""
    counted = term_counts(df, by, text, stop, order)
    ties = ["first", "term"] if order else ["term"]
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("n"), *ties)
    return counted.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def label_clusters(
    exemplars: DataFrame,
    cluster: str = "cluster",
    rank: str = "rank",
    text: str = "text",
    rules: Sequence[tuple[str, str, str]] = presets.CLUSTER_RULES,
    stop: Sequence[str] = presets.TERM_STOP_WORDS,
    per_cluster: int = 15,
    hits: int = presets.CLUSTER_HITS,
) -> DataFrame:
    """Label and description per cluster from its first ``per_cluster`` exemplars.

    The first rule with enough hits in their combined text wins; otherwise the two most frequent
    terms name the cluster.
    """
    used = exemplars.where(F.col(rank) <= per_cluster)
    texts = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"))))
    combined = used.groupBy(cluster).agg(
        F.lower(F.array_join(F.transform(texts, lambda x: x["t"]), " ")).alias("combined")
    )
    enough = [
        (F.regexp_count("combined", F.lit(tx.unicode_pattern(pattern))) >= hits, label, about)
        for pattern, label, about in rules
    ]
    terms = top_terms(used, 2, [cluster], text, stop, order=rank)
    first = F.max(F.when(F.col("rank") == 1, F.col("term")))
    second = F.max(F.when(F.col("rank") == 2, F.col("term")))
    fallback = terms.groupBy(cluster).agg(
        F.concat_ws("_", first, second).alias("_terms"), F.concat_ws(" and ", first, second).alias("_about")
    )
    named = combined.join(fallback, cluster, "left")
    return named.select(
        cluster,
        F.coalesce(
            *[F.when(ok, F.lit(label)) for ok, label, _ in enough],
            F.concat(F.coalesce("_terms", F.lit(presets.NO_TERMS_LABEL)), F.lit("_inquiry")),
        ).alias("label"),
        F.coalesce(
            *[F.when(ok, F.lit(about)) for ok, _, about in enough],
            F.concat(F.lit(presets.CLUSTER_ABOUT), F.coalesce("_about", F.lit(presets.NO_TERMS_ABOUT)), F.lit(".")),
        ).alias("description"),
    )


def label_progress(gold: DataFrame, labels: DataFrame, key: str = "thread_id") -> DataFrame:
    """One row: items, labelled items, percent labelled (0 for no items)."""
    marked = gold.select(key).join(labels.select(key, F.lit(1).alias("l")).distinct(), key, "left")
    counted = marked.agg(F.count(F.lit(1)).alias("total"), F.count("l").alias("labelled"))
    return counted.withColumn("percent", percent(F.col("labelled"), F.col("total"), 1))
