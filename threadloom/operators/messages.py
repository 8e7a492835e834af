"""Per-message rules: strata, keyword intent, policy, validation, templates, examples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom import presets
from threadloom.functions import text as tx
from threadloom.session import literal_table

MAX_CHARS = 1000


def length_bin(length: Column) -> Column:
    return F.when(length <= 2, "short_2").when(length <= 4, "medium_3_4").otherwise("long_5plus")


def period_bin(time: Column, cutoff: str) -> Column:
    """Month of the message as "YYYY_MM"; everything before the cutoff month is one bin."""
    month = F.date_format(time, "yyyy_MM")
    first = cutoff.replace("-", "_")
    return F.when(time.isNull(), "unknown_time").when(month < first, f"pre_{first}").otherwise(month)


def assign_strata(df: DataFrame, cutoff: str = "2017-10", time: str = "start_time") -> DataFrame:
    """Add thread_length_bin, time_period and their combination, ``stratum``."""
    binned = df.withColumns(
        {"thread_length_bin": length_bin(F.col("thread_length")), "time_period": period_bin(F.col(time), cutoff)}
    )
    return binned.withColumn("stratum", F.concat_ws("__", "time_period", "thread_length_bin"))


def composite_stratum(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    label = F.concat(F.col("time_period"), F.lit("__cluster_"), F.col(cluster).cast("string"))
    return df.withColumn("composite_stratum", label)


def classify_keywords(
    df: DataFrame,
    rules: Sequence[tuple[str, str]] = presets.KEYWORD_RULES,
    default: str = presets.DEFAULT_INTENT,
    text: str = "text",
    hit: float = presets.MATCH_CONFIDENCE,
    miss: float = presets.DEFAULT_CONFIDENCE,
) -> DataFrame:
    """Add predicted_intent and intent_confidence from ordered (label, pattern) rules.

    A pattern is only tried on texts that hold a part which its matches need: plain parts are found many times faster.
    """
    cheap = [tx.may_match(p, F.col("_folded")) for _, p in rules]
    found = tx.first_match([(label, tx.unicode_pattern(p)) for label, p in rules], F.col(text), cheap)
    return df.withColumn("_folded", tx.folded(F.col(text))).withColumn("_found", found).drop("_folded").select(
        "*",
        F.coalesce("_found", F.lit(default)).alias("predicted_intent"),
        F.when(F.col("_found").isNotNull(), F.lit(hit)).otherwise(F.lit(miss)).alias("intent_confidence"),
    ).drop("_found")


def attach_policy(df: DataFrame, taxonomy: DataFrame, intent: str = "predicted_intent") -> DataFrame:
    """Add ``escalation_default`` from the taxonomy; an unknown intent has none."""
    policy = taxonomy.select(F.col("intent").alias(intent), F.col("escalate").alias("_flag"))
    return df.join(policy, intent, "left").select(
        *df.columns, F.coalesce("_flag", F.lit(False)).alias("escalation_default")
    )


def attach_template(
    df: DataFrame,
    templates: Mapping[str, str] = presets.REPLY_TEMPLATES,
    default: str = presets.DEFAULT_TEMPLATE,
    intent: str = "predicted_intent",
) -> DataFrame:
    """Add ``drafted_reply``: the template of the intent, or the default. Templates are a map literal, not a join."""
    if not templates:
        return df.withColumn("drafted_reply", F.lit(default))
    table = F.create_map(*[F.lit(x) for pair in templates.items() for x in pair])
    return df.withColumn("drafted_reply", F.coalesce(F.try_element_at(table, F.col(intent)), F.lit(default)))


def rejection(col: Column, max_chars: int = MAX_CHARS) -> Column:
    """Why a message is refused, NULL if it is accepted. Only texts over the limit are trimmed first."""
    long = (F.length(col) > max_chars) & (F.length(tx.strip(col)) > max_chars)
    return F.when(tx.is_blank(col), F.lit("empty")).when(long, F.lit("too_long"))


def check_messages(df: DataFrame, text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """Add ``rejected``, the reason a message is refused; accepted messages have NULL."""
    return df.withColumn("rejected", rejection(F.col(text), max_chars))


def split_valid(df: DataFrame, text: str = "text", max_chars: int = MAX_CHARS) -> tuple[DataFrame, DataFrame]:
    """(accepted with trimmed text, rejected with reason)."""
    checked = check_messages(df, text, max_chars)
    accepted = checked.where(F.col("rejected").isNull()).drop("rejected")
    return accepted.withColumn(text, tx.strip(F.col(text))), checked.where(F.col("rejected").isNotNull())


def pick_examples(
    df: DataFrame, id_col: str, low: int = 40, high: int = 240, n: int = 2,
    intent: str = "predicted_intent", text: str = "text",
) -> DataFrame:
    """The first n messages per intent whose length fits, or the first n of any length if none fits.

    Fitting messages sort first, so one limited window answers both cases: a message that does not
    fit is kept only when its intent has no fitting one.
    """
    fits = F.length(text).between(low, high)
    order = Window.partitionBy(intent).orderBy(F.desc("_fits"), F.col(id_col))
    ranked = (
        df.withColumn("_fits", F.coalesce(fits, F.lit(False)))
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= n)
    )
    # Over at most n rows per intent.
    any_fit = F.max("_fits").over(Window.partitionBy(intent))
    kept = ranked.withColumn("_any", any_fit).where(F.col("_fits") | ~F.col("_any"))
    shown = tx.ascii_only(F.col(text))
    return kept.select(
        id_col, intent, F.col("_n").alias("rank"), shown.alias("text"), F.length(shown).alias("length")
    )


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence, n: int, out: str = "rank") -> DataFrame:
    """The first n rows per group, ranked; map tasks pass on at most n rows per group."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= n)


def keep_first(parts: Sequence[DataFrame], key: Sequence[str], order: str) -> DataFrame:
    """Union of the parts with one row per key, taken from the earliest part that has it."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    union = tagged[0]
    for part in tagged[1:]:
        union = union.unionByName(part)
    return first_per_group(union, key, ["_part", order], 1, "_n").drop("_part", "_n")


def first_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in the given order: a cap on how much a run takes on."""
    return df.orderBy(*order).limit(n)
