"""Resolution rules and brand reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import presets
from threadloom.functions import text as tx
from threadloom.functions.values import half_even, order_key, percent
from threadloom.operators.threads import thread_brands
from threadloom.session import small_side


@dataclass(frozen=True)
class ResolutionRules:
    inactivity_hours: float = 24.0
    closure_words: tuple[str, ...] = presets.CLOSURE_WORDS
    case_sensitive: bool = False

    @property
    def dormant(self) -> str:
        return f"brand_final_reply_dormant_{self.inactivity_hours:.0f}h"


def has_closure(col: Column, rules: ResolutionRules = ResolutionRules()) -> Column:
    return tx.has_word(col, rules.closure_words, rules.case_sensitive)


def closing_facts(
    posts: DataFrame, rules: ResolutionRules = ResolutionRules(), brand: str | None = None
) -> DataFrame:
    """What the rules need of each thread: who spoke last and when, and the last customer text.

    The closure test runs per post, before the shuffle, so that only a flag travels with it.
    """
    key = order_key(F.col("created_at"), F.col("post_id"))
    by_brand = ~F.col("inbound")
    if brand is not None:
        by_brand = by_brand | F.coalesce(F.lower("author_id") == brand.lower(), F.lit(False))
    customer = F.when(F.col("inbound"), key)
    posts = posts.withColumn("grateful", F.col("inbound") & has_closure(F.col("text"), rules))
    return posts.groupBy("thread_key").agg(
        F.min(key).alias("first"),
        F.max(key).alias("last"),
        F.max_by("inbound", key).alias("customer_last"),
        F.bool_or("inbound").alias("has_customer"),
        F.bool_or(by_brand).alias("has_brand"),
        F.max_by("grateful", customer).alias("grateful"),
        F.count(F.lit(1)).alias("thread_length"),
    ).select(
        "thread_key",
        F.concat(F.lit("T_"), F.col("first.id").cast("string")).alias("thread_id"),
        F.when(~F.col("last.untimed"), F.col("last.at")).alias("end_time"),
        "customer_last",
        "has_customer",
        "has_brand",
        F.coalesce("grateful", F.lit(False)).alias("grateful"),
        "thread_length",
    )


def dataset_max_time(facts: DataFrame) -> DataFrame:
    """One row: the latest end of any thread."""
    return facts.agg(F.max("end_time").alias("max_time"))


def tag_resolution(
    facts: DataFrame, rules: ResolutionRules = ResolutionRules(), max_time: DataFrame | None = None
) -> DataFrame:
    """Add ``resolved`` ("true", "false", "unknown") and ``resolution_reason``.

    ``max_time`` is a one-row table, by default the latest end of the given threads; it enters
    as a scalar subquery.
    """
    latest = (dataset_max_time(facts) if max_time is None else max_time).scalar()
    idle = (F.unix_micros(latest) - F.unix_micros("end_time")) / F.lit(3_600_000_000.0)
    return reasoned(facts, idle < rules.inactivity_hours, rules)


def reasoned(facts: DataFrame, recent: Column, rules: ResolutionRules) -> DataFrame:
    """``facts`` with outcome and reason; ``recent`` says whether a thread's last post is too young to count as dormant."""
    brand_spoke_last = (
        F.when(F.col("grateful"), F.lit("customer_gratitude_confirmed_by_brand"))
        .when(recent, F.lit("brand_final_reply_recent_insufficient_observation_window"))
        .otherwise(F.lit(rules.dormant))
    )
    reason = (
        F.when(F.coalesce("thread_length", F.lit(0)) == 0, F.lit("empty_thread"))
        .when(F.col("has_customer") & ~F.col("has_brand"), F.lit("unanswered_by_brand"))
        .when(~F.col("has_customer"), F.lit("single_sided_outbound_announcement"))
        .when(F.col("customer_last") & F.col("grateful"), F.lit("customer_gratitude_closure"))
        .when(F.col("customer_last"), F.lit("pending_brand_reply"))
        .otherwise(brand_spoke_last)
    )
    tagged = facts.withColumn("resolution_reason", reason)
    return tagged.withColumn("resolved", resolved_of(F.col("resolution_reason")))


def resolved_of(reason: Column) -> Column:
    return (
        F.when(reason.isin("unanswered_by_brand", "pending_brand_reply"), F.lit("false"))
        .when(
            reason.isin(
                "empty_thread",
                "single_sided_outbound_announcement",
                "brand_final_reply_recent_insufficient_observation_window",
            ),
            F.lit("unknown"),
        )
        .otherwise(F.lit("true"))
    )


def filter_brand(threads: DataFrame, brand: str) -> DataFrame:
    """Threads (array form, with all their parts) that involve the brand, whatever its letter case."""
    wanted = brand.strip().lower()
    return threads.where(F.exists("brands", lambda b: F.lower(b) == wanted))


def brand_threads(posts: DataFrame, brand: str) -> DataFrame:
    """Flat posts of the threads in which the brand wrote an outbound post."""
    wanted = (~F.col("inbound")) & (F.lower("author_id") == brand.strip().lower())
    keys = small_side(posts.where(wanted).select("thread_key").distinct(), "brand-threads")
    return posts.join(keys, "thread_key", "left_semi")


def resolution_summary(tagged: DataFrame) -> DataFrame:
    """One row per reason, with its share of all threads and the totals per outcome."""
    reasons = tagged.groupBy("resolved", "resolution_reason").agg(
        F.count(F.lit(1)).alias("threads"), F.sum("thread_length").alias("posts")
    )
    total = tagged.agg(F.count(F.lit(1)).alias("n")).scalar()
    return reasons.select(
        "resolved",
        "resolution_reason",
        "threads",
        "posts",
        half_even(F.col("posts") / F.col("threads"), 2).alias("avg_thread_length"),
        percent(F.col("threads"), total).alias("pct_of_threads"),
    )


def outcome_totals(tagged: DataFrame) -> DataFrame:
    """One row: threads per outcome, share resolved, mean length; the outcomes add up to the total."""
    status = F.col("resolved")
    return tagged.agg(
        F.count(F.lit(1)).alias("total_threads"),
        F.coalesce(F.sum("thread_length"), F.lit(0)).alias("total_posts"),
        F.count_if(status == "true").alias("resolved_threads"),
        F.count_if(status == "false").alias("unresolved_threads"),
        F.count_if(status == "unknown").alias("unknown_threads"),
        half_even(F.avg("thread_length"), 2).alias("avg_thread_length"),
    ).withColumn("pct_resolved", percent(F.col("resolved_threads"), F.col("total_threads")))


def brand_candidates(posts: DataFrame, tagged: DataFrame, top_n: int = 20) -> DataFrame:
    """The ``top_n`` brands by thread count, with volume and outcomes.

    The outcome of a thread is the same for each brand that wrote in it, as every such brand makes
    the thread two-sided, so threads are tagged once and joined to their brands.
    """
    status = F.col("resolved")
    report = (
        thread_brands(posts)
        .join(tagged.select("thread_key", "thread_length", "resolved"), "thread_key")
        .groupBy("brand_key")
        .agg(
            F.min("brand").alias("brand"),
            F.sum("brand_posts").alias("total_brand_posts"),
            F.sum("thread_length").alias("total_thread_posts"),
            F.count(F.lit(1)).alias("total_threads"),
            half_even(F.avg("thread_length"), 2).alias("avg_thread_length"),
            F.count_if(status == "true").alias("resolved_threads"),
            F.count_if(status == "false").alias("unresolved_threads"),
            F.count_if(status == "unknown").alias("unknown_threads"),
        )
        .withColumn("pct_resolved", percent(F.col("resolved_threads"), F.col("total_threads")))
    )
    return report.orderBy(F.desc("total_threads"), "brand").limit(top_n).drop("brand_key")
