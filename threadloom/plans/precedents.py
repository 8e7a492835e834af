"""Classified messages to a holdout, a precedent table and its index."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import retrieve, sampling, threads
from threadloom.operators.gold import GoldRules, ambiguity_log, rule_gold
from threadloom.operators.joins import enrich
from threadloom.session import write_stage


@dataclass(frozen=True)
class Split:
    holdout: DataFrame
    indexable: DataFrame


def split_corpus(classified: DataFrame, size: int = 300, seed: int = 42) -> Split:
    """Hold out ``size`` messages, stratified by intent; both parts are written."""
    held, rest = sampling.holdout_split(classified, ["predicted_intent"], size, "thread_id", seed)
    held, rest = write_stage(held, "holdout")[0], write_stage(rest, "indexable")[0]
    sampling.assert_quality(held, {"has_intent": F.col("predicted_intent").isNotNull()}, size)
    return Split(held, rest)


def precedent_index(
    split: Split,
    posts: DataFrame,
    extract: Callable[[DataFrame], DataFrame],
    embedder: Callable[[DataFrame, str, str], DataFrame],
    path: str,
    brand: str | None = None,
    size: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Attach brand replies, draw ``size`` messages by intent, extract actions, embed, store.

    ``extract`` maps (thread_id, ..., brand_reply_text) rows to (thread_id, action_taken, outcome);
    ``embedder`` adds a vector column for a text column.
    """
    replies = threads.brand_replies(posts, brand)
    pool, _ = write_stage(split.indexable.join(replies.drop("thread_key"), "thread_id"), "precedent-pool")
    if size is not None:
        pool, _ = write_stage(sampling.exact_sample(pool, ["predicted_intent"], size, "thread_id", seed), "precedent-sample")
    table = retrieve.build_precedents(pool.drop("brand_reply_text"), pool, extract(pool))
    composed = table.withColumn(
        "composed", F.concat(F.lit("Customer: "), "customer_message", F.lit(" | Action: "), "action_taken")
    )
    embedded = embedder(embedder(composed, "composed", "embedding"), "action_taken", "action_vector")
    stored, _ = write_stage(embedded.withColumn("hit_id", F.col("thread_id")), "precedents")
    return retrieve.write_index(stored.drop("composed"), split.holdout, path)


@dataclass(frozen=True)
class GoldSet:
    """Labelled messages, the log of ambiguous ones, and every part of their transcripts."""

    labelled: DataFrame
    ambiguous: DataFrame
    contexts: DataFrame


def gold_set(
    holdout: DataFrame,
    targets: Mapping[str, int],
    posts: DataFrame,
    tagged: DataFrame,
    rules: GoldRules = GoldRules(),
    seed: int = 42,
) -> GoldSet:
    """Draw, attach what is known of the thread, and label.

    ``contexts`` holds the whole transcripts, a giant thread's in several parts (thread_key, part, transcript); a drawn
    message without a thread in ``posts`` has its own text as the context.
    """
    drawn = sampling.sample_targets(holdout, targets, "thread_id", "predicted_intent", seed)
    drawn, _ = write_stage(drawn, "gold-sample")
    mine = posts.join(drawn.select("thread_key"), "thread_key", "left_semi")
    found, _ = write_stage(threads.transcripts(mine), "gold-transcripts")
    alone = drawn.join(found.select("thread_key"), "thread_key", "left_anti")
    own = alone.select("thread_key", F.lit(0).cast("bigint").alias("part"), F.concat(F.lit("[Customer]: "), F.col("text")).alias("transcript"))
    contexts, _ = write_stage(found.unionByName(own), "gold-contexts")
    parts = contexts.groupBy("thread_key").agg(F.count(F.lit(1)).alias("context_parts"))
    known = parts.join(threads.last_brand_reply(mine), "thread_key", "left")
    known = known.join(tagged.select("thread_key", "resolution_reason"), "thread_key", "left").select(
        "thread_key", "context_parts", "historical_brand_reply", F.col("resolution_reason").alias("historical_resolution_reason")
    )
    enriched = enrich(
        drawn,
        known,
        "thread_key",
        {"context_parts": F.lit(0).cast("bigint"), "historical_brand_reply": "", "historical_resolution_reason": "unknown"},
    )
    labelled, _ = write_stage(rule_gold(enriched, rules), "gold")
    return GoldSet(labelled, ambiguity_log(labelled, "thread_id"), contexts)
