"""Triage of a message table: check, clean, classify, retrieve, agree, draft, verify, decide."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom import presets
from threadloom.functions import text as tx
from threadloom.operators import messages as ms
from threadloom.operators import retrieve as rt
from threadloom.operators import route
from threadloom.session import small_side, write_stage

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class TriageConfig:
    """Rules and thresholds; ``classify`` and ``draft`` may replace the rule-based defaults.

    ``usage`` names numeric columns that those steps add, such as token counts; they are reported
    in the record's ``metrics``.
    """

    brand: str = ""
    rules: Sequence[tuple[str, str]] = presets.KEYWORD_RULES
    default_intent: str = presets.DEFAULT_INTENT
    templates: Mapping[str, str] = field(default_factory=lambda: dict(presets.REPLY_TEMPLATES))
    default_reply: str = presets.DEFAULT_TEMPLATE
    policy_intents: Sequence[str] = presets.POLICY_INTENTS
    confidence_min: float = presets.CONFIDENCE_MIN
    agreement_min: float = presets.AGREEMENT_MIN
    neighbours: int = 3
    empty_score: float = 1.0
    max_chars: int = ms.MAX_CHARS
    exclude_self: bool = False
    classify: Step | None = None
    draft: Step | None = None
    usage: Sequence[str] = ()


def triage(messages: DataFrame, index: DataFrame, config: TriageConfig, id_col: str = "message_id") -> DataFrame:
    """One decision record per message.

    ``messages`` has an id, ``text`` and a vector ``embedding`` (NULL if there is none); ``index``
    has hit_id, intent, embedding, action_vector, action_taken, outcome and brand_reply_text.
    A message that is refused gets a record that escalates it; none is dropped.
    """
    checked = ms.check_messages(messages, max_chars=config.max_chars)
    accepted = checked.where(F.col("rejected").isNull()).withColumn("cleaned_text", tx.clean_text(F.col("text"), config.brand))
    if config.classify is None:
        classified = ms.classify_keywords(accepted, config.rules, config.default_intent, "cleaned_text")
    else:
        classified = config.classify(accepted)
    # Classification may be costly and is read by retrieval and by the final join.
    classified, _ = write_stage(classified, "classified")

    hits = rt.retrieve(
        classified, index, config.neighbours, id_col, "hit_id", intent_of="predicted_intent", exclude_self=config.exclude_self
    )
    # At most a few hits per message: as long as they are small, they travel to the index and not the other way round.
    facts = index.select("hit_id", "action_taken", "outcome", "brand_reply_text", "action_vector")
    found, _ = write_stage(facts.join(small_side(hits, "hits"), "hit_id"), "retrieved")

    record = F.struct("rank", "hit_id", "similarity", "action_taken", "outcome", "brand_reply_text")
    evidence = F.concat_ws("\n", F.transform("retrieved_precedents", lambda p: p["brand_reply_text"]))
    listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(record)).alias("retrieved_precedents"))
    agreed = rt.agreement(found, empty_score=config.empty_score).select("query_id", "agreement")
    routed = (
        classified.join(listed.join(agreed, "query_id").withColumnRenamed("query_id", id_col), id_col, "left")
        .withColumn("agreement", F.coalesce("agreement", F.lit(config.empty_score)))
        .withColumn("retrieved_precedents", F.coalesce("retrieved_precedents", F.array()))
    )
    if config.draft is None:
        drafted = ms.attach_template(routed, config.templates, config.default_reply)
    else:
        drafted = config.draft(routed)
    verified = route.containment(drafted.withColumn("evidence", evidence))
    decided = route.decide(verified, config.policy_intents, config.confidence_min, config.agreement_min)
    used = [x for name in config.usage for x in (F.lit(name), F.col(name).cast("double"))]
    decided = decided.withColumn("metrics", F.create_map(*used).cast("map<string,double>"))

    columns = [
        id_col, "text", "predicted_intent", "intent_confidence", "retrieved_precedents", "agreement", "drafted_reply",
        "grounded", "unsupported_claims", "decision", "escalation_reason", "metrics",
    ]
    done = decided.select(*columns)
    refused = checked.where(F.col("rejected").isNotNull())
    types = {f.name: f.dataType for f in done.schema}
    failed = refused.select(
        id_col,
        "text",
        F.lit(config.default_intent).alias("predicted_intent"),
        F.lit(0.0).alias("intent_confidence"),
        F.array().cast(types["retrieved_precedents"]).alias("retrieved_precedents"),
        F.lit(0.0).alias("agreement"),
        F.lit(presets.ERROR_REPLY).alias("drafted_reply"),
        F.lit(True).alias("grounded"),
        F.array().cast("array<string>").alias("unsupported_claims"),
        F.lit("escalate").alias("decision"),
        F.concat(F.lit("error fallback: "), F.col("rejected")).alias("escalation_reason"),
        F.create_map().cast("map<string,double>").alias("metrics"),
    )
    return done.unionByName(failed)
