"""Results and gold labels to the evaluation tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom import presets
from threadloom.operators import evaluate, gold, route, sampling
from threadloom.operators.route import baseline_simple, baseline_trivial
from threadloom.session import write_stage


@dataclass(frozen=True)
class Evaluation:
    by_label: DataFrame
    summary: DataFrame
    escalation: DataFrame
    systems: DataFrame
    sweep: DataFrame
    agreement: DataFrame
    disagreements: DataFrame
    failures: DataFrame
    failure_examples: DataFrame
    unmatched: DataFrame


def evaluate_run(
    results: DataFrame,
    labels: DataFrame,
    judged: DataFrame,
    key: str = "thread_id",
    policy_intents: Sequence[str] = presets.POLICY_INTENTS,
    calibration_per_intent: int = 5,
    seed: int = 42,
) -> Evaluation:
    """All tables of an evaluation run, matched by id.

    ``results`` are triage records, ``labels`` has gold_intent and gold_decision, ``judged`` the
    judge's axis scores and has_invented_specifics. Rows without their counterpart enter no metric; ``unmatched`` counts them.
    """
    ids = results.select(key, F.lit(1).alias("r"), F.lit(0).alias("g")).unionByName(labels.select(key, F.lit(0).alias("r"), F.lit(1).alias("g")))
    sides = ids.groupBy(key).agg(F.max("r").alias("r"), F.max("g").alias("g"))
    unmatched, _ = write_stage(
        sides.agg(
            F.coalesce(F.sum("r"), F.lit(0)).alias("results"),
            F.coalesce(F.sum("g"), F.lit(0)).alias("labels"),
            F.count_if(F.col("g") == 0).alias("results_without_label"),
            F.count_if(F.col("r") == 0).alias("labels_without_result"),
        ),
        "unmatched",
    )
    axes = presets.RUBRIC_AXES
    scores = gold.rubric_composite(judged).select(
        key, *[F.col(a).alias(f"judge_{a}") for a in axes], "has_invented_specifics"
    )
    cases = (
        results.join(labels.select(key, "gold_intent", "gold_decision"), key)
        .join(scores, key, "left")
        .withColumns({"top_precedent_reply": F.get("retrieved_precedents", F.lit(0))["brand_reply_text"],
                      "top_action": F.get("retrieved_precedents", F.lit(0))["action_taken"]})
    )
    cases, _ = write_stage(cases, "evaluated")
    tagged, _ = write_stage(evaluate.tag_failures(cases), "tagged-failures")
    bare = cases.select(key, "text", "gold_intent", "gold_decision")
    systems = {
        "trivial": baseline_trivial(bare),
        "simple": baseline_simple(bare, policy_intents=policy_intents),
        "full": cases,
    }
    rated = gold.rule_rubric(sampling.sample_per_group(cases, "gold_intent", calibration_per_intent, key, seed))
    rated, _ = write_stage(rated, "rated")
    return Evaluation(
        by_label=evaluate.classification_by_label(cases),
        summary=evaluate.classification_summary(cases),
        escalation=evaluate.escalation_metrics(cases),
        systems=evaluate.compare_systems(systems),
        sweep=evaluate.threshold_sweep(cases, route.other_grounds(policy_intents)),
        agreement=evaluate.rater_agreement(evaluate.unpivot_ratings(rated)),
        disagreements=evaluate.itemise_disagreements(rated),
        failures=evaluate.failure_modes(tagged, key),
        failure_examples=evaluate.failure_examples(tagged, key),
        unmatched=unmatched,
    )
