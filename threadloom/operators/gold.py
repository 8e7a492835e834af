"""Gold labels and rubric scores by rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.values import half_even
from threadloom import presets
from threadloom.functions import text as tx


@dataclass(frozen=True)
class GoldRules:
    """Word lists and texts of the labelling rules; the defaults are the presets."""

    language_words: tuple[str, ...] = presets.GOLD_SPANISH + presets.GOLD_PORTUGUESE + presets.GOLD_FRENCH
    account_words: tuple[str, ...] = presets.GOLD_PHISHING + presets.GOLD_ACCOUNT
    money_pattern: str = presets.GOLD_MONEY
    not_money_words: tuple[str, ...] = presets.GOLD_BATTERY_CHARGE
    symptoms: tuple[tuple[str, tuple[str, ...]], ...] = presets.GOLD_SYMPTOMS
    damage_words: tuple[str, ...] = presets.GOLD_DAMAGE
    dead_words: tuple[str, ...] = presets.GOLD_DEAD
    language_intent: str = "international_multilingual_inquiries"
    account_intent: str = "account_access_apple_id"
    billing_intent: str = "orders_purchases_applecare"

    @property
    def policy(self) -> tuple[str, str, str]:
        return (self.billing_intent, self.account_intent, self.language_intent)


def _by_intent(col: Column, texts: Mapping[str, str], default: str) -> Column:
    return F.coalesce(*[F.when(col == name, F.lit(text)) for name, text in texts.items()], F.lit(default))


def rule_gold(df: DataFrame, rules: GoldRules = GoldRules(), text: str = "text", intent: str = "predicted_intent") -> DataFrame:
    """Add gold_intent, gold_decision, gold_escalation_reason, good_reply_criteria, ambiguity, symptoms.

    ``ambiguity`` names the rule that overrode the intent, NULL if none did.
    """
    # A column of its own, so that the text is lowered once and not once per word list.
    df = df.withColumn("_message", F.lower(tx.strip(F.coalesce(F.col(text), F.lit("")))))
    message, given = F.col("_message"), tx.strip(F.col(intent))
    foreign = tx.has_any(message, rules.language_words)
    account = tx.has_any(message, rules.account_words)
    billing = message.rlike(tx.unicode_pattern(rules.money_pattern)) & ~tx.has_any(message, rules.not_money_words)
    ambiguity = (
        F.when(foreign & (given != rules.language_intent), F.lit("language_vs_technical_topic"))
        .when(account & (given != rules.account_intent), F.lit("security_account_overlap"))
        .when(billing & (given != rules.billing_intent), F.lit("billing_overlap"))
    )
    symptoms = F.array_compact(
        F.array(*[F.when(tx.has_any(message, words), F.lit(name)) for name, words in rules.symptoms])
    )
    labelled = df.withColumns({"ambiguity": ambiguity, "symptoms": symptoms}).withColumn(
        "gold_intent",
        F.when(F.col("ambiguity") == "language_vs_technical_topic", F.lit(rules.language_intent))
        .when(F.col("ambiguity") == "security_account_overlap", F.lit(rules.account_intent))
        .when(F.col("ambiguity") == "billing_overlap", F.lit(rules.billing_intent))
        .otherwise(given),
    )
    gold = F.col("gold_intent")
    ground = (
        F.when(gold.isin(*rules.policy), "policy")
        .when(tx.has_any(message, rules.damage_words), "damage")
        .when(tx.has_any(message, rules.dead_words), "dead")
        .otherwise("standard")
    )
    policy_texts = {
        rules.language_intent: presets.GOLD_CRITERIA_POLICY["international_multilingual_inquiries"],
        rules.account_intent: presets.GOLD_CRITERIA_POLICY["account_access_apple_id"],
        rules.billing_intent: presets.GOLD_CRITERIA_POLICY["orders_purchases_applecare"],
    }
    return (
        labelled.withColumn("_ground", ground)
        .withColumns(
            {
                "gold_decision": F.when(F.col("_ground") == "standard", "auto_handle").otherwise("escalate"),
                "gold_escalation_reason": F.when(
                    F.col("_ground") == "policy", F.format_string(presets.GOLD_REASON_POLICY, gold)
                )
                .when(F.col("_ground") == "damage", F.lit(presets.GOLD_REASON_DAMAGE))
                .when(F.col("_ground") == "dead", F.lit(presets.GOLD_REASON_DEAD))
                .otherwise(F.format_string(presets.GOLD_REASON_AUTO, gold)),
                "good_reply_criteria": F.when(F.col("_ground") == "policy", _by_intent(gold, policy_texts, ""))
                .when(F.col("_ground") == "damage", F.lit(presets.GOLD_CRITERIA_DAMAGE))
                .when(F.col("_ground") == "dead", F.lit(presets.GOLD_CRITERIA_DEAD))
                .otherwise(_by_intent(gold, presets.GOLD_CRITERIA_AUTO, presets.GOLD_CRITERIA_OTHER)),
            }
        )
        .drop("_ground", "_message")
    )


def ambiguity_log(
    labelled: DataFrame, id_col: str, until: int = presets.GOLD_COMPOUND_UNTIL, text: str = "text", intent: str = "predicted_intent"
) -> DataFrame:
    """Log entries of ``rule_gold`` rows: every override, and compound complaints while the log is short.

    An entry has the id, its type, the text, the first and the gold intent, the symptoms and an explanation.
    Rows count in id order, and within a row the override comes first. A compound entry is added
    only while fewer than ``until`` entries exist. Until then every candidate is added, so the
    compound entries are those among the first ``until`` candidates.
    """
    compound = "compound_multi_symptom_overlap"
    entries = F.array_compact(
        F.array(
            F.when(F.col("ambiguity").isNotNull(), F.struct(F.lit(0).alias("place"), F.col("ambiguity").alias("type"))),
            F.when(
                F.size("symptoms") >= presets.GOLD_SYMPTOM_MIN,
                F.struct(F.lit(1).alias("place"), F.lit(compound).alias("type")),
            ),
        )
    )
    found = labelled.select(
        F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(intent).alias("first_intent"), "gold_intent",
        F.array_join("symptoms", ", ").alias("symptoms"), F.explode(entries).alias("e"),
    )
    told = presets.AMBIGUITY_EXPLANATIONS
    explanation = F.coalesce(
        *[F.when(F.col("e.type") == t, F.format_string(told[t], "first_intent")) for t in told if t != compound],
        F.format_string(told[compound], "symptoms", "gold_intent"),
    )
    candidates = found.select("id", "e.place", "e.type", "text", "first_intent", "gold_intent", "symptoms", explanation.alias("explanation"))
    early = candidates.orderBy("id", "place").limit(until).where(F.col("place") == 1)
    return candidates.where(F.col("place") == 0).unionByName(early).drop("place")


def normalise_gold(
    df: DataFrame,
    allowed: Sequence[str],
    policy_intents: Sequence[str] = presets.POLICY_INTENTS,
    default: str = presets.DEFAULT_INTENT,
    reasons: Mapping[str, str] = presets.LABEL_REASONS,
    text: str = "text",
) -> DataFrame:
    """Repair given gold labels: intent, decision, reason and guidance become complete and consistent."""
    given, predicted = tx.strip(F.col("gold_intent")), F.col("predicted_intent")
    intent = F.when(given.isin(*allowed), given).when(predicted.isin(*allowed), predicted).otherwise(F.lit(default))
    said = F.lower(tx.strip(F.coalesce("gold_decision", F.lit(""))))
    by_words = F.when(tx.has_any(F.lower(F.col(text)), presets.LABEL_ESCALATE_WORDS), "escalate").otherwise("auto_handle")
    fixed = df.withColumn("gold_intent", intent).withColumn(
        "gold_decision",
        F.when(F.col("gold_intent").isin(*policy_intents), "escalate")
        .when(said.isin("auto_handle", "escalate"), said)
        .otherwise(by_words),
    )
    reason = tx.strip(F.coalesce("gold_escalation_reason", F.lit("")))
    empty = (reason == "") | (reason == presets.LABEL_AUTO_REASON)
    guidance = tx.strip(F.coalesce("gold_reply_guidance", F.lit("")))
    return fixed.withColumns(
        {
            "gold_escalation_reason": F.when(F.col("gold_decision") == "auto_handle", F.lit(presets.LABEL_AUTO_REASON))
            .when(empty, _by_intent(F.col("gold_intent"), reasons, presets.LABEL_OTHER_REASON))
            .otherwise(reason),
            "gold_reply_guidance": F.when(guidance == "", F.lit(presets.LABEL_GUIDANCE)).otherwise(guidance),
        }
    )


def rubric_composite(
    df: DataFrame,
    axes: Sequence[str] = presets.RUBRIC_AXES,
    defaults: Sequence[int] = presets.RUBRIC_DEFAULTS,
    invented: str = "has_invented_specifics",
) -> DataFrame:
    """Fill missing axis scores, add their mean, and flag invented specifics if not flagged already."""
    filled = df.withColumns({a: F.coalesce(F.col(a).cast("int"), F.lit(d)) for a, d in zip(axes, defaults)})
    total = sum((F.col(a) for a in axes[1:]), F.col(axes[0]))
    return filled.withColumns(
        {
            "composite_score": half_even(total / F.lit(float(len(axes))), 2),
            invented: F.coalesce(F.col(invented), F.col(axes[1]) <= 2),
        }
    )


def rule_rubric(
    df: DataFrame,
    specifics: Sequence[str] = presets.RATER_SPECIFICS,
    courtesy: Sequence[str] = presets.RATER_COURTESY,
    prefix: str = "human_",
) -> DataFrame:
    """Score a drafted reply on the four axes by fixed rules against its best precedent."""
    draft, lower = F.col("drafted_reply"), F.lower("drafted_reply")
    action = F.lower(F.coalesce("top_action", F.lit("")))
    evidence = F.coalesce("top_precedent_reply", F.lit(""))
    same_channel = F.contains(action, F.lit("dm")) & F.contains(lower, F.lit("dm"))
    same_link = F.contains(action, F.lit("link")) & (F.contains(draft, F.lit("http")) | F.contains(lower, F.lit("link")))
    invented = tx.has_any(draft, specifics) & ~tx.has_any(evidence, specifics)
    kind = (F.length(draft) <= 280) & tx.has_any(lower, courtesy)
    unsafe = (F.col("gold_decision") == "escalate") & (F.col("decision") == "auto_handle")
    scores = (
        F.when(same_channel | same_link, 5).otherwise(4),
        F.when(invented, 2).otherwise(5),
        F.when(kind, 5).otherwise(4),
        F.when(unsafe, 2).when(F.col("gold_decision") == F.col("decision"), 5).otherwise(4),
    )
    return df.withColumns({prefix + axis: score for axis, score in zip(presets.RUBRIC_AXES, scores)})
