"""Routing: grounding check, decision rules, the two baseline systems."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import presets
from threadloom.functions.values import half_even
from threadloom.operators.messages import attach_template, classify_keywords

NO_CLAIMS = "array<string>"


def claims(col: Column, patterns: Mapping[str, str] = presets.CLAIM_PATTERNS) -> Column:
    """Checkable details of a text (versions, links, article ids, amounts), each once."""
    found = [F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(p), F.lit(0)) for p in patterns.values()]
    return F.array_distinct(F.concat(*found))


def containment(
    df: DataFrame, draft: str = "drafted_reply", evidence: str = "evidence", patterns: Mapping[str, str] = presets.CLAIM_PATTERNS
) -> DataFrame:
    """Add ``unsupported_claims`` (details of the draft that the evidence lacks) and ``grounded``."""
    known = F.coalesce(F.col(evidence), F.lit(""))
    unsupported = F.filter(claims(F.col(draft), patterns), lambda c: ~F.contains(known, c))
    checked = df.withColumn("unsupported_claims", unsupported)
    return checked.withColumn("grounded", F.size("unsupported_claims") == 0)


def is_grounded(grounded: Column, unsupported: Column) -> Column:
    """A verdict counts only without open claims; a missing verdict or list counts as fine."""
    return F.coalesce(grounded, F.lit(True)) & (F.coalesce(F.size(unsupported), F.lit(0)) <= 0)


def other_grounds(policy_intents: Sequence[str] = presets.POLICY_INTENTS, agreement_min: float = presets.AGREEMENT_MIN) -> Column:
    """Escalation for any reason but the classifier's confidence."""
    fine = is_grounded(F.col("grounded"), F.col("unsupported_claims"))
    return F.col("predicted_intent").isin(*policy_intents) | (F.col("agreement") < agreement_min) | ~fine


def _shown(col: Column) -> Column:
    """A score for display; exact halves (multiples of 1/8) go to the even digit before formatting."""
    return F.when(col * 8 == F.floor(col * 8), half_even(col, 2)).otherwise(col)


def decide(
    df: DataFrame,
    policy_intents: Sequence[str] = presets.POLICY_INTENTS,
    confidence_min: float = presets.CONFIDENCE_MIN,
    agreement_min: float = presets.AGREEMENT_MIN,
) -> DataFrame:
    """Add ``decision`` and ``escalation_reason``; the first rule that applies decides.

    Restricted intent, low confidence (if known), disagreeing precedents, unsupported claims; else
    the message is handled automatically. Values on a threshold pass.
    """
    intent, conf, agree = F.col("predicted_intent"), F.col("intent_confidence"), F.col("agreement")
    fine = is_grounded(F.col("grounded"), F.col("unsupported_claims"))
    reason = (
        F.when(intent.isin(*policy_intents), F.concat(F.lit(presets.REASON_POLICY), intent))
        .when(
            conf < confidence_min,
            F.format_string(presets.REASON_CONFIDENCE.format(confidence_min), _shown(conf)),
        )
        .when(
            agree < agreement_min,
            F.format_string(
                presets.REASON_AGREEMENT,
                _shown(agree),
            ),
        )
        .when(~fine, F.lit(presets.REASON_CLAIM))
    )
    passed = F.format_string(presets.REASON_PASSED, _shown(agree))
    return df.withColumn("_reason", reason).select(
        *df.columns,
        F.when(F.col("_reason").isNotNull(), "escalate").otherwise("auto_handle").alias("decision"),
        F.coalesce("_reason", passed).alias("escalation_reason"),
    )


def _record(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(
        {
            **columns,
            "grounded": F.lit(True),
            "unsupported_claims": F.array().cast(NO_CLAIMS),
        }
    )


def baseline_trivial(df: DataFrame, intent: str = presets.DEFAULT_INTENT, reply: str = presets.DEFAULT_TEMPLATE) -> DataFrame:
    """Escalate everything with one reply and the largest intent."""
    return _record(
        df,
        predicted_intent=F.lit(intent),
        intent_confidence=F.lit(0.0),
        agreement=F.lit(0.0),
        drafted_reply=F.lit(reply),
        decision=F.lit("escalate"),
        escalation_reason=F.lit(presets.REASON_TRIVIAL),
    )


def baseline_simple(
    df: DataFrame,
    rules: Sequence[tuple[str, str]] = presets.KEYWORD_RULES,
    default: str = presets.DEFAULT_INTENT,
    templates: Mapping[str, str] = presets.REPLY_TEMPLATES,
    policy_intents: Sequence[str] = presets.POLICY_INTENTS,
    text: str = "text",
) -> DataFrame:
    """Keyword intent, template reply, policy escalation."""
    drafted = attach_template(classify_keywords(df, rules, default, text), templates)
    restricted = F.col("predicted_intent").isin(*policy_intents)
    return _record(
        drafted,
        agreement=F.lit(0.50),
        decision=F.when(restricted, "escalate").otherwise("auto_handle"),
        escalation_reason=F.when(
            restricted, F.concat(F.lit(presets.REASON_POLICY), F.col("predicted_intent"))
        ).otherwise(F.lit(presets.REASON_SIMPLE)),
    )
