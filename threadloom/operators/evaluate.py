"""Evaluation of classifiers, of routing decisions and of raters.

Every metric starts from a small table of cell counts: the rows are counted once per combination
of labels, on the map side, and all arithmetic happens on the cells. ``by`` computes a metric for
several systems or axes at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom import presets
from threadloom.functions import text as tx
from threadloom.functions.values import half_even, percent, ratio
from threadloom.operators.messages import first_per_group
from threadloom.session import literal_table, write_stage

ESCALATE, AUTO = "escalate", "auto_handle"


def cells(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per combination of the columns, as ``n``."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def _f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def _label_scores(counted: DataFrame, by: Sequence[str], gold: str, pred: str) -> DataFrame:
    g, p, n, none = F.col(gold), F.col(pred), F.col("n"), F.lit(0).cast("bigint")
    part = lambda label, tp, fp, fn: F.struct(
        label.alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")
    )
    parts = F.when(g == p, F.array(part(g, n, none, none))).otherwise(
        F.array(part(g, none, none, n), part(p, none, n, none))
    )
    summed = (
        counted.select(*by, F.explode(parts).alias("c"))
        .groupBy(*by, F.col("c.label").alias("label"))
        .agg(F.sum("c.tp").alias("tp"), F.sum("c.fp").alias("fp"), F.sum("c.fn").alias("fn"))
    )
    scored = summed.withColumns(
        {"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))}
    )
    return scored.withColumns(
        {"f1": _f1(F.col("precision"), F.col("recall")), "support": F.col("tp") + F.col("fn")}
    )


def classification_by_label(
    df: DataFrame, gold: str = "gold_intent", pred: str = "predicted_intent", by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1 and support of every label that occurs as gold or as predicted."""
    scored = _label_scores(cells(df, *by, gold, pred), by, gold, pred)
    return scored.select(
        *by, "label", *[half_even(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


def classification_summary(
    df: DataFrame, gold: str = "gold_intent", pred: str = "predicted_intent", by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, macro F1 (mean of unrounded F1s) and support-weighted F1."""
    return _label_summary(_label_scores(cells(df, *by, gold, pred), by, gold, pred), by)


def _label_summary(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    return scored.groupBy(*by).agg(
        half_even(F.sum("tp") / F.sum("support"), 4).alias("accuracy"),
        half_even(F.avg("f1"), 4).alias("macro_f1"),
        half_even(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"),
        F.sum("support").alias("samples"),
    )


def _escalation(counted: DataFrame, by: Sequence[str], gold: str, pred: str, cost_ratio: float) -> DataFrame:
    pair = lambda g, p: F.coalesce(
        F.sum(F.when((F.col(gold) == g) & (F.col(pred) == p), F.col("n"))), F.lit(0)
    )
    c = counted.groupBy(*by).agg(
        F.sum("n").alias("samples"),
        pair(ESCALATE, ESCALATE).alias("tp"),
        pair(AUTO, ESCALATE).alias("fp"),
        pair(ESCALATE, AUTO).alias("fn"),
        pair(AUTO, AUTO).alias("tn"),
        F.coalesce(F.sum(F.when(F.col(pred) == ESCALATE, F.col("n"))), F.lit(0)).alias("escalated"),
        F.coalesce(F.sum(F.when(F.col(pred) == AUTO, F.col("n"))), F.lit(0)).alias("auto_handled"),
    )
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "samples"))
    penalty = half_even(fn * F.lit(float(cost_ratio)) + fp, 2)
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return c.select(
        *by,
        "samples",
        "tp",
        "fp",
        "fn",
        "tn",
        half_even(ratio(tp + tn, n), 4).alias("accuracy"),
        half_even(precision, 4).alias("precision"),
        half_even(recall, 4).alias("recall"),
        half_even(_f1(precision, recall), 4).alias("f1"),
        half_even(ratio(fn, tp + fn), 4).alias("false_auto_handle_rate"),
        half_even(ratio(fp, tn + fp), 4).alias("false_escalate_rate"),
        penalty.alias("penalty"),
        half_even(ratio(penalty, n), 4).alias("normalized_cost"),
        "escalated",
        "auto_handled",
    )


def escalation_metrics(
    df: DataFrame,
    gold: str = "gold_decision",
    pred: str = "decision",
    cost_ratio: float = presets.COST_RATIO,
    by: Sequence[str] = (),
) -> DataFrame:
    """Confusion counts and rates with "escalate" as the positive class; a missed escalation costs more."""
    return _escalation(cells(df, *by, gold, pred), by, gold, pred, cost_ratio).drop("escalated", "auto_handled")


def threshold_sweep(
    df: DataFrame,
    escalates_anyway: Column,
    taus: Sequence[float] = presets.SWEEP,
    gold: str = "gold_decision",
    confidence: str = "intent_confidence",
    cost_ratio: float = presets.COST_RATIO,
) -> DataFrame:
    """Escalation metrics for each confidence threshold.

    Rows are counted once, by gold decision, other grounds for escalation, and how many thresholds
    the confidence reaches. Only those few cells are repeated per threshold.
    """
    taus = sorted(taus)
    reached = F.lit(0)
    for tau in taus:
        reached = reached + F.when(F.col(confidence) < tau, 0).otherwise(1)
    counted = cells(
        df.select(F.col(gold).alias("gold"), escalates_anyway.alias("anyway"), reached.alias("reached")),
        "gold", "anyway", "reached",
    )
    # With thresholds in rising order the i-th is reached by cells with reached > i.
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("tau")) for i, t in enumerate(taus)])
    decided = counted.withColumn("t", F.explode(grid)).select(
        F.col("t.tau").alias("tau"),
        "gold",
        F.when(F.col("anyway") | (F.col("reached") <= F.col("t.i")), ESCALATE).otherwise(AUTO).alias("pred"),
        "n",
    )
    return _escalation(decided, ["tau"], "gold", "pred", cost_ratio).select(
        "tau", "precision", "recall", "false_auto_handle_rate", "false_escalate_rate", "normalized_cost",
        "escalated", "auto_handled",
    )


def cohens_kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa of two raters: 0 for no rows, 1 where chance agreement is complete."""
    return _kappa(write_stage(cells(df, *by, a, b), "rating-cells")[0], a, b, by)


def _kappa(counted: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    side = lambda col, name: counted.groupBy(*by, F.col(col).alias("value")).agg(F.sum("n").alias(name))
    both = side(a, "n1").join(side(b, "n2"), [*by, "value"])
    chance = both.groupBy(*by).agg(F.sum(F.col("n1") * F.col("n2")).alias("chance"))
    seen = counted.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col(a) == F.col(b), F.col("n"))), F.lit(0)).alias("same"),
    )
    joined = seen.join(chance, list(by), "left") if by else seen.withColumn("chance", chance.scalar())
    po = F.col("same") / F.col("rows")
    pe = F.coalesce("chance", F.lit(0)) / (F.col("rows").cast("double") * F.col("rows"))
    kappa = F.when(F.col("rows") == 0, F.lit(0.0)).when(pe >= 1, F.lit(1.0)).otherwise(half_even((po - pe) / (1 - pe), 4))
    return joined.select(*by, "rows", kappa.alias("kappa"))


def unpivot_ratings(
    df: DataFrame, axes: Sequence[str] = presets.RUBRIC_AXES, first: str = "human_", second: str = "judge_", keep: Sequence[str] = ()
) -> DataFrame:
    """Wide ratings (one column per rater and axis) to rows (axis, human, judge)."""
    pairs = [F.struct(F.lit(x).alias("axis"), F.col(first + x).alias("human"), F.col(second + x).alias("judge")) for x in axes]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("r")).select(*keep, "r.axis", "r.human", "r.judge")


def rater_agreement(ratings: DataFrame) -> DataFrame:
    """Per axis: exact and adjacent (within 1) agreement, kappa, and both means."""
    counted, _ = write_stage(cells(ratings, "axis", "human", "judge"), "rating-cells")
    n, h, j = F.col("n"), F.col("human"), F.col("judge")
    rates = counted.groupBy("axis").agg(
        F.sum("n").alias("rows"),
        half_even(F.sum(F.when(h == j, n).otherwise(0)) * 100.0 / F.sum("n"), 2).alias("exact_pct"),
        half_even(F.sum(F.when(F.abs(h - j) <= 1, n).otherwise(0)) * 100.0 / F.sum("n"), 2).alias("adjacent_pct"),
        half_even(F.sum(h * n) / F.sum("n"), 2).alias("mean_human"),
        half_even(F.sum(j * n) / F.sum("n"), 2).alias("mean_judge"),
    )
    return rates.join(_kappa(counted, "human", "judge", ["axis"]).drop("rows"), "axis")


def itemise_disagreements(
    df: DataFrame, axes: Sequence[str] = presets.RUBRIC_AXES, first: str = "human_", second: str = "judge_"
) -> DataFrame:
    """Rows on which the raters differ, with one (axis, human, judge) entry per differing axis."""
    pairs = F.array(
        *[F.struct(F.lit(x).alias("axis"), F.col(first + x).alias("human"), F.col(second + x).alias("judge")) for x in axes]
    )
    return df.withColumn("differences", F.filter(pairs, lambda d: ~d["human"].eqNullSafe(d["judge"]))).where(
        F.size("differences") > 0
    )


COMPARED = (
    ("intent_accuracy", "intent_accuracy"),
    ("intent_macro_f1", "macro_f1"),
    ("escalation_precision", "precision"),
    ("escalation_recall", "recall"),
    ("escalation_f1", "f1"),
    ("false_auto_handle_rate", "false_auto_handle_rate"),
    ("false_escalate_rate", "false_escalate_rate"),
    ("risk_cost", "normalized_cost"),
)


def compare_systems(systems: Mapping[str, DataFrame], cost_ratio: float = presets.COST_RATIO) -> DataFrame:
    """Eight metrics (rows) by system (columns).

    Each table has gold_intent, predicted_intent, gold_decision and decision, joined by id.
    """
    columns = ["gold_intent", "predicted_intent", "gold_decision", "decision"]
    union = None
    for name, df in systems.items():
        part = df.select(F.lit(name).alias("system"), *columns)
        union = part if union is None else union.unionByName(part)
    # Both kinds of metrics share one pass over the rows: they read the few cells it writes.
    counted, _ = write_stage(cells(union, "system", *columns), "system-cells")
    intents = _label_summary(_label_scores(counted, ["system"], "gold_intent", "predicted_intent"), ["system"])
    intents = intents.select("system", F.col("accuracy").alias("intent_accuracy"), "macro_f1")
    scored = _escalation(counted, ["system"], "gold_decision", "decision", cost_ratio).join(intents, "system")
    pairs = F.array(
        *[F.struct(F.lit(i).alias("place"), F.lit(m).alias("metric"), F.col(c).alias("value")) for i, (m, c) in enumerate(COMPARED)]
    )
    long = scored.select("system", F.explode(pairs).alias("v")).select("system", "v.*")
    one = lambda s: F.max(F.when(F.col("system") == s, F.col("value"))).alias(s)
    return long.groupBy("place", "metric").agg(*[one(s) for s in systems]).orderBy("place").drop("place")


FAILURE_MODES = (
    "ungrounded_specific", "wrong_specific", "plausible_specific", "language_conflict", "anger",
    "out_of_domain", "false_auto_handle",
)


def tag_failures(
    df: DataFrame,
    versions: Sequence[str] = presets.FAILURE_VERSIONS,
    links: Sequence[str] = presets.FAILURE_LINKS,
    anger: Sequence[str] = presets.FAILURE_ANGER,
    outside: Sequence[str] = presets.FAILURE_OUTSIDE,
    language_intent: str = presets.FAILURE_LANGUAGE_INTENT,
) -> DataFrame:
    """Add ``modes``, the failure modes of each row; a wrong and a plausible specific exclude each other."""
    draft, evidence, message = F.col("drafted_reply"), F.coalesce("top_precedent_reply", F.lit("")), F.col("_message")
    wrong, plausible = F.col("_wrong"), F.col("_plausible")
    linked = tx.has_any(draft, links) & ~tx.has_any(evidence, links)
    invented = F.coalesce("has_invented_specifics", F.lit(False))
    prepared = df.withColumns(
        {"_message": F.lower("text"), "_wrong": tx.has_any(draft, versions) & ~tx.has_any(evidence, versions)}
    ).withColumn("_plausible", ~wrong & (linked | invented))
    conditions = {
        "ungrounded_specific": wrong | plausible,
        "wrong_specific": wrong,
        "plausible_specific": plausible,
        "language_conflict": (F.col("gold_intent") == language_intent) & (F.col("predicted_intent") != language_intent),
        "anger": tx.has_any(message, anger) & (F.col("agreement") < 0.55),
        "out_of_domain": (F.col("intent_confidence") < 0.60) | tx.has_any(message, outside),
        "false_auto_handle": (F.col("gold_decision") == ESCALATE) & (F.col("decision") == AUTO),
    }
    found = F.array(*[F.when(conditions[m], F.lit(m)) for m in FAILURE_MODES])
    return prepared.withColumn("modes", F.array_compact(found)).drop("_message", "_wrong", "_plausible")


def failure_modes(tagged: DataFrame, id_col: str = "thread_id", examples: int = 3) -> DataFrame:
    """Per mode: rows, share of all rows, and the first few ids. Modes without rows are listed too."""
    # Ids and modes only, written once, as counts and examples both read them.
    found, seen = write_stage(tagged.select(F.col(id_col).alias("id"), "modes"), "failure-modes")
    hits = found.select("id", F.explode("modes").alias("mode"))
    counted = cells(hits, "mode")
    first = first_per_group(hits, ["mode"], ["id"], examples).groupBy("mode").agg(
        F.array_sort(F.collect_list("id")).alias("examples")
    )
    total = F.lit(seen["rows"])
    modes = literal_table(tagged.sparkSession, [(m,) for m in FAILURE_MODES], "mode string")
    listed = modes.join(counted, "mode", "left").join(first, "mode", "left")
    count = F.coalesce("n", F.lit(0))
    return listed.select("mode", count.alias("count"), percent(count, total).alias("rate_pct"), "examples")


def failure_examples(tagged: DataFrame, id_col: str = "thread_id", examples: int = 3) -> DataFrame:
    """The first rows of each failure mode, with what a reader needs to judge them.

    Columns: mode, rank, id, message, draft, sub_mode, detail, gold and predicted intent and decision, agreement, confidence.
    The detail of an invented specific is the judge's, if ``tagged`` has ``invented_specifics_detail``.
    """
    invented = F.coalesce("has_invented_specifics", F.lit(False))
    judged = F.col("invented_specifics_detail") if "invented_specifics_detail" in tagged.columns else F.lit(None).cast("string")
    wrong = F.array_contains("modes", "wrong_specific")
    linked = F.array_contains("modes", "plausible_specific") & ~F.coalesce(F.col("by_judge"), F.lit(False))
    fixed = presets.FAILURE_DETAILS
    grounding = (
        F.when(wrong, F.lit(fixed["wrong_specific"]))
        .when(linked, F.lit(fixed["plausible_specific"]))
        .otherwise(F.coalesce("judged", F.lit(fixed["invented_specific"])))
    )
    explained = F.coalesce(
        *[F.when(F.col("mode") == m, F.lit(fixed[m])) for m in ("language_conflict", "anger", "out_of_domain", "false_auto_handle")], grounding
    )
    sub_mode = F.when(
        F.col("mode").isin("ungrounded_specific", "wrong_specific", "plausible_specific"),
        F.when(wrong, presets.FAILURE_SUB_MODES["wrong_specific"]).otherwise(presets.FAILURE_SUB_MODES["plausible_specific"]),
    )
    # A specific that only the judge reports, not the list of links.
    by_judge = invented & ~(
        tx.has_any(F.col("drafted_reply"), presets.FAILURE_LINKS)
        & ~tx.has_any(F.coalesce("top_precedent_reply", F.lit("")), presets.FAILURE_LINKS)
    )
    facts = ["gold_intent", "predicted_intent", "gold_decision", "decision", "agreement", "intent_confidence"]
    hits = tagged.select(
        F.col(id_col).alias("id"), F.col("text").alias("message"), F.col("drafted_reply").alias("draft"), *facts, "modes",
        judged.alias("judged"), by_judge.alias("by_judge"), F.explode("modes").alias("mode"),
    )
    first = first_per_group(hits, ["mode"], ["id"], examples)
    return first.select("mode", "rank", "id", "message", "draft", sub_mode.alias("sub_mode"), explained.alias("detail"), *facts)
