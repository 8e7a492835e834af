"""Queries on metrics, routing, gold labels and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom import presets
from threadloom.catalog.base import query, table, texts
from threadloom.catalog.messages import SCORED_DOCS, scored_documents, sql_word
from threadloom.operators import evaluate as ev
from threadloom.operators import gold as gd
from threadloom.operators import reports, route
from threadloom.session import write_stage

# Routed messages with gold labels and drafts. The same text runs in Spark and in the oracle.
CASES_SELECT = """
SELECT doc_id, lang, text, n_chars, predicted_intent,
  CAST((doc_id*7919+13)%101 AS DOUBLE)/100 AS intent_confidence,
  CAST((doc_id*104729+7)%89 AS DOUBLE)/88 AS agreement,
  CASE WHEN (doc_id*17)%10 < 2 THEN concat('lang_', lang) WHEN (doc_id*17)%10 = 2 THEN 'french' ELSE predicted_intent END AS gold_intent,
  CASE WHEN (doc_id*13)%10 < 3 OR predicted_intent = 'german' THEN 'escalate' ELSE 'auto_handle' END AS gold_decision,
  CASE WHEN (doc_id*11)%10 < 4 THEN 'escalate' ELSE 'auto_handle' END AS decision,
  CASE doc_id%5 WHEN 0 THEN 'Update to 11.0.3 now, it will help. Send us a DM.'
    WHEN 1 THEN 'See HT204910 at https://support.apple.com/en-us/HT204910 for more'
    WHEN 2 THEN 'The repair costs $25.00 or 30.5.1 of those, sorry'
    WHEN 3 THEN 'We can look into this, use the link http://t.co/a and http://t.co/b'
    ELSE text END AS drafted_reply,
  CASE doc_id%7 WHEN 0 THEN 'Version 11.0.3 is out, see HT204910' WHEN 1 THEN 'Use http://t.co/a now, it is $25.00'
    WHEN 2 THEN NULL ELSE 'Send us a DM' END AS top_precedent_reply,
  CASE doc_id%3 WHEN 0 THEN 'Sent to DM' WHEN 1 THEN 'Gave a link' END AS top_action,
  CASE WHEN doc_id%9 < 2 THEN true WHEN doc_id%9 = 2 THEN false END AS has_invented_specifics
FROM {scored}
"""
CASES = f"{SCORED_DOCS}, cases AS ({CASES_SELECT.format(scored='scored')})"
POLICY = ("german", "french")


def cases(spark, sf_dir):
    return spark.sql(CASES_SELECT, scored=scored_documents(spark, sf_dir).drop("intent_confidence"))


# -- classification, escalation, sweep ------------------------------------------------------------

LABELS_SQL = """
labels_seen AS (SELECT gold_intent AS label FROM cases UNION SELECT predicted_intent FROM cases),
counts AS (SELECT label, (SELECT count(*) FROM cases WHERE gold_intent = label AND predicted_intent = label) AS tp,
  (SELECT count(*) FROM cases WHERE gold_intent <> label AND predicted_intent = label) AS fp,
  (SELECT count(*) FROM cases WHERE gold_intent = label AND predicted_intent <> label) AS fn FROM labels_seen),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM counts),
scores AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f, tp + fn AS support FROM pr)"""


@query(
    "classification_by_label",
    f"WITH {CASES}, {LABELS_SQL} SELECT label, round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(f, 4) AS f1, support FROM scores",
)
def classification_by_label(spark, sf_dir):
    return ev.classification_by_label(cases(spark, sf_dir))


@query(
    "classification_summary",
    f"""WITH {CASES}, {LABELS_SQL} SELECT round_even((SELECT count(*) FROM cases WHERE gold_intent = predicted_intent) / (SELECT count(*) FROM cases), 4) AS accuracy,
  round_even(avg(f), 4) AS macro_f1, round_even(sum(f * support) / sum(support), 4) AS weighted_f1, CAST(sum(support) AS BIGINT) AS samples FROM scores""",
)
def classification_summary(spark, sf_dir):
    return ev.classification_summary(cases(spark, sf_dir))


def escalation_sql(source: str, by: str = "", pred: str = "decision") -> str:
    group, pick = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"""SELECT {pick}samples, tp, fp, fn, tn, round_even((tp + tn) / samples, 4) AS accuracy, round_even(p, 4) AS precision, round_even(r, 4) AS recall,
  round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1,
  round_even(CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0.0 END, 4) AS false_auto_handle_rate,
  round_even(CASE WHEN tn + fp > 0 THEN fp / (tn + fp) ELSE 0.0 END, 4) AS false_escalate_rate,
  round_even(CAST(fn * 5 + fp AS DOUBLE), 2) AS penalty, round_even((fn * 5 + fp) / samples, 4) AS normalized_cost
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM (
  SELECT {pick}count(*) AS samples, count(*) FILTER (WHERE gold_decision = 'escalate' AND {pred} = 'escalate') AS tp,
    count(*) FILTER (WHERE gold_decision = 'auto_handle' AND {pred} = 'escalate') AS fp,
    count(*) FILTER (WHERE gold_decision = 'escalate' AND {pred} = 'auto_handle') AS fn,
    count(*) FILTER (WHERE gold_decision = 'auto_handle' AND {pred} = 'auto_handle') AS tn FROM {source} {group}))"""


@query("escalation", f"WITH {CASES} {escalation_sql('cases')}")
def escalation(spark, sf_dir):
    return ev.escalation_metrics(cases(spark, sf_dir))


CLAIMS_SQL = """list_distinct(regexp_extract_all({x}, '[0-9]+\\.[0-9]+(?:\\.[0-9]+)+') ||
  regexp_extract_all({x}, 'https?://[^\\s"''<>)\\]]+') || regexp_extract_all({x}, 'HT[0-9]{{6}}') || regexp_extract_all({x}, '[$€£][0-9]+(?:[.,][0-9]+)*'))"""
GROUNDED = f"""
checked AS (SELECT *, len(unsupported) = 0 AS grounded FROM (SELECT *,
  list_filter({CLAIMS_SQL.format(x='drafted_reply')}, lambda c: NOT contains(coalesce(top_precedent_reply, ''), c)) AS unsupported FROM cases))"""


def checked(spark, sf_dir):
    return route.containment(cases(spark, sf_dir), evidence="top_precedent_reply")


@query(
    "containment",
    f"WITH {CASES}, {GROUNDED} SELECT doc_id, grounded, array_to_string(list_sort(unsupported), ' ') AS unsupported_claims FROM checked",
)
def containment(spark, sf_dir):
    return checked(spark, sf_dir).select(
        "doc_id", "grounded", F.array_join(F.array_sort("unsupported_claims"), " ").alias("unsupported_claims")
    )


DECIDED = """
decided AS (SELECT * REPLACE (CASE WHEN reason IS NULL THEN 'auto_handle' ELSE 'escalate' END AS decision) FROM (SELECT *, CASE
  WHEN predicted_intent IN ('german', 'french') THEN 'intent policy: always escalate for ' || predicted_intent
  WHEN intent_confidence < 0.60 THEN printf('low classifier confidence (%.2f < 0.60): routing uncertain', intent_confidence)
  WHEN agreement < 0.50 THEN printf('low precedent agreement (%.2f): retrieved historical resolutions disagree on how this was handled', agreement)
  WHEN NOT grounded THEN 'draft contains a claim not supported by retrieved precedent' END AS reason FROM checked))"""


@query(
    "decide",
    f"""WITH {CASES}, {GROUNDED}, {DECIDED} SELECT doc_id, decision, coalesce(reason,
  printf('high precedent agreement (%.2f), grounded draft, non-restricted intent', agreement)) AS escalation_reason FROM decided""",
)
def decide(spark, sf_dir):
    routed = route.decide(checked(spark, sf_dir).drop("decision"), POLICY)
    return routed.select("doc_id", "decision", "escalation_reason")


TAUS = ", ".join(f"({t})" for t in presets.SWEEP)


@query(
    "threshold_sweep",
    f"""WITH {CASES}, {GROUNDED}, swept AS (SELECT CAST(tau AS DOUBLE) AS tau, gold_decision, CASE WHEN predicted_intent IN ('german', 'french')
  OR agreement < 0.50 OR NOT grounded OR intent_confidence < tau THEN 'escalate' ELSE 'auto_handle' END AS decision
  FROM checked CROSS JOIN (VALUES {TAUS}) t(tau))
SELECT tau, precision, recall, false_auto_handle_rate, false_escalate_rate, normalized_cost,
  tp + fp AS escalated, fn + tn AS auto_handled FROM ({escalation_sql('swept', 'tau')})""",
)
def threshold_sweep(spark, sf_dir):
    return ev.threshold_sweep(checked(spark, sf_dir), route.other_grounds(POLICY))


# -- raters ---------------------------------------------------------------------------------------

# Axis scores by two raters, from document size, quality and toxicity labels.
RATED_SELECT = """
SELECT d.doc_id, l.quality, l.toxic,
  CAST(1 + d.n_chars%5 AS INT) AS human_grounded_in_precedent, CAST(1 + (d.n_chars + (1 - l.quality))%5 AS INT) AS judge_grounded_in_precedent,
  CAST(5 - 3*l.toxic AS INT) AS human_factually_non_hallucinatory, CAST(CASE WHEN d.doc_id%6 = 0 THEN 1 + d.doc_id%5 ELSE 5 - 3*l.toxic END AS INT) AS judge_factually_non_hallucinatory,
  CAST(4 + l.quality AS INT) AS human_tone_appropriate, CAST(5 - d.doc_id%2 AS INT) AS judge_tone_appropriate,
  CAST(3 AS INT) AS human_resolves_or_correctly_defers, CAST(3 AS INT) AS judge_resolves_or_correctly_defers
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""
RATED = f"rated AS ({RATED_SELECT.format(documents='documents', labels='labels')})"


def rated(spark, sf_dir):
    return spark.sql(
        RATED_SELECT, documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels")
    )


def kappa_sql(source: str, a: str, b: str) -> str:
    return f"""(SELECT CASE WHEN n = 0 THEN 0.0 WHEN pe >= 1 THEN 1.0 ELSE round_even((po - pe) / (1 - pe), 4) END FROM (
  SELECT (SELECT count(*) FROM {source}) AS n, (SELECT count(*) FROM {source} WHERE {a} = {b}) / (SELECT count(*) FROM {source}) AS po,
  (SELECT coalesce(sum(x.c * CAST(y.c AS DOUBLE)), 0) FROM (SELECT {a} AS v, count(*) AS c FROM {source} GROUP BY 1) x
    JOIN (SELECT {b} AS v, count(*) AS c FROM {source} GROUP BY 1) y USING (v)) / (SELECT CAST(count(*) AS DOUBLE) * count(*) FROM {source}) AS pe))"""


@query(
    "kappa",
    f"WITH {CASES} SELECT (SELECT count(*) FROM cases) AS rows, {kappa_sql('cases', 'gold_intent', 'predicted_intent')} AS kappa",
)
def kappa(spark, sf_dir):
    return ev.cohens_kappa(cases(spark, sf_dir), "gold_intent", "predicted_intent")


def agreement_row(axis: str) -> str:
    h, j = f"human_{axis}", f"judge_{axis}"
    return f"""SELECT '{axis}' AS axis, count(*) AS rows, round_even(count(*) FILTER (WHERE {h} = {j}) * 100.0 / count(*), 2) AS exact_pct,
  round_even(count(*) FILTER (WHERE abs({h} - {j}) <= 1) * 100.0 / count(*), 2) AS adjacent_pct,
  round_even(avg({h}), 2) AS mean_human, round_even(avg({j}), 2) AS mean_judge, {kappa_sql('rated', h, j)} AS kappa FROM rated"""


@query("rater_agreement", f"WITH {RATED} " + " UNION ALL ".join(agreement_row(a) for a in presets.RUBRIC_AXES))
def rater_agreement(spark, sf_dir):
    return ev.rater_agreement(ev.unpivot_ratings(rated(spark, sf_dir)))


DIFFS = " || ".join(
    f"CASE WHEN human_{a} <> judge_{a} THEN '{a}:' || human_{a} || '/' || judge_{a} || ';' ELSE '' END" for a in presets.RUBRIC_AXES
)


@query("disagreements", f"WITH {RATED}, d AS (SELECT doc_id, {DIFFS} AS differences FROM rated) SELECT * FROM d WHERE differences <> ''")
def disagreements(spark, sf_dir):
    found = ev.itemise_disagreements(rated(spark, sf_dir))
    shown = F.transform(
        "differences",
        lambda d: F.concat(d["axis"], F.lit(":"), d["human"].cast("string"), F.lit("/"), d["judge"].cast("string"), F.lit(";")),
    )
    return found.select("doc_id", F.array_join(shown, "").alias("differences"))


# -- systems --------------------------------------------------------------------------------------

SIMPLE_RULES = (("german", r"\b(der|und|von)\b"), ("french", r"\b(la|des|que)\b"), ("verbs", r"\b(is|was|be)\b"))
SIMPLE_SQL = f"""CASE WHEN {sql_word('der|und|von')} THEN 'german' WHEN {sql_word('la|des|que')} THEN 'french'
  WHEN {sql_word('is|was|be')} THEN 'verbs' ELSE 'places' END"""


def systems(spark, sf_dir):
    # Written once: three systems read the same labelled messages.
    base, _ = write_stage(cases(spark, sf_dir), "cases")
    blank = base.drop("predicted_intent", "intent_confidence", "agreement", "decision", "drafted_reply")
    return {
        "trivial": route.baseline_trivial(blank, intent="verbs", reply="Write to us."),
        "simple": route.baseline_simple(blank, SIMPLE_RULES, "places", {"german": "Bitte melden Sie sich."}, POLICY),
        "full": base,
    }


SYSTEMS = f"""
systems AS (
  SELECT 'trivial' AS system, gold_intent, 'verbs' AS predicted_intent, gold_decision, 'escalate' AS decision FROM cases
  UNION ALL SELECT 'simple', gold_intent, s, gold_decision, CASE WHEN s IN ('german', 'french') THEN 'escalate' ELSE 'auto_handle' END
    FROM (SELECT *, {SIMPLE_SQL} AS s FROM cases)
  UNION ALL SELECT 'full', gold_intent, predicted_intent, gold_decision, decision FROM cases)"""


@query(
    "baselines",
    f"""WITH {CASES} SELECT doc_id, 'verbs' AS trivial_intent, 'escalate' AS trivial_decision, {SIMPLE_SQL} AS simple_intent,
  CASE WHEN {SIMPLE_SQL} = 'places' THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS simple_confidence,
  CASE WHEN {SIMPLE_SQL} = 'german' THEN 'Bitte melden Sie sich.' ELSE '{presets.DEFAULT_TEMPLATE}' END AS simple_reply,
  CASE WHEN {SIMPLE_SQL} IN ('german', 'french') THEN 'intent policy: always escalate for ' || {SIMPLE_SQL}
    ELSE 'simple baseline: non-restricted intent auto_handled' END AS simple_reason FROM cases""",
)
def baselines(spark, sf_dir):
    both = systems(spark, sf_dir)
    trivial = both["trivial"].select(
        "doc_id", F.col("predicted_intent").alias("trivial_intent"), F.col("decision").alias("trivial_decision")
    )
    simple = both["simple"].select(
        "doc_id",
        F.col("predicted_intent").alias("simple_intent"),
        F.col("intent_confidence").alias("simple_confidence"),
        F.col("drafted_reply").alias("simple_reply"),
        F.col("escalation_reason").alias("simple_reason"),
    )
    return trivial.join(simple, "doc_id")


def metric_sql(name: str, expr: str) -> str:
    return f"SELECT '{name}' AS metric, " + ", ".join(
        f"max(CASE WHEN system = '{s}' THEN {expr} END) AS {s}" for s in ("trivial", "simple", "full")
    ) + " FROM per_system"


@query(
    "compare_systems",
    f"""WITH {CASES}, {SYSTEMS}, esc AS ({escalation_sql('systems', 'system')}),
seen AS (SELECT system, gold_intent AS label FROM systems UNION SELECT system, predicted_intent FROM systems),
counts AS (SELECT system, label,
  (SELECT count(*) FROM systems s WHERE s.system = n.system AND gold_intent = label AND predicted_intent = label) AS tp,
  (SELECT count(*) FROM systems s WHERE s.system = n.system AND predicted_intent = label) AS pp,
  (SELECT count(*) FROM systems s WHERE s.system = n.system AND gold_intent = label) AS gp FROM seen n),
f AS (SELECT system, round_even(sum(tp) / sum(gp), 4) AS acc, round_even(avg(CASE WHEN tp = 0 THEN 0.0 ELSE 2 * (tp/pp) * (tp/gp) / (tp/pp + tp/gp) END), 4) AS macro
  FROM counts GROUP BY system),
per_system AS (SELECT * FROM esc JOIN f USING (system))
{metric_sql('intent_accuracy', 'acc')} UNION ALL {metric_sql('intent_macro_f1', 'macro')}
UNION ALL {metric_sql('escalation_precision', 'precision')} UNION ALL {metric_sql('escalation_recall', 'recall')}
UNION ALL {metric_sql('escalation_f1', 'f1')} UNION ALL {metric_sql('false_auto_handle_rate', 'false_auto_handle_rate')}
UNION ALL {metric_sql('false_escalate_rate', 'false_escalate_rate')} UNION ALL {metric_sql('risk_cost', 'normalized_cost')}""",
)
def compare_systems(spark, sf_dir):
    return ev.compare_systems(systems(spark, sf_dir))


def sql_any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


ANGER, OUTSIDE = ("tion the", "und der"), ("that in", " que ")
WRONG = f"({sql_any('drafted_reply', presets.FAILURE_VERSIONS)} AND NOT {sql_any('e', presets.FAILURE_VERSIONS)})"
PLAUSIBLE = (
    f"(NOT {WRONG} AND (({sql_any('drafted_reply', presets.FAILURE_LINKS)} AND NOT {sql_any('e', presets.FAILURE_LINKS)}) "
    "OR coalesce(has_invented_specifics, false)))"
)
MODES_SQL = {
    "ungrounded_specific": f"{WRONG} OR {PLAUSIBLE}",
    "wrong_specific": WRONG,
    "plausible_specific": PLAUSIBLE,
    "language_conflict": "gold_intent = 'french' AND predicted_intent <> 'french'",
    "anger": f"{sql_any('lower(text)', ANGER)} AND agreement < 0.55",
    "out_of_domain": f"intent_confidence < 0.60 OR {sql_any('lower(text)', OUTSIDE)}",
    "false_auto_handle": "gold_decision = 'escalate' AND decision = 'auto_handle'",
}


@query(
    "failure_modes",
    f"WITH {CASES}, c AS (SELECT *, coalesce(top_precedent_reply, '') AS e FROM cases) "
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS mode, count(*) AS count, round_even(count(*) * 100.0 / (SELECT count(*) FROM cases), 2) AS rate_pct,
  coalesce((SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FROM (SELECT doc_id FROM c WHERE {cond} ORDER BY doc_id LIMIT 3)), '') AS examples
FROM c WHERE {cond}"""
        for m, cond in MODES_SQL.items()
    ),
)
def failure_modes(spark, sf_dir):
    tagged = ev.tag_failures(cases(spark, sf_dir), anger=ANGER, outside=OUTSIDE, language_intent="french")
    found = ev.failure_modes(tagged, "doc_id")
    return found.withColumn("examples", F.coalesce(F.array_join(F.col("examples").cast("array<string>"), ","), F.lit("")))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


DETAILS = presets.FAILURE_DETAILS


@query(
    "failure_examples",
    f"""WITH {CASES}, c AS (SELECT *, coalesce(top_precedent_reply, '') AS e FROM cases), """
    + f"""t AS (SELECT *, {WRONG} AS wrong, ({sql_any('drafted_reply', presets.FAILURE_LINKS)} AND NOT {sql_any('e', presets.FAILURE_LINKS)}) AS linked FROM c), """
    + "hits AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS mode, * FROM t WHERE {cond}" for m, cond in MODES_SQL.items())
    + "), ranked AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY doc_id) AS rank FROM hits) "
    + f"""SELECT mode, CAST(rank AS INTEGER) AS rank, doc_id AS id, text AS message, drafted_reply AS draft,
  CASE WHEN mode LIKE '%_specific' THEN CASE WHEN wrong THEN 'wrong_invented_specific' ELSE 'plausible_ungrounded_specific' END END AS sub_mode,
  CASE mode WHEN 'language_conflict' THEN {q(DETAILS['language_conflict'])} WHEN 'anger' THEN {q(DETAILS['anger'])}
    WHEN 'out_of_domain' THEN {q(DETAILS['out_of_domain'])} WHEN 'false_auto_handle' THEN {q(DETAILS['false_auto_handle'])}
    ELSE CASE WHEN wrong THEN {q(DETAILS['wrong_specific'])} WHEN linked THEN {q(DETAILS['plausible_specific'])} ELSE {q(DETAILS['invented_specific'])} END END AS detail,
  gold_intent, predicted_intent, gold_decision, decision, agreement, intent_confidence FROM ranked WHERE rank <= 3""",
)
def failure_examples(spark, sf_dir):
    tagged = ev.tag_failures(cases(spark, sf_dir), anger=ANGER, outside=OUTSIDE, language_intent="french")
    return ev.failure_examples(tagged, "doc_id")


# -- gold labels and rubric -----------------------------------------------------------------------

# Labelling rules on words that occur in the texts.
GOLD_RULES = gd.GoldRules(
    language_words=("aux ", "ç"),
    account_words=(" und ", " der die"),
    money_pattern=r"\b(with this|by the)\b|\$",
    not_money_words=("tion that", "zzz"),
    symptoms=(("update", ("the th", "to the")), ("battery", ("of and",)), ("keyboard", ("is to", "in a")), ("display", ("a the", "that of"))),
    damage_words=("und von", "que la"),
    dead_words=("was is", "on it"),
    language_intent="french",
    account_intent="german",
    billing_intent="places",
)
SYMPTOMS_SQL = " || ".join(
    f"CASE WHEN {sql_any('m', words)} THEN ['{name}'] ELSE [] END" for name, words in GOLD_RULES.symptoms
)
GOLD = f"""
said AS (SELECT *, lower(regexp_replace(text, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS m FROM scored),
ambiguous AS (SELECT *, {SYMPTOMS_SQL} AS symptoms, CASE
  WHEN {sql_any('m', GOLD_RULES.language_words)} AND predicted_intent <> 'french' THEN 'language_vs_technical_topic'
  WHEN {sql_any('m', GOLD_RULES.account_words)} AND predicted_intent <> 'german' THEN 'security_account_overlap'
  WHEN ({sql_word('with this|by the', 'm')} OR contains(m, '$')) AND NOT {sql_any('m', GOLD_RULES.not_money_words)}
    AND predicted_intent <> 'places' THEN 'billing_overlap' END AS ambiguity FROM said),
intended AS (SELECT *, CASE ambiguity WHEN 'language_vs_technical_topic' THEN 'french' WHEN 'security_account_overlap' THEN 'german'
  WHEN 'billing_overlap' THEN 'places' ELSE predicted_intent END AS gold_intent FROM ambiguous),
grounds AS (SELECT *, CASE WHEN gold_intent IN ('places', 'german', 'french') THEN 'policy' WHEN {sql_any('m', GOLD_RULES.damage_words)} THEN 'damage'
  WHEN {sql_any('m', GOLD_RULES.dead_words)} THEN 'dead' ELSE 'standard' END AS ground FROM intended)"""
@query(
    "rule_gold",
    f"""WITH {SCORED_DOCS}, {GOLD} SELECT doc_id, ambiguity, array_to_string(symptoms, ', ') AS symptoms, gold_intent,
  CASE WHEN ground = 'standard' THEN 'auto_handle' ELSE 'escalate' END AS gold_decision,
  CASE ground WHEN 'policy' THEN replace({q(presets.GOLD_REASON_POLICY)}, '%s', gold_intent) WHEN 'damage' THEN {q(presets.GOLD_REASON_DAMAGE)}
    WHEN 'dead' THEN {q(presets.GOLD_REASON_DEAD)} ELSE replace({q(presets.GOLD_REASON_AUTO)}, '%s', gold_intent) END AS gold_escalation_reason,
  CASE WHEN ground = 'policy' THEN CASE gold_intent WHEN 'french' THEN {q(presets.GOLD_CRITERIA_POLICY['international_multilingual_inquiries'])}
      WHEN 'german' THEN {q(presets.GOLD_CRITERIA_POLICY['account_access_apple_id'])} ELSE {q(presets.GOLD_CRITERIA_POLICY['orders_purchases_applecare'])} END
    WHEN ground = 'damage' THEN {q(presets.GOLD_CRITERIA_DAMAGE)} WHEN ground = 'dead' THEN {q(presets.GOLD_CRITERIA_DEAD)}
    ELSE {q(presets.GOLD_CRITERIA_OTHER)} END AS good_reply_criteria FROM grounds""",
)
def rule_gold(spark, sf_dir):
    labelled = gd.rule_gold(scored_documents(spark, sf_dir), GOLD_RULES)
    return labelled.select(
        "doc_id", "ambiguity", F.array_join("symptoms", ", ").alias("symptoms"), "gold_intent", "gold_decision",
        "gold_escalation_reason", "good_reply_criteria",
    )


@query(
    "ambiguity_log",
    f"""WITH {SCORED_DOCS}, {GOLD}, entries AS (
  SELECT doc_id AS id, 0 AS place, ambiguity AS type, text, predicted_intent, gold_intent, symptoms FROM intended WHERE ambiguity IS NOT NULL
  UNION ALL SELECT doc_id, 1, 'compound_multi_symptom_overlap', text, predicted_intent, gold_intent, symptoms FROM intended WHERE len(symptoms) >= 3),
placed AS (SELECT *, row_number() OVER (ORDER BY id, place) AS r FROM entries)
SELECT id, type, text, predicted_intent AS first_intent, gold_intent, array_to_string(symptoms, ', ') AS symptoms,
  CASE type """
    + " ".join(
        f"WHEN '{t}' THEN replace({q(presets.AMBIGUITY_EXPLANATIONS[t])}, '%s', predicted_intent)"
        for t in ("language_vs_technical_topic", "security_account_overlap", "billing_overlap")
    )
    + f""" ELSE printf({q(presets.AMBIGUITY_EXPLANATIONS['compound_multi_symptom_overlap'])}, array_to_string(symptoms, ', '), gold_intent) END AS explanation
FROM placed WHERE place = 0 OR r <= 6""",
)
def ambiguity_log(spark, sf_dir):
    return gd.ambiguity_log(gd.rule_gold(scored_documents(spark, sf_dir), GOLD_RULES), "doc_id")


# Labels as an annotator returns them: some empty, unknown or inconsistent.
ANNOTATED_SELECT = """
SELECT doc_id, text, CASE WHEN lang = 'es' THEN 'none' ELSE predicted_intent END AS predicted_intent,
  CASE doc_id%4 WHEN 0 THEN ' verbs ' WHEN 1 THEN 'nonsense' WHEN 2 THEN 'german' END AS gold_intent,
  CASE doc_id%5 WHEN 0 THEN 'Escalate ' WHEN 1 THEN 'auto_handle' WHEN 2 THEN 'later' END AS gold_decision,
  CASE doc_id%3 WHEN 0 THEN 'A reason' WHEN 1 THEN 'Standard technical troubleshooting resolvable via documented steps.' END AS gold_escalation_reason,
  CASE doc_id%2 WHEN 0 THEN ' Be kind. ' END AS gold_reply_guidance
FROM {scored}
"""
REASONS = {"german": "Needs a German speaker.", "verbs": "Needs a verb."}
ALLOWED = ("verbs", "german", "french", "places")


@query(
    "normalise_gold",
    f"""WITH {SCORED_DOCS}, a AS ({ANNOTATED_SELECT.format(scored='scored')}),
i AS (SELECT *, CASE WHEN trim(gold_intent) IN {ALLOWED} THEN trim(gold_intent) WHEN predicted_intent IN {ALLOWED} THEN predicted_intent ELSE 'verbs' END AS g,
  lower(trim(coalesce(gold_decision, ''))) AS said, trim(coalesce(gold_escalation_reason, '')) AS r FROM a),
d AS (SELECT *, CASE WHEN g IN ('german', 'french') THEN 'escalate' WHEN said IN ('auto_handle', 'escalate') THEN said
  WHEN contains(lower(text), 'store') OR contains(lower(text), 'repair') THEN 'escalate' ELSE 'auto_handle' END AS dec FROM i)
SELECT doc_id, g AS gold_intent, dec AS gold_decision,
  CASE WHEN dec = 'auto_handle' THEN {q(presets.LABEL_AUTO_REASON)} WHEN r = '' OR r = {q(presets.LABEL_AUTO_REASON)} THEN
    CASE g WHEN 'german' THEN 'Needs a German speaker.' WHEN 'verbs' THEN 'Needs a verb.' ELSE {q(presets.LABEL_OTHER_REASON)} END ELSE r END AS gold_escalation_reason,
  CASE WHEN gold_reply_guidance IS NULL THEN {q(presets.LABEL_GUIDANCE)} ELSE 'Be kind.' END AS gold_reply_guidance FROM d""",
)
def normalise_gold(spark, sf_dir):
    given = spark.sql(ANNOTATED_SELECT, scored=scored_documents(spark, sf_dir))
    return gd.normalise_gold(given, ALLOWED, POLICY, "verbs", REASONS).select(
        "doc_id", "gold_intent", "gold_decision", "gold_escalation_reason", "gold_reply_guidance"
    )


@query(
    "rubric_composite",
    f"""WITH {RATED}, r AS (SELECT doc_id, coalesce(CASE WHEN doc_id%4 <> 0 THEN judge_grounded_in_precedent END, 3) AS grounded_in_precedent,
  coalesce(CASE WHEN toxic = 0 THEN judge_factually_non_hallucinatory END, 3) AS factually_non_hallucinatory,
  coalesce(CASE WHEN quality = 1 THEN judge_tone_appropriate END, 4) AS tone_appropriate, judge_resolves_or_correctly_defers AS resolves_or_correctly_defers,
  CASE WHEN doc_id%5 = 0 THEN true END AS flag FROM rated)
SELECT doc_id, grounded_in_precedent, factually_non_hallucinatory, tone_appropriate, resolves_or_correctly_defers,
  round_even((grounded_in_precedent + factually_non_hallucinatory + tone_appropriate + resolves_or_correctly_defers) / 4.0, 2) AS composite_score,
  coalesce(flag, factually_non_hallucinatory <= 2) AS has_invented_specifics FROM r""",
)
def rubric_composite(spark, sf_dir):
    given = rated(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("doc_id") % 4 != 0, F.col("judge_grounded_in_precedent")).alias("grounded_in_precedent"),
        F.when(F.col("toxic") == 0, F.col("judge_factually_non_hallucinatory")).alias("factually_non_hallucinatory"),
        F.when(F.col("quality") == 1, F.col("judge_tone_appropriate")).alias("tone_appropriate"),
        F.col("judge_resolves_or_correctly_defers").alias("resolves_or_correctly_defers"),
        F.when(F.col("doc_id") % 5 == 0, F.lit(True)).alias("has_invented_specifics"),
    )
    return gd.rubric_composite(given)


@query(
    "rule_rubric",
    f"""WITH {CASES}, c AS (SELECT *, lower(coalesce(top_action, '')) AS a, lower(drafted_reply) AS l, coalesce(top_precedent_reply, '') AS e FROM cases)
SELECT doc_id, CAST(CASE WHEN (contains(a, 'dm') AND contains(l, 'dm')) OR (contains(a, 'link') AND (contains(drafted_reply, 'http') OR contains(l, 'link')))
    THEN 5 ELSE 4 END AS INTEGER) AS human_grounded_in_precedent,
  CAST(CASE WHEN {sql_any('drafted_reply', presets.RATER_SPECIFICS)} AND NOT {sql_any('e', presets.RATER_SPECIFICS)} THEN 2 ELSE 5 END AS INTEGER) AS human_factually_non_hallucinatory,
  CAST(CASE WHEN length(drafted_reply) <= 280 AND {sql_any('l', presets.RATER_COURTESY)} THEN 5 ELSE 4 END AS INTEGER) AS human_tone_appropriate,
  CAST(CASE WHEN gold_decision = 'escalate' AND decision = 'auto_handle' THEN 2 WHEN gold_decision = decision THEN 5 ELSE 4 END AS INTEGER)
    AS human_resolves_or_correctly_defers FROM c""",
)
def rule_rubric(spark, sf_dir):
    scored = gd.rule_rubric(cases(spark, sf_dir))
    return scored.select("doc_id", *[f"human_{a}" for a in presets.RUBRIC_AXES])


# -- reports --------------------------------------------------------------------------------------


@query(
    "distribution",
    f"WITH {SCORED_DOCS} SELECT predicted_intent, count(*) AS count, round_even(count(*) * 100.0 / (SELECT count(*) FROM scored), 2) AS pct FROM scored GROUP BY 1",
)
def distribution(spark, sf_dir):
    return reports.distribution(scored_documents(spark, sf_dir), "predicted_intent")


@query(
    "crosstab",
    f"WITH {SCORED_DOCS} SELECT predicted_intent, "
    + ", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS {x}" for x in ("en", "fr", "de"))
    + ", count(*) FILTER (WHERE lang IS NULL OR lang NOT IN ('en', 'fr', 'de')) AS other FROM scored GROUP BY 1",
)
def crosstab(spark, sf_dir):
    """Languages that are not listed count as other."""
    return reports.crosstab(scored_documents(spark, sf_dir), "predicted_intent", "lang", ("en", "fr", "de"))


@query(
    "usage",
    """WITH u AS (SELECT event_type AS step, CAST(floor(value * 10) AS BIGINT) AS p, user_id AS c FROM events)
SELECT step, count(*) AS calls, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens,
  CAST(sum(p) + sum(c) AS BIGINT) AS total_tokens, round_even((sum(p) + sum(c)) / count(*), 2) AS avg_tokens,
  round_even((sum(p) * CAST(CASE step WHEN 'view' THEN 0.15 ELSE 0.20 END AS DOUBLE) + sum(c) * CAST(CASE step WHEN 'view' THEN 0.60 ELSE 0.40 END AS DOUBLE)) / 1000000.0, 4) AS cost
FROM u GROUP BY step""",
)
def usage(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    calls = events.select(
        F.col("event_type").alias("step"),
        F.floor(F.col("value") * 10).cast("bigint").alias("prompt_tokens"),
        F.col("user_id").alias("completion_tokens"),
    )
    rates = {s: (0.20, 0.40) for s in ("click", "error", "purchase", "signup", "scroll", "login", "logout")}
    return reports.usage_report(calls, {"view": (0.15, 0.60), **rates})


@query(
    "modal_share",
    """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, CAST(sum(n) AS BIGINT) AS k, max(n) AS modal, max(n) / sum(n) AS modal_share FROM c GROUP BY 1""",
)
def modal_share(spark, sf_dir):
    return reports.modal_share(table(spark, sf_dir, "documents"), "source", "lang")


TERMS = r"""
words AS (SELECT lang, unnest(regexp_extract_all(regexp_replace(lower(text), '([^\p{L}\p{N}_])', '\1\1', 'g'),
  '(?:^|[^\p{L}\p{N}_])([a-z]{4,})(?:[^\p{L}\p{N}_]|$)', 1)) AS term FROM documents),
kept AS (SELECT lang, term, count(*) AS n FROM words WHERE term NOT IN ('have', 'with', 'this', 'that', 'from', 'when', 'your', 'what',
  'apple', 'applesupport', 'phone', 'iphone') GROUP BY 1, 2)"""


@query(
    "top_terms",
    f"""WITH {TERMS}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM kept)
SELECT lang, term, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def top_terms(spark, sf_dir):
    return reports.top_terms(texts(spark, sf_dir), 5, ["lang"])


CLUSTER_RULES = (
    (r"\b(der|die|und)\b", "german_texts", "Texts in German."),
    (r"\b(zzzz)\b", "never", "Never."),
    (r"\b(les|des|que)\b", "romance_texts", "Texts in French or Spanish."),
)


@query(
    "label_cluster",
    r"""WITH ranked AS (SELECT source || '/' || lang AS cluster, doc_id, text, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rank FROM documents),
combined AS (SELECT cluster, lower(string_agg(text, ' ' ORDER BY rank)) AS t FROM ranked WHERE rank <= 15 GROUP BY 1),
d AS (SELECT cluster, regexp_replace(t, '([^\p{L}\p{N}_])', '\1\1', 'g') AS t FROM combined),
hits AS (SELECT cluster, len(regexp_extract_all(t, '(?:^|[^\p{L}\p{N}_])(der|die|und)(?:[^\p{L}\p{N}_]|$)')) AS g,
  len(regexp_extract_all(t, '(?:^|[^\p{L}\p{N}_])(les|des|que)(?:[^\p{L}\p{N}_]|$)')) AS f,
  regexp_extract_all(t, '(?:^|[^\p{L}\p{N}_])([a-z]{4,})(?:[^\p{L}\p{N}_]|$)', 1) AS w FROM d),
terms AS (SELECT cluster, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM hits),
counted AS (SELECT cluster, term, count(*) AS n, min(place) AS place FROM terms WHERE term NOT IN ('have', 'with', 'this', 'that', 'from', 'when',
  'your', 'what', 'apple', 'applesupport', 'phone', 'iphone') GROUP BY 1, 2),
best AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, place) AS r FROM counted),
named AS (SELECT cluster, string_agg(term, '_' ORDER BY r) AS a, string_agg(term, ' and ' ORDER BY r) AS b FROM best WHERE r <= 2 GROUP BY 1)
SELECT cluster, CASE WHEN g >= 3 THEN 'german_texts' WHEN f >= 3 THEN 'romance_texts' ELSE coalesce(a, 'general_technical_support') || '_inquiry' END AS label,
  CASE WHEN g >= 3 THEN 'Texts in German.' WHEN f >= 3 THEN 'Texts in French or Spanish.'
    ELSE 'Customer assistance inquiries regarding ' || coalesce(b, 'Apple devices') || '.' END AS description
FROM hits LEFT JOIN named USING (cluster)""",
)
def label_cluster(spark, sf_dir):
    from threadloom.operators.messages import first_per_group

    docs = table(spark, sf_dir, "documents").withColumn("cluster", F.concat_ws("/", "source", "lang"))
    ranked = first_per_group(docs, ["cluster"], ["doc_id"], 15)
    return reports.label_clusters(ranked, rules=CLUSTER_RULES)


@query(
    "label_progress",
    """SELECT count(*) AS total, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS labelled,
  round_even(count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) * 100.0 / count(*), 1) AS percent FROM documents""",
)
def label_progress(spark, sf_dir):
    return reports.label_progress(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
