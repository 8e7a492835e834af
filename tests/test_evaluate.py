import pytest
from pyspark.sql import functions as F

from threadloom import presets
from threadloom.operators import evaluate as ev
from threadloom.operators import gold as gd
from threadloom.operators import reports, retrieve, route


def pairs(spark, names, rows):
    return spark.createDataFrame(rows, names)


def test_classification(spark):
    df = pairs(spark, "gold_intent string, predicted_intent string", [("a", "a"), ("a", "b"), ("b", "b"), ("c", "c")])
    summary = ev.classification_summary(df).first()
    assert summary["accuracy"] == 0.75 and summary["samples"] == 4
    by_label = {r["label"]: r.asDict() for r in ev.classification_by_label(df).collect()}
    assert by_label["a"] == {"label": "a", "precision": 1.0, "recall": 0.5, "f1": 0.6667, "support": 2}
    assert by_label["b"]["precision"] == 0.5 and by_label["c"]["f1"] == 1.0


def decisions(spark, tp, fp, fn, tn):
    e, a = "escalate", "auto_handle"
    rows = [(e, e)] * tp + [(a, e)] * fp + [(e, a)] * fn + [(a, a)] * tn
    return pairs(spark, "gold_decision string, decision string", rows)


def test_four_decisions(spark):
    row = ev.escalation_metrics(decisions(spark, 1, 1, 1, 1)).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"], row["penalty"]) == (1, 1, 1, 1, 6.0)


# Published results on 200 messages: counts, then precision, recall, F1, miss rate, false alarm rate, cost.
PUBLISHED = [
    ((48, 152, 0, 0), (0.24, 1.0, 0.3871, 0.0, 1.0, 0.76)),
    ((22, 5, 26, 147), (0.8148, 0.4583, 0.5867, 0.5417, 0.0329, 0.675)),
    ((41, 67, 7, 85), (0.3796, 0.8542, 0.5256, 0.1458, 0.4408, 0.51)),
]


@pytest.mark.parametrize("counts,want", PUBLISHED)
def test_published_matrices(spark, counts, want):
    row = ev.escalation_metrics(decisions(spark, *counts)).first()
    names = ("precision", "recall", "f1", "false_auto_handle_rate", "false_escalate_rate", "normalized_cost")
    assert tuple(row[n] for n in names) == want


def test_kappa(spark):
    same = [(i % 5, i % 5) for i in range(10)]
    near = same[:9] + [(4, 3)]
    kappa = lambda rows: ev.cohens_kappa(pairs(spark, "a int, b int", rows), "a", "b").first()["kappa"]
    assert kappa(same) == 1.0 and 0.80 <= kappa(near) < 1.0
    assert kappa([(1, 1)] * 4) == 1.0 and kappa([]) == 0.0
    assert kappa([(0, 1), (1, 0)]) == -1.0


def test_rater_agreement_and_disagreements(spark):
    df = pairs(spark, "id int, human_tone int, judge_tone int, human_fit int, judge_fit int", [(1, 5, 5, 2, 4)])
    got = {r["axis"]: r.asDict() for r in ev.rater_agreement(ev.unpivot_ratings(df, ("tone", "fit"))).collect()}
    assert (got["tone"]["exact_pct"], got["tone"]["kappa"]) == (100.0, 1.0)
    assert (got["fit"]["exact_pct"], got["fit"]["adjacent_pct"], got["fit"]["mean_judge"]) == (0.0, 0.0, 4.0)
    rows = ev.itemise_disagreements(df, ("tone", "fit")).collect()
    assert [(d["axis"], d["human"], d["judge"]) for r in rows for d in r["differences"]] == [("fit", 2, 4)]


ROUTED = "id int, predicted_intent string, intent_confidence double, agreement double, grounded boolean, unsupported_claims array<string>"
ROUTES = [
    ("orders_purchases_applecare", 0.9, 1.0, True, [], "escalate", "intent policy"),
    ("account_access_apple_id", None, 1.0, True, [], "escalate", "intent policy"),
    ("international_multilingual_inquiries", 0.1, 0.1, False, ["x"], "escalate", "intent policy"),
    ("battery_power_performance", None, 0.45, True, [], "escalate", "low precedent agreement (0.45)"),
    ("battery_power_performance", None, 0.80, False, [], "escalate", "draft contains"),
    ("battery_power_performance", None, 0.80, True, ["claim"], "escalate", "draft contains"),
    ("battery_power_performance", None, 0.80, True, [], "auto_handle", "high precedent agreement (0.80)"),
    ("battery_power_performance", 0.52, 0.80, True, [], "escalate", "low classifier confidence (0.52 < 0.60)"),
    ("battery_power_performance", 0.92, 0.80, True, [], "auto_handle", "high precedent"),
    ("battery_power_performance", 0.60, 0.50, True, None, "auto_handle", "high precedent agreement (0.50)"),
    ("battery_power_performance", 0.60, 0.50, None, None, "auto_handle", "high precedent"),
]


def test_routing(spark):
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(ROUTES)], ROUTED)
    got = route.decide(df).orderBy("id").collect()
    for row, want in zip(got, ROUTES):
        assert row["decision"] == want[5] and row["escalation_reason"].startswith(want[6]), want


def test_sweep_equals_deciding_anew(spark):
    rows = [(i, r[0], r[1] if r[1] is not None else 0.75, r[2], r[3], r[4], "escalate" if i % 2 else "auto_handle") for i, r in enumerate(ROUTES)]
    df = spark.createDataFrame(rows, ROUTED + ", gold_decision string")
    swept = {r["tau"]: r.asDict() for r in ev.threshold_sweep(df, route.other_grounds()).collect()}
    assert sorted(swept) == list(presets.SWEEP)
    for tau in presets.SWEEP:
        anew = route.decide(df, confidence_min=tau)
        want = ev.escalation_metrics(anew).first()
        assert swept[tau]["precision"] == want["precision"] and swept[tau]["normalized_cost"] == want["normalized_cost"]
        assert swept[tau]["escalated"] == anew.where("decision = 'escalate'").count()


def test_containment(spark):
    rows = [
        (1, "Update to 11.0.3, see https://t.co/ab.", "we said 11.0.3 before"),
        (2, "HT204910 costs $25.00 or €3", "HT204910 is $25.00"),
        (3, "nothing checkable, 5 of 10", None),
        (4, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, drafted_reply string, evidence string")
    got = {r["id"]: (r["grounded"], sorted(r["unsupported_claims"])) for r in route.containment(df).collect()}
    assert got == {1: (False, ["https://t.co/ab."]), 2: (False, ["€3"]), 3: (True, []), 4: (True, [])}


def agreement_of(spark, hits):
    rows = [(1, i + 1, v, o) for i, (v, o) in enumerate(hits)]
    df = spark.createDataFrame(rows, "query_id int, rank int, action_vector array<double>, outcome string")
    return retrieve.agreement(df).first()["agreement"]


def test_agreement(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    assert agreement_of(spark, [(x, "a")] * 3) == 1.0
    assert agreement_of(spark, [(x, "a"), (y, "b"), (z, "c")]) == 0.3333
    assert agreement_of(spark, [(x, "a")]) == 1.0
    assert agreement_of(spark, [(x, "a"), (x, "b"), (y, "b")]) == round(0.6 * 2 / 3 + 0.4 * 2 / 3, 4)


def test_simple_system_escalates_by_policy(spark):
    df = spark.createDataFrame([(1, "refund please"), (2, "battery drain")], "id int, text string")
    got = {r["id"]: (r["predicted_intent"], r["decision"], r["agreement"]) for r in route.baseline_simple(df).collect()}
    assert got == {1: ("orders_purchases_applecare", "escalate", 0.5), 2: ("battery_power_performance", "auto_handle", 0.5)}
    assert {r["decision"] for r in route.baseline_trivial(df).collect()} == {"escalate"}


def test_gold_rules(spark):
    rows = [
        (1, "Hola, mi celular", "battery_power_performance"),
        (2, "someone sent a phishing mail", "software_update_os_bugs"),
        (3, "I was charged twice", "software_update_os_bugs"),
        (4, "charged but my charger is warm", "battery_power_performance"),
        (5, "cracked screen", "hardware_display_physical"),
        (6, "phone is DEAD", "battery_power_performance"),
        (7, "ios update: battery drain, keyboard and screen glitch", "software_update_os_bugs"),
        (8, "it costs $5", "orders_purchases_applecare"),
    ]
    df = spark.createDataFrame(rows, "id int, text string, predicted_intent string")
    labelled = gd.rule_gold(df)
    got = {r["id"]: (r["gold_intent"], r["gold_decision"], r["ambiguity"]) for r in labelled.collect()}
    assert got == {
        1: ("international_multilingual_inquiries", "escalate", "language_vs_technical_topic"),
        2: ("account_access_apple_id", "escalate", "security_account_overlap"),
        3: ("orders_purchases_applecare", "escalate", "billing_overlap"),
        4: ("battery_power_performance", "auto_handle", None),
        5: ("hardware_display_physical", "escalate", None),
        6: ("battery_power_performance", "escalate", None),
        7: ("software_update_os_bugs", "auto_handle", None),
        8: ("orders_purchases_applecare", "escalate", None),
    }
    log = gd.ambiguity_log(labelled, "id").collect()
    assert sorted(r["id"] for r in log if r["type"] == "compound_multi_symptom_overlap") == [7]


def test_compound_entries_stop_when_the_log_is_long(spark):
    compound = "ios update battery keyboard screen"
    rows = [(i, "hola " + compound if i % 2 == 0 else compound, "software_update_os_bugs") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, text string, predicted_intent string").repartition(5)
    got = sorted((r["id"], r["type"]) for r in gd.ambiguity_log(gd.rule_gold(df), "id").collect())
    log = []
    for i, text, _ in rows:
        if "hola" in text:
            log.append((i, "language_vs_technical_topic"))
        if len(log) < 6:
            log.append((i, "compound_multi_symptom_overlap"))
    assert got == sorted(log)


def test_rubric_defaults(spark):
    schema = ", ".join(f"{a} int" for a in presets.RUBRIC_AXES) + ", has_invented_specifics boolean"
    df = spark.createDataFrame([(None, None, None, None, None), (5, 2, 4, 4, None), (1, 1, 1, 2, False)], schema)
    got = [(r["composite_score"], r["has_invented_specifics"]) for r in gd.rubric_composite(df).collect()]
    assert sorted(got) == [(1.25, False), (3.25, False), (3.75, True)]


def test_failure_modes_lists_all(spark):
    row = (1, "this is trash", "x", "y", "escalate", "auto_handle", 0.9, 0.4, "get 11.0.3 at apple.co/x", "none", True)
    df = spark.createDataFrame(
        [row], "thread_id int, text string, gold_intent string, predicted_intent string, gold_decision string, decision string, "
        "intent_confidence double, agreement double, drafted_reply string, top_precedent_reply string, has_invented_specifics boolean",
    )
    got = {r["mode"]: (r["count"], r["rate_pct"]) for r in ev.failure_modes(ev.tag_failures(df)).collect()}
    assert set(got) == set(ev.FAILURE_MODES)
    hit = {m for m, (n, _) in got.items() if n}
    assert hit == {"ungrounded_specific", "wrong_specific", "anger", "false_auto_handle"} and got["anger"] == (1, 100.0)


def test_progress_of_nothing(spark):
    none = spark.createDataFrame([], "thread_id string")
    assert reports.label_progress(none, none).first().asDict() == {"total": 0, "labelled": 0, "percent": 0.0}
    some = spark.createDataFrame([("a",), ("b",), ("c",)], "thread_id string")
    twice = spark.createDataFrame([("a",), ("a",)], "thread_id string")
    assert reports.label_progress(some, twice).first()["percent"] == 33.3
    assert reports.distribution(some.withColumn("x", F.lit("v")), "x").first()["pct"] == 100.0
