import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadloom.operators import resolve
from threadloom.operators.resolve import ResolutionRules

DAY = dt.datetime(2017, 10, 1, 10, 0)


def thread(spark, turns, latest=None, brand=None, rules=ResolutionRules()):
    """Tag one thread given as (inbound, text[, author[, time]]) turns."""
    data = []
    for i, turn in enumerate(turns):
        inbound, text = turn[0], turn[1]
        author = turn[2] if len(turn) > 2 else ("cust" if inbound else "brandA")
        time = turn[3] if len(turn) > 3 else DAY + dt.timedelta(minutes=5 * i)
        data.append((1, i + 1, author, inbound, time, text))
    posts = spark.createDataFrame(data, "thread_key bigint, post_id bigint, author_id string, inbound boolean, created_at timestamp, text string")
    facts = resolve.closing_facts(posts, rules, brand)
    max_time = None
    if latest is not None:
        max_time = spark.createDataFrame([(latest,)], "max_time timestamp")
    row = resolve.tag_resolution(facts, rules, max_time).first()
    return row["resolved"], row["resolution_reason"]


LAST = DAY + dt.timedelta(minutes=5)
CASES = {
    "unanswered": ([(True, "help")], None, ("false", "unanswered_by_brand")),
    "announcement": ([(False, "news"), (False, "more")], None, ("unknown", "single_sided_outbound_announcement")),
    "thanks last": ([(True, "broke"), (False, "reset"), (True, "Thank you, that resolved it!")], None, ("true", "customer_gratitude_closure")),
    "waiting": ([(True, "help"), (False, "model?"), (True, "still not working")], None, ("false", "pending_brand_reply")),
    "signed off": ([(True, "All good now"), (False, "bye")], None, ("true", "customer_gratitude_confirmed_by_brand")),
    "dormant": ([(True, "help"), (False, "dm")], DAY + dt.timedelta(days=9), ("true", "brand_final_reply_dormant_24h")),
    "exactly a day": ([(True, "help"), (False, "dm")], LAST + dt.timedelta(hours=24), ("true", "brand_final_reply_dormant_24h")),
    "a second less": (
        [(True, "help"), (False, "dm")], LAST + dt.timedelta(hours=24, seconds=-1),
        ("unknown", "brand_final_reply_recent_insufficient_observation_window"),
    ),
    "no time": ([(True, "help", "c", None), (False, "dm", "b", None)], None, ("true", "brand_final_reply_dormant_24h")),
    "word inside word": ([(True, "prefixed thanksgiving"), (False, "x"), (True, "unsorted")], None, ("false", "pending_brand_reply")),
    "missing text": ([(True, None), (False, None)], DAY + dt.timedelta(days=9), ("true", "brand_final_reply_dormant_24h")),
}


@pytest.mark.parametrize("name", list(CASES))
def test_every_rule(spark, name):
    turns, latest, want = CASES[name]
    assert thread(spark, turns, latest) == want


def test_brand_may_post_inbound(spark):
    turns = [(True, "I am the brand", "BrandA")]
    assert thread(spark, turns, brand="branda") == ("false", "pending_brand_reply")
    assert thread(spark, turns) == ("false", "unanswered_by_brand")


def test_parameters(spark):
    rules = ResolutionRules(inactivity_hours=2, closure_words=("Merci",), case_sensitive=True)
    assert thread(spark, [(True, "Merci"), (False, "x")], rules=rules)[1] == "customer_gratitude_confirmed_by_brand"
    assert thread(spark, [(True, "merci"), (False, "x")], rules=rules)[1].startswith("brand_final_reply_recent")
    late = DAY + dt.timedelta(hours=3)
    assert thread(spark, [(True, "merci"), (False, "x")], late, rules=rules) == ("true", "brand_final_reply_dormant_2h")


def test_no_thread_matches_keeps_columns(spark):
    threads = spark.createDataFrame([("T_1", ["brandA"])], "thread_id string, brands array<string>")
    assert resolve.filter_brand(threads, "BRANDA").count() == 1
    none = resolve.filter_brand(threads, "nobody")
    assert none.count() == 0 and none.columns == threads.columns


def test_totals_of_nothing(spark):
    empty = spark.createDataFrame([], "resolved string, thread_length bigint")
    row = resolve.outcome_totals(empty).first()
    assert row["total_threads"] == 0 and row["pct_resolved"] == 0.0


def test_outcomes_add_up(spark):
    tagged = spark.createDataFrame([("true", 2), ("true", 3), ("false", 1), ("unknown", 4)], "resolved string, thread_length bigint")
    row = resolve.outcome_totals(tagged).first()
    assert row["resolved_threads"] + row["unresolved_threads"] + row["unknown_threads"] == row["total_threads"] == 4
    assert row["pct_resolved"] == 50.0


def test_brand_candidates_count_each_brand_of_a_thread(spark):
    posts = spark.createDataFrame(
        [(1, 1, "c", True, "q"), (1, 2, "A", False, "x"), (1, 3, "B", False, "y"), (2, 4, "a", False, "z")],
        "thread_key bigint, post_id bigint, author_id string, inbound boolean, text string",
    ).withColumn("created_at", F.timestamp_seconds("post_id"))
    tagged = resolve.tag_resolution(resolve.closing_facts(posts))
    report = {r["brand"]: r.asDict() for r in resolve.brand_candidates(posts, tagged).collect()}
    assert set(report) == {"A", "B"}
    assert report["A"]["total_threads"] == 2 and report["A"]["total_brand_posts"] == 2
    assert report["A"]["total_thread_posts"] == 4 and report["B"]["total_threads"] == 1
