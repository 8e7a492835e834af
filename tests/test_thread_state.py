import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadloom.operators import resolve
from threadloom.operators.resolve import ResolutionRules
from threadloom.streaming import thread_state as ts

POST = "thread_key bigint, post_id bigint, inbound boolean, created_at timestamp, text string, author_id string"
START = dt.datetime(2024, 1, 1)


def post(thread, number, inbound, hour, text="words", author="c"):
    return thread, number, inbound, None if hour is None else START + dt.timedelta(hours=hour), text, author


class Feed:
    """Loads of posts for one stream, which is started again for each."""

    def __init__(self, spark, folder, **options):
        self.spark, self.inbox, self.out, self.mark, self.options = spark, f"{folder}/in", f"{folder}/out", f"{folder}/mark", options

    def __call__(self, rows):
        self.spark.createDataFrame(rows, POST).coalesce(1).write.mode("append").parquet(self.inbox)
        stream = self.spark.readStream.schema(POST).parquet(self.inbox)
        ts.thread_state_stream(stream, self.out, self.mark, **self.options).awaitTermination()
        return {r["thread_key"]: r for r in ts.current_states(self.spark, self.out).collect()}


def batch(spark, rows, brand=None):
    facts = resolve.closing_facts(spark.createDataFrame(rows, POST), ResolutionRules(), brand)
    return {tuple(r) for r in resolve.tag_resolution(facts).select(*COLUMNS).collect()}


COLUMNS = ["thread_key", "thread_id", "thread_length", "end_time", "resolution_reason", "resolved"]


def test_a_resumed_thread_is_corrected(spark, tmp_path):
    feed = Feed(spark, tmp_path, late="0 seconds")
    first = [post(1, 2, False, 1), post(1, 1, True, 0), post(2, 3, True, 2), post(2, 4, False, 3), post(2, 5, True, 4, "thanks a lot"), post(5, 6, False, 4.5)]
    got = feed(first)
    assert (got[1]["resolution_reason"], got[1]["dormant"]) == ("brand_final_reply_recent_insufficient_observation_window", False)
    second = [post(3, 7, False, 40), post(6, 11, True, 41)]
    got = feed(second)
    # The timer fired without a post of the thread.
    assert (got[1]["resolution_reason"], got[1]["dormant"]) == ("brand_final_reply_dormant_24h", True)
    third = [post(1, 8, True, 42, "again"), post(6, 12, False, 43)]
    got = feed(third)
    assert (got[1]["resolution_reason"], got[1]["dormant"], got[1]["thread_length"]) == ("pending_brand_reply", False, 3)
    fourth = [post(1, 9, False, 44), post(9, 10, True, 67), post(8, 20, True, 60), post(8, 21, False, 61)]
    got = feed(fourth)
    # 23 hours after the reply in thread 1, 24 after that in thread 6.
    assert not got[1]["dormant"] and got[6]["dormant"]
    assert {tuple(r[c] for c in COLUMNS) for r in got.values()} == batch(spark, first + second + third + fourth)


def test_a_late_post_is_left_out(spark, tmp_path):
    feed = Feed(spark, tmp_path, late="1 hour")
    feed([post(1, 1, True, 10), post(2, 2, True, 20)])
    got = feed([post(1, 3, False, 19.5), post(2, 4, False, 18.5)])
    assert got[1]["thread_length"] == 2 and got[2]["thread_length"] == 1


def test_untimed_posts_ties_and_brand(spark, tmp_path):
    rows = [
        post(1, 1, True, 0), post(1, 2, False, None), post(2, 4, False, 1), post(2, 3, True, 1), post(3, 5, True, 1), post(3, 6, True, 2, "thanks", "Acme"),
        post(4, 7, False, 3, None), post(5, 8, True, 3, None), post(6, 9, True, 90, "thank you"), post(6, 10, False, 91, ""),
    ]
    for brand in (None, "acme"):
        got = Feed(spark, tmp_path / str(brand), late="0 seconds", brand=brand)(rows)
        assert {tuple(r[c] for c in COLUMNS) for r in got.values()} == batch(spark, rows, brand)
    assert got[1]["dormant"] and got[1]["end_time"] is None


def test_forgotten_after_the_time_kept(spark, tmp_path):
    feed = Feed(spark, tmp_path, late="0 seconds", keep_hours=10)
    feed([post(1, 1, True, 0), post(1, 2, False, 0)])
    assert feed([post(2, 3, True, 30)])[1]["dormant"]
    assert feed([post(1, 4, False, 33)])[1]["thread_length"] == 3
    feed([post(2, 5, True, 60)])
    feed([post(2, 6, True, 68)])
    anew = feed([post(1, 7, True, 69)])[1]
    assert (anew["thread_length"], anew["thread_id"], anew["resolution_reason"]) == (1, "T_7", "unanswered_by_brand")


@pytest.mark.parametrize("partitions", [1, 5])
def test_a_thread_with_most_posts_sends_few_rows(spark, partitions):
    posts = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("thread_key"), F.col("id").alias("post_id"), (F.col("id") % 2 == 0).alias("inbound"),
        F.timestamp_seconds("id").alias("created_at"), (F.col("id") % 2 == 0).alias("by_brand"), F.lit(False).alias("untimed"),
        F.unix_micros(F.timestamp_seconds("id")).alias("at"), F.lit(False).alias("grateful"),
    ).repartition(partitions)
    sides = ", ".join(f"{s}_untimed boolean, {s}_at bigint, {s}_post_id bigint, {s}_inbound boolean" for s in ("first", "last", "asked"))
    reduced = posts.mapInPandas(ts._partial, f"thread_key bigint, clock timestamp, posts bigint, has_brand boolean, {sides}, grateful boolean")
    hot = reduced.where("thread_key = 0").collect()
    assert sum(r["posts"] for r in hot) == 6667 and len(hot) <= partitions + 2
    assert min(r["first_post_id"] for r in hot) == 0 and max(r["last_post_id"] for r in hot) == 19_998 and max(r["asked_post_id"] for r in hot) == 19_998
