"""Queries that run a Structured Streaming job to the end of its input and read the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.catalog import retrieval as rv
from threadloom.catalog import views
from threadloom.catalog.base import REGISTRY, query, table
from threadloom.operators import score as sc
from threadloom.operators.resolve import ResolutionRules
from threadloom.session import stage_path
from threadloom.streaming import jobs, thread_state


# Texts are costly to work on: files of so few rows give each micro-batch more tasks than cores, of about the same size.
TEXT_ROWS = 5_000


def as_stream(df, label: str, batches: int = 4, file_rows: int = 20_000):
    """The rows as a stream of files of bounded size, in about as many micro-batches as asked for.

    They are written once, without a shuffle; only rows too few to fill a file for each batch are dealt anew.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    if stored.count() <= batches * file_rows:
        path, files = stage_path(spark, label), batches
        stored.repartition(files).write.parquet(path)
    else:
        files = len(stored.inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(path)


@query("triage_stream", rv.TRIAGE_SQL)
def triage_stream(spark, sf_dir):
    """Triage over micro-batches gives the records of the batch job."""
    out, mark = stage_path(spark, "triage-out"), stage_path(spark, "triage-mark")
    stored, _ = rv.stored_index(spark, sf_dir)
    stream = as_stream(rv.triage_input(spark, sf_dir), "triage-in", batches=2, file_rows=TEXT_ROWS)
    jobs.triage_stream(stream, stored, rv.CONFIG, out, mark).awaitTermination()
    return rv.triage_records(jobs.read_batches(spark, out))


@query("score_stream", REGISTRY["score_incremental"].sql)
def score_stream(spark, sf_dir):
    """Scoring over micro-batches; a second start on the same checkpoint finds nothing new."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, mark = stage_path(spark, "score-out"), stage_path(spark, "score-mark")
    score = lambda rows: sc.score_batches(rows, rv.word_scorer, rv.SCORE_SCHEMA)
    stream = as_stream(docs, "score-in")
    for _ in range(2):
        jobs.score_stream(stream, score, out, mark).awaitTermination()
    return spark.read.schema(rv.SCORE_SCHEMA).parquet(out)


WATCH = ResolutionRules(inactivity_hours=6.0, closure_words=("purchase", "signup"))


@query(
    "resolution_stream",
    """WITH p AS (SELECT user_id AS thread_key, event_id AS post_id, event_type IN ('view', 'purchase', 'signup') AS inbound, ts,
  event_type IN ('purchase', 'signup') AS thanks FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM p WINDOW w AS (PARTITION BY thread_key ORDER BY ts, post_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY thread_key ORDER BY ts, post_id) AS session FROM g),
f AS (SELECT thread_key, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS posts, arg_max(inbound, (ts, post_id)) AS customer_last,
  bool_or(inbound) AS has_customer, bool_or(NOT inbound) AS has_brand, coalesce(arg_max(thanks, (ts, post_id)) FILTER (WHERE inbound), false) AS grateful
  FROM s GROUP BY thread_key, session),
r AS (SELECT *, CASE WHEN NOT has_brand THEN 'unanswered_by_brand' WHEN NOT has_customer THEN 'single_sided_outbound_announcement'
  WHEN customer_last AND grateful THEN 'customer_gratitude_closure' WHEN customer_last THEN 'pending_brand_reply'
  WHEN grateful THEN 'customer_gratitude_confirmed_by_brand' ELSE 'brand_final_reply_dormant_6h' END AS resolution_reason FROM f
  WHERE last_ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)
SELECT thread_key, CAST(epoch_us(first_ts) AS BIGINT) AS first_at, CAST(epoch_us(last_ts) AS BIGINT) AS last_at, posts, resolution_reason,
  CASE WHEN resolution_reason IN ('unanswered_by_brand', 'pending_brand_reply') THEN 'false'
    WHEN resolution_reason = 'single_sided_outbound_announcement' THEN 'unknown' ELSE 'true' END AS resolved FROM r""",
)
def resolution_stream(spark, sf_dir):
    """Events as posts of one thread per user; sessions close after six quiet hours."""
    events = table(spark, sf_dir, "events")
    posts = events.select(
        F.col("user_id").alias("thread_key"),
        F.col("event_id").alias("post_id"),
        F.col("event_type").isin("view", "purchase", "signup").alias("inbound"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("text"),
    )
    out, mark = stage_path(spark, "closed"), stage_path(spark, "closed-mark")
    # One batch of many files: the watermark moves after it, so no file is late.
    stream = as_stream(posts, "post-stream", batches=1)
    jobs.resolution_stream(stream, out, mark, WATCH).awaitTermination()
    closed = spark.read.parquet(out)
    return closed.withColumns({c: F.unix_micros(c) for c in ("first_at", "last_at")})


@query("resolution_state_stream", REGISTRY["resolution"].sql)
def resolution_state_stream(spark, sf_dir):
    """Posts in three loads by time, the stream started anew for each: every thread's latest record is the batch job's row."""
    posts = views.threaded(spark, sf_dir).select("thread_key", "post_id", "inbound", "created_at", "text")
    at = F.unix_seconds("created_at")
    lo, hi = posts.agg(F.coalesce(F.min(at), F.lit(0)), F.coalesce(F.max(at), F.lit(0))).first()
    load = F.least(F.floor((at - lo) * 3 / F.lit(hi - lo + 1)), F.lit(2))
    inbox, out, mark = (stage_path(spark, f"state-{name}") for name in ("in", "out", "mark"))
    for number in range(3):
        posts.where(F.coalesce(load, F.lit(2)) == number).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(posts.schema).parquet(inbox)
        # Each load is younger than those before it, so no post is late.
        thread_state.thread_state_stream(stream, out, mark, views.RULES, late="0 seconds").awaitTermination()
    return thread_state.current_states(spark, out).select(
        "thread_id", "thread_length", F.unix_seconds("end_time").alias("end_time"), "resolved", "resolution_reason"
    )
