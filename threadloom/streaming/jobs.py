"""Structured Streaming jobs: triage of arriving messages, dormancy watch, incremental scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.functions.values import order_key
from threadloom.operators.resolve import ResolutionRules, has_closure, resolved_of
from threadloom.plans.triage import TriageConfig, triage
from threadloom.session import own_stages

# Rows and bytes that a scorer's Python worker gets in one Arrow batch; texts may be long, so they are far less than Spark's 10,000 and 256 MB.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def _start(writer, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def triage_stream(
    messages: DataFrame,
    index: DataFrame,
    config: TriageConfig,
    out: str,
    checkpoint: str,
    id_col: str = "message_id",
    available_now: bool = True,
) -> StreamingQuery:
    """Triage every micro-batch against a stored index and write the records.

    Each batch goes to a folder of its own, overwritten if the batch is replayed, so a restart
    neither loses nor repeats a record. Read them with ``read_batches``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # A long-running stream leaves no stage tables behind.
        with own_stages(batch.sparkSession):
            triage(batch, index, config, id_col).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return _start(writer, available_now)


def read_batches(spark, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")


def resolution_stream(
    posts: DataFrame,
    out: str,
    checkpoint: str,
    rules: ResolutionRules = ResolutionRules(),
    late: str = "1 hour",
    available_now: bool = True,
    brand: str | None = None,
) -> StreamingQuery:
    """Tag each thread's conversation once it had no new post for the dormancy time.

    ``posts`` carry their thread_key. A session is a run of posts of one thread without a gap of
    the dormancy time; it is written when the watermark passes its end. A thread that resumes
    later starts a new session. State holds one row of fixed size per open session. With a ``brand``, whose posts need
    their author_id, its inbound posts count as the brand's, as in ``resolve.closing_facts``.
    """
    by_brand = ~F.col("inbound")
    if brand is not None:
        by_brand = by_brand | F.coalesce(F.lower("author_id") == brand.lower(), F.lit(False))
    key = order_key(F.col("created_at"), F.col("post_id"))
    customer = F.when(F.col("inbound"), key)
    gap = f"{int(rules.inactivity_hours * 3600)} seconds"
    flagged = posts.select(
        "thread_key", "post_id", "inbound", "created_at", by_brand.alias("by_brand"),
        (F.col("inbound") & has_closure(F.col("text"), rules)).alias("grateful"),
    )
    closed = (
        flagged.withWatermark("created_at", late)
        .groupBy("thread_key", F.session_window("created_at", gap).alias("session"))
        .agg(
            F.max_by("inbound", key).alias("customer_last"),
            F.max("inbound").alias("has_customer"),
            F.max("by_brand").alias("has_brand"),
            F.max_by("grateful", customer).alias("grateful"),
            F.min("created_at").alias("first_at"),
            F.max("created_at").alias("last_at"),
            F.count(F.lit(1)).alias("posts"),
        )
    )
    grateful = F.coalesce("grateful", F.lit(False))
    reason = (
        F.when(~F.col("has_brand"), "unanswered_by_brand")
        .when(~F.col("has_customer"), "single_sided_outbound_announcement")
        .when(F.col("customer_last") & grateful, "customer_gratitude_closure")
        .when(F.col("customer_last"), "pending_brand_reply")
        .when(grateful, "customer_gratitude_confirmed_by_brand")
        .otherwise(rules.dormant)
    )
    tagged = closed.select("thread_key", "first_at", "last_at", "posts", reason.alias("resolution_reason")).withColumn(
        "resolved", resolved_of(F.col("resolution_reason"))
    )
    writer = tagged.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return _start(writer, available_now)


def score_stream(
    rows: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Score arriving rows once: the checkpoint remembers the files read, the sink the batches written.

    A Python worker gets ``BATCH_ROWS`` rows at a time and ``BATCH_BYTES``, or less if the session says so; a stream keeps the settings it
    starts with.
    """
    writer = score(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    conf, arrow = rows.sparkSession.conf, "spark.sql.execution.arrow"
    given = {name: conf.get(name) for name in (f"{arrow}.maxRecordsPerBatch", f"{arrow}.maxBytesPerBatch")}
    for (name, value), most in zip(given.items(), (BATCH_ROWS, BATCH_BYTES)):
        # A value with a unit is above the bound or replaced by it.
        if not (value.isdigit() and 0 < int(value) <= most):
            conf.set(name, most)
    try:
        return _start(writer, available_now)
    finally:
        for name, value in given.items():
            conf.set(name, value)
