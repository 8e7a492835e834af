import datetime as dt
import pathlib

import pyarrow as pa

from threadloom import presets, session
from threadloom.catalog import streams
from threadloom.operators.resolve import ResolutionRules
from threadloom.plans.triage import TriageConfig
from threadloom.streaming import jobs

POST = "thread_key bigint, post_id bigint, inbound boolean, created_at timestamp, text string"
START = dt.datetime(2024, 1, 1)


def hours(h):
    return START + dt.timedelta(hours=h)


def test_dormancy_watch_across_restarts(spark, tmp_path):
    inbox, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    first = [
        (1, 1, True, hours(0), "help"), (1, 2, False, hours(1), "answer"),
        (2, 3, True, hours(2), "help"), (2, 4, False, hours(3), "answer"), (2, 5, True, hours(4), "thanks a lot"),
    ]
    second = [(3, 6, False, hours(40), "news"), (1, 7, True, hours(41), "again"), (9, 8, True, hours(200), "sentinel")]

    def feed(rows):
        spark.createDataFrame(rows, POST).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(POST).parquet(inbox)
        jobs.resolution_stream(stream, out, mark, ResolutionRules()).awaitTermination()
        return {(r["thread_key"], r["posts"], r["resolution_reason"]) for r in spark.read.parquet(out).collect()}

    assert feed(first) == set()
    done = feed(second)
    assert done == {
        (1, 2, "brand_final_reply_dormant_24h"),
        (2, 3, "customer_gratitude_closure"),
        (3, 1, "single_sided_outbound_announcement"),
        (1, 1, "unanswered_by_brand"),
    }
    # A post older than the watermark changes nothing any more.
    assert feed([(1, 9, True, hours(1.5), "late")]) == done


def test_a_stream_leaves_no_stage_tables(spark, tmp_path):
    """Micro-batches drop the tables they made; a long-running stream does not fill the shared folder."""
    index = spark.createDataFrame(
        [(i, presets.DEFAULT_INTENT, [1.0, float(i)], [1.0, 0.0], "sent a link", "transferred_to_dm", "See the guide") for i in range(6)],
        "hit_id int, intent string, embedding array<double>, action_vector array<double>, action_taken string, outcome string, brand_reply_text string",
    )
    rows = [(i, f"message number {i}", [1.0, float(i)]) for i in range(10)]
    spark.createDataFrame(rows, "message_id int, text string, embedding array<double>").repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("message_id int, text string, embedding array<double>").option("maxFilesPerTrigger", 1)
    shared = pathlib.Path(session.stage_path(spark, "probe").removeprefix("file:")).parent
    shared.mkdir(parents=True, exist_ok=True)
    before = sorted(p.name for p in shared.iterdir())
    out = str(tmp_path / "out")
    jobs.triage_stream(stream.parquet(str(tmp_path / "in")), index, TriageConfig(), out, str(tmp_path / "mark")).awaitTermination()
    records = jobs.read_batches(spark, out)
    assert records.count() == 10 and records.select("batch").distinct().count() > 1
    assert records.where("size(retrieved_precedents) > 0").count() == 10
    assert sorted(p.name for p in shared.iterdir()) == before


def test_a_brands_inbound_posts_count_as_its_own(spark, tmp_path):
    rows = [(1, 1, True, hours(0), "help", "c1"), (1, 2, True, hours(1), "answer", "Acme"), (9, 3, True, hours(200), "sentinel", "c2")]
    spark.createDataFrame(rows, POST + ", author_id string").coalesce(1).write.parquet(str(tmp_path / "in"))
    for brand, reason in ((None, "unanswered_by_brand"), ("acme", "pending_brand_reply")):
        out = str(tmp_path / f"out-{brand}")
        stream = spark.readStream.schema(POST + ", author_id string").parquet(str(tmp_path / "in"))
        jobs.resolution_stream(stream, out, str(tmp_path / f"mark-{brand}"), brand=brand).awaitTermination()
        late = [(9, 4, True, hours(400), "sentinel", "c2")]
        spark.createDataFrame(late, POST + ", author_id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(POST + ", author_id string").parquet(str(tmp_path / "in"))
        jobs.resolution_stream(stream, out, str(tmp_path / f"mark-{brand}"), brand=brand).awaitTermination()
        assert (1, reason) in {(r["thread_key"], r["resolution_reason"]) for r in spark.read.parquet(out).collect()}


def test_a_scorer_gets_batches_of_bounded_size(spark, tmp_path):
    """A stream's Python workers hold few rows at a time; the session's own setting stays as it was."""
    inbox, out, name = str(tmp_path / "in"), str(tmp_path / "out"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.range(3500).coalesce(1).write.parquet(inbox)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    given = spark.conf.get(name)
    stream = spark.readStream.schema("id bigint").parquet(inbox)
    jobs.score_stream(stream, lambda rows: rows.mapInArrow(sizes, "n bigint"), out, str(tmp_path / "mark")).awaitTermination()
    got = [r["n"] for r in spark.read.parquet(out).collect()]
    assert sum(got) == 3500 and max(got) <= 1000
    assert spark.conf.get(name) == given


def test_a_scorer_gets_batches_of_bounded_bytes(spark, tmp_path):
    """Long texts come in fewer rows at a time, so a worker does not grow with their length."""
    inbox, out, name = str(tmp_path / "in"), str(tmp_path / "out"), "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.range(300).selectExpr("repeat('x', 100000) AS text").coalesce(1).write.parquet(inbox)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    given = spark.conf.get(name)
    stream = spark.readStream.schema("text string").parquet(inbox)
    jobs.score_stream(stream, lambda rows: rows.mapInArrow(sizes, "n bigint"), out, str(tmp_path / "mark")).awaitTermination()
    got = [r["n"] for r in spark.read.parquet(out).collect()]
    assert sum(got) == 300 and max(got) <= jobs.BATCH_BYTES // 100_000 + 1
    assert spark.conf.get(name) == given


def test_a_tables_stream_is_written_once(spark, tmp_path):
    """Files hold a bounded number of rows; a table that is not small is neither copied nor shuffled for them."""
    shared = pathlib.Path(session.stage_path(spark, "probe").removeprefix("file:")).parent
    for rows, batches, file_rows, copies in ((70, 3, 10, 1), (5, 3, 10, 2)):
        label = f"stream-of-{rows}"
        stream = streams.as_stream(spark.range(rows).coalesce(1), label, batches, file_rows)
        out = str(tmp_path / f"out-{rows}")
        jobs.score_stream(stream, lambda df: df, out, str(tmp_path / f"mark-{rows}")).awaitTermination()
        assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(rows))
        made = [p for p in shared.iterdir() if p.name.startswith(label)]
        assert len(made) == copies
        sizes = [spark.read.parquet(str(f)).count() for p in made for f in p.glob("*.parquet")]
        assert max(sizes) <= file_rows
