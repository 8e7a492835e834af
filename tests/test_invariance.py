"""Results do not depend on how rows are partitioned."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import graph, resolve, sampling, threads


def posts(spark, n=400):
    rng = random.Random(8)
    rows = []
    for i in range(1, n + 1):
        # Every third post answers post 1; times collide and some are missing.
        parent = 1 if i % 3 == 0 else (rng.randint(1, i - 1) if i > 1 and i % 4 else None)
        when = None if i % 29 == 0 else rng.randint(0, 50)
        rows.append((i, f"a{i % 7}", i % 2 == 0, when, rng.choice(["thanks", "no", "help me", None]), f"{i + 1},x" if i % 11 == 0 else None, parent))
    df = spark.createDataFrame(
        rows, "post_id bigint, author_id string, inbound boolean, s bigint, text string, response_ids string, in_response_to_id bigint"
    )
    return df.withColumn("created_at", F.timestamp_seconds("s")).drop("s")


def results(spark, df):
    keyed = graph.assign_threads(df)
    out = {
        "threads": threads.build_threads(keyed, chunk=30),
        "facts": threads.thread_facts(keyed),
        "first": threads.first_messages(keyed, "a1"),
        "replies": threads.brand_replies(keyed),
        "transcripts": threads.transcripts(keyed, chunk=25),
        "tagged": resolve.tag_resolution(resolve.closing_facts(keyed)),
        "sample": sampling.exact_sample(df, ["author_id"], 50, "post_id"),
    }
    return {name: sorted(map(repr, frame.select(*sorted(frame.columns)).collect())) for name, frame in out.items()}


def test_any_partitioning_gives_the_same(spark):
    df = posts(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for shuffles, parts in ((1, 1), (7, 13)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            seen.append(results(spark, df.repartition(parts, F.rand(3))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for name in seen[0]:
        assert seen[0][name] == seen[1][name], name


@pytest.mark.parametrize("chunk", [1, 25, 10_000])
def test_parts_hold_every_line_in_order(spark, chunk):
    keyed = graph.assign_threads(posts(spark))
    parts = threads.transcripts(keyed, chunk).orderBy("thread_key", "part").collect()
    lines = {}
    for p in parts:
        lines.setdefault(p["thread_key"], []).extend(p["transcript"].split("\n"))
    assert sum(map(len, lines.values())) == 400
    whole = {r["thread_key"]: r["transcript"].split("\n") for r in threads.transcripts(keyed, 10_000).collect()}
    assert lines == whole


