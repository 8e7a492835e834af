"""The end-to-end jobs on a small export."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from threadloom import presets
from threadloom.operators import joins, ml
from threadloom.plans import evaluation, ingest, precedents, taxonomy
from threadloom.plans.triage import TriageConfig, triage
from threadloom.sources import tables

TOPICS = [
    "my battery drains so fast after charging", "the screen is cracked and touch is broken", "cannot login, password locked icloud",
    "music app keeps skipping songs", "refund for my order please", "the new update crashed, ios reboot",
]


def export(path, n=120):
    rng, lines, post = random.Random(11), ["tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id"], 0
    at = dt.datetime(2017, 10, 1)
    for i in range(n):
        at += dt.timedelta(hours=7)
        stamp = lambda m: (at + dt.timedelta(minutes=m)).strftime("%a %b %d %H:%M:%S +0000 %Y")
        first = post + 1
        topic = TOPICS[i % len(TOPICS)]
        lines.append(f'{first},c{i},True,{stamp(0)},"@AcmeCare {topic}, take {rng.randint(1, 9)}",{first + 1},')
        lines.append(f'{first + 1},AcmeCare,False,{stamp(9)},"@c{i} Please DM us about step {i % 4}",,{first}')
        post += 2
        if i % 3 == 0:
            lines.append(f"{post + 1},c{i},True,{stamp(20)},{'thanks!' if i % 2 else 'no luck'},,{post}")
            post += 1
        if i % 10 == 9:
            lines.append(f"{post + 1},OtherShop,False,{stamp(30)},unrelated news,,")
            post += 1
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return post


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("job")
    rows = export(root / "raw.csv")
    return rows, ingest.run_ingest(spark, str(root / "raw.csv"), str(root / "out"), "acmecare")


def embedder(df, text, out):
    model = ml.embedding_model(df.withColumnRenamed(text, "_t"), "_t", 64)
    return ml.embed(df.withColumn("_t", F.col(text)), model, out).drop("_t")


def test_unreadable_ids_are_kept_apart(spark, tmp_path):
    """The rows of the export are in threads or in the table of rejected posts."""
    export(tmp_path / "raw.csv", 12)
    with open(tmp_path / "raw.csv", "a", encoding="utf-8") as f:
        f.write("oops,c1,True,Sun Oct 01 00:00:00 +0000 2017,no id,,\n12.5,c1,True,Sun Oct 01 00:00:00 +0000 2017,half an id,,\n")
    paths = ingest.run_ingest(spark, str(tmp_path / "raw.csv"), str(tmp_path / "out"), "acmecare")
    assert {r["tweet_id"] for r in spark.read.parquet(paths.rejected).collect()} == {"oops", "12.5"}


def test_ingest(spark, built):
    rows, paths = built
    assert spark.read.parquet(paths.posts).count() == rows
    tagged = spark.read.parquet(paths.brand_tagged)
    assert tagged.count() == 120
    assert {r["resolved"] for r in tagged.select("resolved").distinct().collect()} <= {"true", "false", "unknown"}
    report = spark.read.option("header", True).csv(paths.brand_candidates)
    assert [r["brand"] for r in report.collect()] == ["AcmeCare", "OtherShop"]
    stats = tables.latest_stats(spark.read.parquet(paths.stats))
    assert {r["step"] for r in stats.collect()} == {"load", "typed", "threads", "brand"}


@pytest.fixture(scope="module")
def corpus(spark, built):
    _, paths = built
    posts, tagged = spark.read.parquet(paths.brand_posts), spark.read.parquet(paths.brand_tagged)
    return posts, tagged, taxonomy.message_corpus(posts, tagged, "acmecare")


def test_taxonomy(spark, corpus):
    _, _, messages = corpus
    draft = taxonomy.draft_taxonomy(messages, size=60, k_min=2, k_max=4)
    assert draft.sample.count() == 60 and draft.k in draft.scores and all(-1 <= s <= 1 for s in draft.scores.values())
    clusters = draft.clusters.collect()
    assert sum(c["cluster_size"] for c in clusters) == 60 and all(c["label"] for c in clusters)
    table = taxonomy.consolidated(draft)
    examples = {r["intent"]: [e["text"] for e in r["examples"] or []] for r in table.collect()}
    assert set(examples) == {i[0] for i in presets.INTENTS}
    assert all(len(set(x)) == len(x) <= 5 for x in examples.values()) and len(examples["battery_power_performance"]) >= 3
    drawn = taxonomy.composite_sample(messages, draft, 50)
    assert drawn.count() == 50 and drawn.select("post_id").distinct().count() == 50


def test_precedents_triage_and_evaluation(spark, corpus, tmp_path):
    from threadloom.operators.messages import classify_keywords
    from threadloom.session import write_stage

    posts, tagged, messages = corpus
    classified, _ = write_stage(classify_keywords(messages, text="cleaned_text"), "classified")
    split = precedents.split_corpus(classified, 24)
    joins.assert_disjoint(split.holdout, split.indexable, "thread_id")

    def extract(rows):
        action = F.concat(F.lit("Asked to DM about "), F.col("predicted_intent"))
        return rows.where("post_id % 5 > 0").select("thread_id", action.alias("action_taken"), F.lit("transferred_to_dm").alias("outcome"))

    index = precedents.precedent_index(split, posts, extract, embedder, str(tmp_path / "index"), size=80)
    assert index.count() == 80
    assert {r["extraction_source"] for r in index.select("extraction_source").distinct().collect()} == {"extracted", "fallback"}

    targets = {i[0]: 3 for i in presets.INTENTS}
    gold = precedents.gold_set(split.holdout, targets, posts, tagged)
    labelled = gold.labelled
    assert 0 < labelled.count() <= 24
    contexts = {r["thread_key"]: r["transcript"] for r in gold.contexts.collect()}
    first = labelled.first()
    assert set(contexts) == {r["thread_key"] for r in labelled.collect()} and first["context_parts"] == 1
    assert contexts[first["thread_key"]].startswith("[Customer]: ") and "Brand (AcmeCare)" in contexts[first["thread_key"]]

    asked = embedder(labelled.select("thread_id", "text"), "text", "embedding")
    blank = spark.createDataFrame([("T_blank", "  ", None)], "thread_id string, text string, embedding array<float>")
    scorer = lambda rows: classify_keywords(rows, text="cleaned_text").withColumn("tokens", F.length("cleaned_text"))
    config = TriageConfig(brand="AcmeCare", classify=scorer, usage=("tokens",))
    records = triage(asked.unionByName(blank), index, config, "thread_id")
    records, _ = write_stage(records, "records")
    assert records.count() == labelled.count() + 1
    failed = records.where("thread_id = 'T_blank'").first()
    assert failed["decision"] == "escalate" and failed["escalation_reason"] == "error fallback: empty"
    assert records.where("thread_id <> 'T_blank' AND metrics['tokens'] > 0").count() == labelled.count()
    hits = records.select("predicted_intent", F.explode("retrieved_precedents").alias("p")).join(
        index.select(F.col("hit_id"), F.col("intent")), F.col("p.hit_id") == F.col("hit_id")
    )
    assert hits.where("predicted_intent <> intent").count() == 0
    assert hits.where("p.similarity < 0 or p.similarity > 1").count() == 0

    judged = labelled.select("thread_id", *[F.lit(None).cast("int").alias(a) for a in presets.RUBRIC_AXES],
                             F.lit(None).cast("boolean").alias("has_invented_specifics"))
    run = evaluation.evaluate_run(records, labelled, judged)
    assert run.summary.first()["samples"] == labelled.count()
    assert run.systems.count() == 8 and run.sweep.count() == 7 and run.agreement.count() == 4
    assert run.failures.count() == 7
    assert tuple(run.unmatched.first()) == (labelled.count() + 1, labelled.count(), 1, 0)
    assert {r["mode"] for r in run.failure_examples.collect()} == {r["mode"] for r in run.failures.where("count > 0").collect()}
    assert run.escalation.first()["samples"] == labelled.count()
