"""Queries that run a whole job and compare what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom import presets
from threadloom.catalog import views
from threadloom.catalog.base import query
from threadloom.catalog.evaluation import CASES, cases
from threadloom.catalog.ingest import LINES, MESSAGES, TAGGED, TOTALS, messages, tagged
from threadloom.catalog.views import WITH_THREADED
from threadloom.operators import resolve
from threadloom.plans import evaluation, ingest, precedents, taxonomy
from threadloom.session import stage_path, write_stage


@query(
    "ingest_job",
    f"""{WITH_THREADED}, {TAGGED} SELECT {TOTALS} FROM tagged
WHERE thread_key IN (SELECT thread_key FROM threaded WHERE NOT inbound AND lower(author_id) = 'brand3')""",
)
def ingest_job(spark, sf_dir):
    """From a CSV export to the tagged threads of one brand."""
    export, out = stage_path(spark, "export"), stage_path(spark, "ingest")
    posts = views.posts(spark, sf_dir)
    written = posts.select(
        F.col("post_id").cast("string").alias("tweet_id"),
        "author_id",
        F.col("inbound").cast("string").alias("inbound"),
        F.date_format("created_at", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"),
        "text",
        F.col("response_ids").alias("response_tweet_id"),
        F.concat(F.col("in_response_to_id").cast("string"), F.lit(".0")).alias("in_response_to_tweet_id"),
    )
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    written.write.options(**keep).option("header", True).option("escape", '"').csv(export)
    paths = ingest.run_ingest(spark, export, out, "Brand3", views.RULES)
    return resolve.outcome_totals(spark.read.parquet(paths.brand_tagged))


@query(
    "gold_set_job",
    f"""{WITH_THREADED}, {MESSAGES}, {TAGGED}, {LINES}, last_reply AS (
  SELECT thread_key, arg_max(trim(text, e' \\n\\t\\r'), position) AS r FROM threaded WHERE NOT inbound GROUP BY 1),
whole AS (SELECT thread_key, string_agg(line, e'\\n' ORDER BY position) AS t FROM lines GROUP BY 1)
SELECT m.thread_id, 'intent_' || (m.post_id % 3) AS predicted_intent, 1::BIGINT AS context_parts, md5(w.t) AS context,
  coalesce(r, '') AS historical_brand_reply, g.resolution_reason AS historical_resolution_reason
FROM messages m JOIN whole w USING (thread_key) LEFT JOIN last_reply USING (thread_key) JOIN tagged g USING (thread_key)""",
)
def gold_set_job(spark, sf_dir):
    """Every first message as a gold case, with the whole transcript of its thread."""
    held = messages(spark, sf_dir).withColumn("predicted_intent", F.concat(F.lit("intent_"), F.col("post_id") % 3))
    wanted = {f"intent_{i}": 2**40 for i in range(3)}
    gold = precedents.gold_set(held, wanted, views.threaded(spark, sf_dir), tagged(spark, sf_dir))
    whole = gold.contexts.select("thread_key", F.md5("transcript").alias("context"))
    return gold.labelled.join(whole, "thread_key").select(
        "thread_id", "predicted_intent", "context_parts", "context", "historical_brand_reply", "historical_resolution_reason"
    )


@query(
    "evaluation_job",
    f"""WITH {CASES}, both_sides AS (SELECT * FROM cases WHERE doc_id % 50 NOT IN (1, 2))
SELECT (SELECT round_even(count(*) FILTER (WHERE gold_intent = predicted_intent) / count(*), 4) FROM both_sides) AS accuracy,
  (SELECT count(*) FROM both_sides) AS samples, count(*) FILTER (WHERE doc_id % 50 <> 1) AS results, count(*) FILTER (WHERE doc_id % 50 <> 2) AS labels,
  count(*) FILTER (WHERE doc_id % 50 = 2) AS results_without_label, count(*) FILTER (WHERE doc_id % 50 = 1) AS labels_without_result FROM cases""",
)
def evaluation_job(spark, sf_dir):
    """An evaluation run in which some results lack a label and some labels a result."""
    rows, _ = write_stage(cases(spark, sf_dir), "cases")
    first = F.struct(F.col("top_precedent_reply").alias("brand_reply_text"), F.col("top_action").alias("action_taken"))
    results = rows.where("doc_id % 50 <> 1").select(
        "doc_id", "text", "predicted_intent", "intent_confidence", "agreement", "decision", "drafted_reply",
        F.array().cast("array<string>").alias("unsupported_claims"), F.lit(True).alias("grounded"), F.array(first).alias("retrieved_precedents"),
    )
    judged = rows.select("doc_id", "has_invented_specifics", *[F.lit(4).alias(a) for a in presets.RUBRIC_AXES])
    run = evaluation.evaluate_run(results, rows.where("doc_id % 50 <> 2"), judged, "doc_id", ("german", "french"))
    found = run.summary.select("accuracy", "samples")
    sides = [F.lit(v).cast("bigint").alias(k) for k, v in run.unmatched.first().asDict().items()]
    return found.select("*", *sides)


@query(
    "taxonomy_job",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{name}', {str(flag).lower()})" for name, _, flag, _ in presets.INTENTS)
    + ") t(intent, escalate), (SELECT true AS few, true AS distinct_texts, true AS from_corpus)",
)
def taxonomy_job(spark, sf_dir):
    """From messages to clusters to a taxonomy: all intents are there, each with up to five distinct messages of the corpus."""
    corpus = taxonomy.message_corpus(views.threaded(spark, sf_dir), tagged(spark, sf_dir), "brand3")
    draft = taxonomy.draft_taxonomy(corpus)
    intents, _ = write_stage(taxonomy.consolidated(draft), "taxonomy")
    texts = F.transform("examples", lambda e: e["text"])
    known = corpus.select(F.col("post_id").cast("string").alias("post_id")).distinct()
    strange = intents.select("intent", F.explode("examples.post_id").alias("post_id")).join(known, "post_id", "left_anti").groupBy("intent").count()
    size = F.coalesce(F.size("examples"), F.lit(0))
    return intents.join(strange, "intent", "left").select(
        "intent", "escalate", (size <= 5).alias("few"),
        F.coalesce(F.size(F.array_distinct(texts)) == F.size("examples"), F.lit(True)).alias("distinct_texts"),
        F.col("count").isNull().alias("from_corpus"),
    )


# Intents of words that occur in the given texts.
SPECS = (
    ("german", "Words of German", False, r"\b(der|und|von)\b"),
    ("romance", "Words of French and Spanish", True, r"\b(la|de|el)\b"),
    ("english", "Words of English", False, r"\b(that|the|it)\b"),
)


@query(
    "taxonomy_draft",
    f"""{WITH_THREADED}, {MESSAGES} SELECT least(2000, count(*)) AS sampled, least(2000, count(*)) AS in_clusters, true AS k_in_range, true AS some_examples
FROM messages""",
)
def taxonomy_draft(spark, sf_dir):
    """The draft's sample of 2,000 messages, or all if fewer, all in one of 5 to 15 clusters, and at least one intent with examples."""
    draft = taxonomy.draft_taxonomy(taxonomy.message_corpus(views.threaded(spark, sf_dir), tagged(spark, sf_dir), "brand3"))
    intents, _ = write_stage(taxonomy.consolidated(draft, SPECS), "taxonomy")
    filled = intents.agg((F.count_if(F.size("examples") > 0) > 0).alias("some_examples"))
    placed = draft.clusters.agg(F.sum("cluster_size").cast("bigint").alias("in_clusters"), F.count(F.lit(1)).between(5, 15).alias("k_in_range"))
    return draft.sample.agg(F.count(F.lit(1)).alias("sampled")).select(
        "sampled", F.lit(placed.select("in_clusters").scalar()).alias("in_clusters"), F.lit(placed.select("k_in_range").scalar()).alias("k_in_range"),
        F.lit(filled.scalar()).alias("some_examples"),
    )
