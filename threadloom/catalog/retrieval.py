"""Queries on precedents, retrieval, agreement, triage and scoring."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from threadloom.catalog import views
from threadloom.catalog.base import query, table, texts
from threadloom.catalog.ingest import MESSAGES, messages
from threadloom.catalog.messages import RULES, SCORED_DOCS, WD, sql_strip
from threadloom.catalog.views import WITH_THREADED
from threadloom.functions.values import half_even
from threadloom.operators import retrieve as rt
from threadloom.operators import score as sc
from threadloom.operators import threads
from threadloom.operators.cells import append_cells, create_cells, retrieve_cells
from threadloom.operators.joins import LeakageError
from threadloom.operators.prune import group_index, retrieve_pruned
from threadloom.plans.triage import TriageConfig, triage
from threadloom.session import stage_path, write_stage

# Every embedding is a precedent, and every one is a query that may not retrieve itself.
INDEX_SELECT = """
SELECT vec_id AS hit_id, CASE label%5 WHEN 0 THEN 'verbs' WHEN 1 THEN 'german' WHEN 2 THEN 'french' WHEN 3 THEN 'places' ELSE 'other' END AS intent,
  embedding, embedding AS action_vector, concat('action ', CAST(label AS STRING)) AS action_taken, concat('outcome_', CAST(vec_id%3 AS STRING)) AS outcome,
  CASE vec_id%4 WHEN 0 THEN 'Update to 11.0.3' WHEN 1 THEN 'See http://t.co/a' ELSE 'Send us a DM' END AS brand_reply_text
FROM {embeddings}
"""


def index(spark, sf_dir):
    """Some action vectors are zero, as of actions without a known word; they are like nothing."""
    rows = spark.sql(INDEX_SELECT, embeddings=table(spark, sf_dir, "embeddings"))
    blank = F.transform("embedding", lambda x: x * 0)
    return rows.withColumn("action_vector", F.when(F.col("hit_id") % 17 == 5, blank).otherwise(F.col("embedding")))


INDEX = f"idx AS (SELECT * REPLACE (CAST(embedding AS DOUBLE[]) AS embedding) FROM ({INDEX_SELECT.format(embeddings='embeddings')}))"


def hits_sql(queries: str, k: int, name: str = "hits") -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT q.query_id, i.hit_id, round_even(list_cosine_similarity(q.embedding, i.embedding), 9) AS s,
  row_number() OVER (PARTITION BY q.query_id ORDER BY round_even(list_cosine_similarity(q.embedding, i.embedding), 9) DESC, i.hit_id) AS rank
  FROM {queries} q JOIN idx i ON i.intent = q.intent AND i.hit_id <> q.query_id) WHERE rank <= {k})"""


def own_hits(spark, sf_dir, k):
    known = index(spark, sf_dir)
    return rt.retrieve(known.withColumnRenamed("hit_id", "query_id"), known, k, exclude_self=True)


@query(
    "topk_retrieve",
    f"""WITH {INDEX}, q AS (SELECT hit_id AS query_id, intent, embedding FROM idx), {hits_sql('q', 5)}
SELECT query_id, hit_id, CAST(rank AS INTEGER) AS rank, greatest(0.0, round_even(s, 4)) AS similarity, round_even(1 - s, 4) AS distance FROM hits""",
)
def topk_retrieve(spark, sf_dir):
    return own_hits(spark, sf_dir, 5)


@query(
    "topk_pruned",
    f"""WITH {INDEX}, q AS (SELECT hit_id AS query_id, intent, embedding FROM idx), {hits_sql('q', 5)}
SELECT query_id, hit_id, CAST(rank AS INTEGER) AS rank, greatest(0.0, round_even(s, 4)) AS similarity, round_even(1 - s, 4) AS distance FROM hits""",
)
def topk_pruned(spark, sf_dir):
    """The same neighbours, from an index grouped by nearest centre."""
    known = index(spark, sf_dir)
    grouped = group_index(known, groups=10)
    return retrieve_pruned(known.withColumnRenamed("hit_id", "query_id"), grouped, 5, exclude_self=True)


@query(
    "topk_cells",
    f"""WITH {INDEX}, q AS (SELECT hit_id AS query_id, intent, embedding FROM idx), {hits_sql('q', 5)}
SELECT query_id, hit_id, CAST(rank AS INTEGER) AS rank, greatest(0.0, round_even(s, 4)) AS similarity, round_even(1 - s, 4) AS distance FROM hits""",
)
def topk_cells(spark, sf_dir):
    """The same neighbours, from a stored index made of one load and two more that were appended to it."""
    known, path = index(spark, sf_dir), stage_path(spark, "cells")
    load = F.pmod(F.xxhash64("hit_id"), F.lit(4))
    create_cells(known.where(load < 2), path, cells=24)
    for number in (2, 3):
        append_cells(known.where(load == number), path)
    return retrieve_cells(known.withColumnRenamed("hit_id", "query_id"), path, 5, exclude_self=True)


def agreement_sql(hits: str) -> str:
    return f"""
scored_hits AS (SELECT h.query_id, h.rank, i.outcome, i.hit_id % 17 <> 5 AND f.hit_id % 17 <> 5 AND list_cosine_similarity(i.embedding, f.embedding) >= 0.65 AS alike
  FROM {hits} h JOIN idx i USING (hit_id) JOIN {hits} h1 ON h1.query_id = h.query_id AND h1.rank = 1 JOIN idx f ON f.hit_id = h1.hit_id),
modes AS (SELECT query_id, max(n) AS modal FROM (SELECT query_id, outcome, count(*) AS n FROM scored_hits GROUP BY 1, 2) GROUP BY 1),
agreed AS (SELECT query_id, count(*) AS hits, CASE WHEN count(*) <= 1 THEN 1.0 ELSE
  round_even(0.60::DOUBLE * (count(*) FILTER (WHERE alike) / count(*)) + 0.40::DOUBLE * (any_value(modal) / count(*)), 4) END AS agreement
  FROM scored_hits JOIN modes USING (query_id) GROUP BY query_id)"""


@query(
    "agreement",
    f"""WITH {INDEX}, q AS (SELECT hit_id AS query_id, intent, embedding FROM idx), {hits_sql('q', 3)}, {agreement_sql('hits')}
SELECT query_id, CAST(hits AS INTEGER) AS hits, agreement FROM agreed""",
)
def agreement(spark, sf_dir):
    facts = index(spark, sf_dir).select("hit_id", "action_vector", "outcome")
    return rt.agreement(own_hits(spark, sf_dir, 3).join(facts, "hit_id"))


@query(
    "precedents",
    f"""{WITH_THREADED}, {MESSAGES}, replies AS (
  SELECT thread_key, trim(text, e' \\n\\t\\r') AS reply, row_number() OVER (PARTITION BY thread_key ORDER BY position) AS n
  FROM threaded WHERE NOT inbound AND length(trim(text, e' \\n\\t\\r')) > 0),
two AS (SELECT thread_key, string_agg(reply, ' | ' ORDER BY n) AS r FROM replies WHERE n <= 2 GROUP BY 1),
m AS (SELECT *, coalesce(r, '{threads.DEFAULT_REPLY}') AS brand_reply_text, post_id % 4 AS kind FROM messages LEFT JOIN two USING (thread_key))
SELECT thread_id, post_id, 'intent_' || (post_id % 3) AS intent, text AS customer_message,
  CASE WHEN kind IN (0, 1) THEN 'Asked for details' ELSE brand_reply_text END AS action_taken,
  CASE WHEN kind = 0 THEN 'transferred_to_dm' ELSE 'information_provided' END AS outcome, brand_reply_text,
  CASE WHEN kind IN (0, 1) THEN 'extracted' ELSE 'fallback' END AS extraction_source FROM m""",
)
def precedents(spark, sf_dir):
    asked = messages(spark, sf_dir).withColumn("predicted_intent", F.concat(F.lit("intent_"), F.col("post_id") % 3))
    kind = F.col("post_id") % 4
    extracted = asked.select(
        "thread_id",
        F.when(kind < 2, " Asked for details ").when(kind == 2, " ").alias("action_taken"),
        F.when(kind == 0, "transferred_to_dm").otherwise("something else").alias("outcome"),
    )
    return rt.build_precedents(asked, threads.brand_replies(views.threaded(spark, sf_dir)), extracted)


@query(
    "index_round_trip",
    f"""WITH {INDEX} SELECT intent, count(*) AS precedents, round_even(sum(sqrt(list_sum(list_transform(embedding, lambda x: x * x)))), 6) AS norms,
  min('message ' || hit_id || chr(10) || 'Action: ' || action_taken) AS first_document, true AS leak_refused
FROM idx WHERE hit_id % 10 <> 3 GROUP BY intent""",
)
def index_round_trip(spark, sf_dir):
    """Build the partitioned index beside a holdout, read it back, and summarise it by intent.

    With the held-out rows among its rows the index must be refused.
    """
    rows = index(spark, sf_dir).withColumn("customer_message", F.concat(F.lit("message "), F.col("hit_id")))
    held = F.col("hit_id") % 10 == 3
    try:
        rt.write_index(rows, rows.where(held), stage_path(spark, "leaking-index"), key="hit_id")
        refused = False
    except LeakageError:
        refused = True
    stored = rt.write_index(rows.where(~held), rows.where(held), stage_path(spark, "index"), key="hit_id").withColumn("refused", F.lit(refused))
    return stored.groupBy("intent").agg(
        F.count(F.lit(1)).alias("precedents"), half_even(F.sum("norm"), 6).alias("norms"), F.min("document").alias("first_document"),
        F.bool_and("refused").alias("leak_refused"),
    )


TEMPLATES = {"verbs": "Update to 11.0.3 please", "places": "See http://t.co/a for the place", "german": "Bitte"}
CONFIG = TriageConfig(
    brand="HelpDesk", rules=RULES, default_intent="other", templates=TEMPLATES, default_reply="Write to us.",
    policy_intents=("german",), confidence_min=0.2, max_chars=4000, exclude_self=True,
)


def stored_index(spark, sf_dir):
    """The index as a table on disk, as a stream reads it in every micro-batch."""
    return write_stage(index(spark, sf_dir), "index")


def triage_input(spark, sf_dir):
    docs = texts(spark, sf_dir).select(F.col("doc_id").alias("message_id"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("message_id"), "embedding")
    return docs.join(vectors, "message_id", "left")


def triage_records(records):
    hits = F.transform("retrieved_precedents", lambda p: p["hit_id"].cast("string"))
    return records.select(
        "message_id", "predicted_intent", "intent_confidence", F.array_join(hits, ",").alias("hits"), "agreement", "drafted_reply",
        "grounded", F.array_join("unsupported_claims", " ").alias("unsupported_claims"), "decision", "escalation_reason",
    )


TRIAGE_SQL = f"""WITH cleaned AS (SELECT doc_id, {sql_strip(f"regexp_replace(regexp_replace(text, '^(?:@{WD}+[ ]*)+', ''), '[ \\t\\n\\r]+', ' ', 'g')")} AS text,
  CASE WHEN length({sql_strip('text')}) = 0 THEN 'empty' WHEN length({sql_strip('text')}) > 4000 THEN 'too_long' END AS rejected FROM documents),
{SCORED_DOCS.replace('FROM documents', 'FROM cleaned')}, {INDEX},
q AS (SELECT doc_id AS query_id, predicted_intent AS intent, CAST(embedding AS DOUBLE[]) AS embedding FROM scored JOIN embeddings ON vec_id = doc_id WHERE rejected IS NULL),
{hits_sql('q', 3)}, {agreement_sql('hits')},
listed AS (SELECT query_id, string_agg(CAST(hit_id AS VARCHAR), ',' ORDER BY rank) AS hits, string_agg(brand_reply_text, chr(10) ORDER BY rank) AS evidence
  FROM hits JOIN idx USING (hit_id) GROUP BY query_id),
drafted AS (SELECT s.doc_id AS message_id, predicted_intent, intent_confidence, rejected, coalesce(l.hits, '') AS hits, coalesce(a.agreement, 1.0) AS agreement,
  coalesce(l.evidence, '') AS evidence, CASE predicted_intent WHEN 'verbs' THEN 'Update to 11.0.3 please' WHEN 'places' THEN 'See http://t.co/a for the place'
    WHEN 'german' THEN 'Bitte' ELSE 'Write to us.' END AS drafted_reply
  FROM scored s LEFT JOIN listed l ON l.query_id = s.doc_id LEFT JOIN agreed a ON a.query_id = s.doc_id),
verified AS (SELECT *, CASE WHEN predicted_intent = 'verbs' AND NOT contains(evidence, '11.0.3') THEN '11.0.3'
  WHEN predicted_intent = 'places' AND NOT contains(evidence, 'http://t.co/a') THEN 'http://t.co/a' ELSE '' END AS unsupported_claims FROM drafted),
reasons AS (SELECT *, CASE WHEN predicted_intent = 'german' THEN 'intent policy: always escalate for german'
  WHEN agreement < 0.50 THEN printf('low precedent agreement (%.2f): retrieved historical resolutions disagree on how this was handled', agreement)
  WHEN unsupported_claims <> '' THEN 'draft contains a claim not supported by retrieved precedent' END AS reason FROM verified)
SELECT message_id, predicted_intent, intent_confidence, hits, agreement, drafted_reply, unsupported_claims = '' AS grounded, unsupported_claims,
  CASE WHEN reason IS NULL THEN 'auto_handle' ELSE 'escalate' END AS decision,
  coalesce(reason, printf('high precedent agreement (%.2f), grounded draft, non-restricted intent', agreement)) AS escalation_reason
FROM reasons WHERE rejected IS NULL
UNION ALL SELECT message_id, 'other', 0.0, '', 0.0, 'We''d like to help. Please DM us.', true, '', 'escalate', 'error fallback: ' || rejected
FROM reasons WHERE rejected IS NOT NULL"""


@query("triage", TRIAGE_SQL)
def triage_query(spark, sf_dir):
    return triage_records(triage(triage_input(spark, sf_dir), index(spark, sf_dir), CONFIG))


# -- scoring --------------------------------------------------------------------------------------

SCORE_SCHEMA = "doc_id bigint, predicted_intent string, intent_confidence double"


def word_scorer(frame: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a model: labels by the number of words, and leaves out long messages."""
    words = frame["text"].str.split().str.len()
    out = pd.DataFrame({"doc_id": frame["doc_id"], "predicted_intent": "short", "intent_confidence": 0.8})
    out.loc[words > 20, "predicted_intent"] = "medium"
    out.loc[words > 100, "predicted_intent"] = "long"
    out.loc[words > 300, "predicted_intent"] = "unheard_of"
    out.loc[words > 100, "intent_confidence"] = None
    return out[words <= 1000]


WORDS = "len(string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' '))"


def first_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sc.score_batches(docs, word_scorer, SCORE_SCHEMA, batch_size=50)


@query(
    "validate_scores",
    f"""WITH w AS (SELECT doc_id, {WORDS} AS n FROM documents)
SELECT doc_id, CASE WHEN n > 100 THEN 'long' WHEN n > 20 THEN 'medium' ELSE 'short' END AS predicted_intent,
  CASE WHEN n > 100 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS intent_confidence FROM w WHERE n <= 300""",
)
def validate_scores(spark, sf_dir):
    return sc.validate_scores(first_scores(spark, sf_dir), ("short", "medium", "long"))


@query(
    "retry_missing",
    f"""WITH w AS (SELECT doc_id, {WORDS} AS n FROM documents)
SELECT doc_id, CASE WHEN n > 1000 THEN 'unknown' WHEN n > 300 THEN 'retried' WHEN n > 100 THEN 'long' WHEN n > 20 THEN 'medium' ELSE 'short' END AS predicted_intent,
  CASE WHEN n > 1000 THEN 0.5 WHEN n > 300 THEN 0.6 WHEN n > 100 THEN 0.9 ELSE 0.8 END AS intent_confidence,
  CASE WHEN n > 1000 THEN 'fallback' ELSE 'scorer' END AS source FROM w""".replace("0.5 WHEN", "0.5::DOUBLE WHEN").replace("THEN 0.6", "THEN 0.6::DOUBLE").replace("THEN 0.9 ELSE 0.8", "THEN 0.9::DOUBLE ELSE 0.8::DOUBLE"),
)
def retry_missing(spark, sf_dir):
    """Rows without a valid answer go to a second scorer, which again leaves out the longest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def again(rows):
        def second(frame: pd.DataFrame) -> pd.DataFrame:
            words = frame["text"].str.split().str.len()
            out = pd.DataFrame({"doc_id": frame["doc_id"], "predicted_intent": "retried", "intent_confidence": 0.6})
            return out[words <= 1000]

        return sc.score_batches(rows, second, SCORE_SCHEMA, batch_size=1)

    answered = sc.validate_scores(first_scores(spark, sf_dir), ("short", "medium", "long"))
    return sc.retry_missing(
        answered, docs, "doc_id", again, {"predicted_intent": "unknown", "intent_confidence": 0.5}
    )


@query(
    "score_incremental",
    f"""WITH w AS (SELECT doc_id, {WORDS} AS n FROM documents)
SELECT doc_id, CASE WHEN n > 300 THEN 'unheard_of' WHEN n > 100 THEN 'long' WHEN n > 20 THEN 'medium' ELSE 'short' END AS predicted_intent,
  CASE WHEN n <= 100 THEN CAST(0.8 AS DOUBLE) END AS intent_confidence FROM w WHERE n <= 1000""",
)
def score_incremental(spark, sf_dir):
    """Score one language first, then everything: the second run only scores what is missing."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), stage_path(spark, "scores")
    score = lambda rows: sc.score_batches(rows.select("doc_id", "text"), word_scorer, SCORE_SCHEMA)
    sc.score_incremental(docs.where("lang = 'en'"), path, "doc_id", score, SCORE_SCHEMA)
    return sc.score_incremental(docs, path, "doc_id", score, SCORE_SCHEMA)


@query(
    "documents_encoded",
    "SELECT doc_id, round_even(length(text) / sqrt(length(text) * length(text) + 1.0), 4) AS x, round_even(1 / sqrt(length(text) * length(text) + 1.0), 4) AS y FROM documents",
)
def documents_encoded(spark, sf_dir):
    """A user encoder in Arrow batches; it maps a text to (length, 1) and the result has length 1."""
    import numpy as np

    from threadloom.operators.ml import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs, lambda texts: np.array([[len(t), 1.0] for t in texts]))
    return encoded.select(
        "doc_id",
        half_even(F.col("embedding")[0].cast("double"), 4).alias("x"),
        half_even(F.col("embedding")[1].cast("double"), 4).alias("y"),
    )


